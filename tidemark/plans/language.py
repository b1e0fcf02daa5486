"""Registered queries: language identification and turn labels over the conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import lang as lg
from tidemark.functions import text as tx
from tidemark.operators import lexicon as lx
from tidemark.operators import turns as tn
from tidemark.plans import corpus as pc
from tidemark.plans import inputs as src


def _turns(spark, d):
    return src.turns(spark, d), src.long_histories(spark, d)


def _user(spark, d):
    return src.turns(spark, d).where("role = 'user'")


def _replies(spark, d):
    return src.turns(spark, d).where("role = 'assistant'")


def detect_language(spark, d):
    docs = src.passages(spark, d).select("doc_id", "text")
    pairs = pc._pairs(spark, d)
    vocab = lx.vocabulary(pc._terms(spark, d), pairs)
    english = pairs.select(F.col("en").alias("term")).distinct()
    return lg.detect_language(docs, "doc_id", "text", vocab, english, looks_welsh=lg.looks_welsh(F.col("text")))


def detect_language_scored(spark, d):
    return lg.scored_language(src.turns(spark, d), "text", "lang").select("conv_id", "turn", "lang")


def running_lang(spark, d):
    t, b = _turns(spark, d)
    return tn.running_language(t, b).select("conv_id", "turn", "own_lang", "lang")


def reply_language(spark, d):
    t = F.col("text")
    return _replies(spark, d).select(
        "conv_id", "turn", lg.reply_score_welsh(t).alias("looks_welsh"), lg.reply_is_welsh(t).alias("reply_welsh"),
        lg.reply_is_english(t).alias("reply_english"))


def language_drift(spark, d):
    t, b = _turns(spark, d)
    return tn.coerce_language(t, b)


def history_clean(spark, d):
    t, b = _turns(spark, d)
    joined = F.array_join(F.transform("history", lambda h: F.concat(h["role"], F.lit(":"), h["text"])), "\n")
    return tn.clean_history(t, b).select("conv_id", "turn", F.size("history").alias("n"), F.md5(joined).alias("history_md5"))


def history_same_lang(spark, d):
    t, b = _turns(spark, d)
    joined = F.array_join(F.transform("history", lambda h: h["text"]), "\n")
    return tn.same_language_history(t, b).select("conv_id", "turn", "lang", "n_same", F.md5(joined).alias("history_md5"))


def turn_validate(spark, d):
    raw = src.table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    return tn.validate(raw.unionByName(spark.createDataFrame(src.EXAMPLE_TURNS, src.TURN_SCHEMA)))


def emotion_turns(spark, d):
    t, b = _turns(spark, d)
    return tn.emotions(t, b)


def _state(spark, d):
    t, b = _turns(spark, d)
    return tn.student_state(t, b)


def student_state(spark, d):
    return _state(spark, d).select(
        "conv_id", "turn", "name", "course", "level", "year", "campus", F.array_join("topic_stack", ",").alias("topic_stack"), "anchor")


def student_context_line(spark, d):
    return tn.state_line(_state(spark, d)).select("conv_id", "turn", "line")


def student_context_node(spark, d):
    t, b = _turns(spark, d)
    ctx = tn.student_context(t, b).withColumn("lang", F.when(F.col("conv_id") % 2 == 0, "cy").otherwise("en"))
    return tn.context_lines(ctx, F.col("lang")).withColumn("topics", F.array_join("topics", ","))


def topic_stack(spark, d):
    t, b = _turns(spark, d)
    return tn.recent_topics(t, blocked=b).select("conv_id", "turn", F.array_join("topics", ",").alias("topics"))


def query_class(spark, d):
    c = tn.query_class(F.col("text"))
    temp = F.lit(0.30)
    for name, _, value in rules.QUERY_CLASSES:
        temp = F.when(c == name, value).otherwise(temp)
    return _user(spark, d).select("conv_id", "turn", c.alias("class"), temp.alias("temperature"))


def question_type(spark, d):
    return _user(spark, d).select("conv_id", "turn", tn.question_type(F.col("text")).alias("type"))


def query_qualifiers(spark, d):
    return _user(spark, d).select("conv_id", "turn", F.array_join(tn.qualifiers(F.col("text")), ",").alias("qualifiers"))


def smalltalk_crisis(spark, d):
    t = F.col("text")
    return _user(spark, d).select("conv_id", "turn", tn.smalltalk(t).alias("smalltalk"), tn.is_crisis(t).alias("crisis"))


def followup_flag(spark, d):
    return _user(spark, d).select("conv_id", "turn", tn.is_follow_up(F.col("text")).alias("follow_up"))


def subject_anchor(spark, d):
    return _user(spark, d).select("conv_id", "turn", tn.subject_anchor(F.col("text")).alias("anchor"))


def entity_mentions(spark, d):
    found = F.transform(tn.entities(F.col("text")), lambda e: F.concat_ws(":", e["text"], e["type"], e["norm"]))
    return _user(spark, d).select("conv_id", "turn", F.array_join(found, ";").alias("entities"))


def entity_boost(spark, d):
    return _user(spark, d).select("conv_id", "turn", F.array_join(F.sort_array(tn.entity_tags(F.col("text"))), ",").alias("tags"))


def lexicon_sentiment(spark, d):
    return _user(spark, d).select("conv_id", "turn", tn.sentiment(F.col("text")).alias("sentiment"))


def keywords(spark, d):
    kw = tx.keywords(F.col("text"), 6)
    return src.turns(spark, d).select("conv_id", "turn", F.array_join(kw, " ").alias("keywords"),
                                      F.size(F.array_distinct(kw)).alias("n_distinct"))


def casual_vent(spark, d):
    t, b = _turns(spark, d)
    return tn.casual_vents(t, b)


def reply_clarify_flag(spark, d):
    t, b = _turns(spark, d)
    return tn.clarifying_replies(t, b)


def greeting_prefix(spark, d):
    t, b = _turns(spark, d)
    return tn.greet_by_name(t, b)


def pronoun_anchor(spark, d):
    t, b = _turns(spark, d)
    return tn.pronoun_anchors(t, b)


def followup_rewrite(spark, d):
    t, b = _turns(spark, d)
    return tn.rewrite_follow_ups(t, b)


def intent_history_boost(spark, d):
    t, b = _turns(spark, d)
    tags = tx.words([*src.INTENT_TAGS, "courses_business"])
    rows = tn.recent_subjects(t, b).where("role = 'user'").select("conv_id", "turn", "courses", "families", F.explode(tags).alias("tag"))
    return rows.select("conv_id", "turn", "tag", tn.history_boost(F.col("tag"), F.col("courses"), F.col("families")).alias("boost"))


def reply_reshape(spark, d):
    t, b = _turns(spark, d)
    df = tn.previous_user_text(t, b).where("role = 'assistant'")
    parts = F.split("text", "\n")
    sources = F.transform(parts, lambda p: F.struct(F.substring(p, 1, 20).alias("title"), F.char_length(p).alias("chars")))
    return df.select(
        "conv_id", "turn", F.md5("text").alias("response_md5"), F.lit("").alias("alt_response"),
        F.coalesce(tn.smalltalk(F.col("asked")), F.lit("backend")).alias("tag"),
        lg.quick_or_english(F.col("text")).alias("lang"), F.lit(1).alias("confidence"),
        F.size(sources).alias("n_sources"), F.get(sources, F.lit(0))["title"].alias("first_title"),
        F.get(sources, F.lit(0))["chars"].alias("first_chars"))


def query_augment(spark, d):
    q = src.questions(spark, d)
    out = lx.augment(q, "item_id", "text", F.col("query_lang"), pc._pairs(spark, d))
    return out.select("item_id", "augmented")


def gloss_replace(spark, d):
    return lx.gloss_text(src.questions(spark, d), "item_id", "text", pc._pairs(spark, d))


def ngram_augment(spark, d):
    return lx.ngram_augment(src.questions(spark, d), "item_id", "text", pc._pairs(spark, d))


QUERIES = {f.__name__: f for f in (
    detect_language, detect_language_scored, running_lang, reply_language, language_drift, history_clean,
    history_same_lang, turn_validate, emotion_turns, student_state, student_context_line, student_context_node,
    topic_stack, query_class, question_type, query_qualifiers, smalltalk_crisis, followup_flag, subject_anchor,
    entity_mentions, entity_boost, lexicon_sentiment, keywords, casual_vent, reply_clarify_flag, greeting_prefix,
    pronoun_anchor, followup_rewrite, intent_history_boost, reply_reshape, query_augment, gloss_replace, ngram_augment)}
