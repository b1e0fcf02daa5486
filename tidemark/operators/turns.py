"""Labels, slots and histories of conversation turns.

Inputs are (conv_id, turn, role, text) with user and assistant turns only.
``blocked`` says that some history is too long for one task (see ``ordered``).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import lang as lg
from tidemark.functions import regex as rx
from tidemark.functions import text as tx
from tidemark.operators.ordered import Running, running, with_previous

KEY = ["conv_id"]
HISTORY = 6


# ------------------------------------------------------------- rule bit masks
def rule_mask(text: Column, patterns: Iterable[str], unicode_words: bool = False) -> Column:
    """One bit per matching pattern, so that a history is the bit-or of its turns."""
    patterns = list(patterns)
    listed, may = rx.may_match(text, patterns)

    def bits(some: Iterable[str]) -> Column:
        out = F.lit(0).cast("bigint")
        for i, p in enumerate(patterns):
            if p in some:
                out = out + F.when(rx.matches(text, p, unicode_words), F.lit(1 << i)).otherwise(F.lit(0))
        return out

    if may is None:
        return bits(patterns)
    # most texts hold no word of the lists
    out = F.when(may, bits(listed)).otherwise(F.lit(0).cast("bigint"))
    return out if len(listed) == len(patterns) else out + bits([p for p in patterns if p not in listed])


def mask_has(mask: Column, i: int) -> Column:
    return mask.bitwiseAND(F.lit(1 << i).cast("bigint")) != 0


def mask_first(mask: Column, labels: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(mask_has(mask, i), label) for i, label in enumerate(labels)])


def mask_list(mask: Column, labels: Sequence[str]) -> Column:
    return F.array_compact(F.array(*[F.when(mask_has(mask, i), label) for i, label in enumerate(labels)]))


def recent(hist: Column, role: str, n: int) -> Column:
    """The last n entries of one role in a history array."""
    mine = F.filter(hist, lambda h: h["role"] == role)
    return F.slice(mine, F.greatest(F.size(mine) - n + 1, F.lit(1)), F.lit(n))


# -------------------------------------------------------------------- emotion
def emotions(turns: DataFrame, blocked: bool = False) -> DataFrame:
    """User turns with ``emotion`` (own label, else the latest labelled user turn among
    the last three turns) and ``register`` (any label over this and two earlier user turns)."""
    own = rx.first_label(F.col("text"), rules.EMOTIONS, unicode_words=True)
    labels = list(dict.fromkeys(label for label, _ in rules.EMOTIONS_WIDE))
    wide = rule_mask(F.col("text"), ["|".join(p for lb, p in rules.EMOTIONS_WIDE if lb == label) for label in labels])
    df = turns.withColumn("_own", own).withColumn("_wide", wide)
    df = with_previous(df, KEY, "turn", 3, F.struct("role", F.col("_own").alias("label")), "_near", blocked)
    df = with_previous(df, [*KEY, "role"], "turn", 2, F.struct(F.col("_wide").alias("m")), "_mine", blocked)
    felt = F.filter("_near", lambda h: (h["role"] == "user") & h["label"].isNotNull())
    mood = F.coalesce("_own", F.get(F.reverse(felt), F.lit(0))["label"], F.lit("neutral"))
    mask = F.aggregate("_mine", F.col("_wide"), lambda acc, h: acc.bitwiseOR(h["m"]))
    return df.where("role = 'user'").select(
        "conv_id", "turn", mood.alias("emotion"),
        F.coalesce(mask_first(mask, labels), F.lit("neutral")).alias("register"))


# -------------------------------------------------------------- profile slots
COURSE_LABELS = [label for _, label in rules.COURSES]
TOPIC_LABELS = [label for _, label in rules.TOPICS]
RECENT_LABELS = [label for _, label in rules.TOPICS_RECENT]


def student_state(turns: DataFrame, blocked: bool = False) -> DataFrame:
    """Profile per user turn over all user text so far."""
    t = F.col("text")
    course = rule_mask(t, [p for p, _ in rules.COURSES], True)
    topic = rule_mask(t, [p for p, _ in rules.TOPICS], True)

    def slot(p):
        return F.lower(rx.find(t, p, 0, unicode_words=True))

    user = turns.where("role = 'user'").withColumn("_course", course).withColumn("_topic", topic)
    here = F.coalesce(mask_first(F.col("_course"), COURSE_LABELS), mask_first(F.col("_topic"), TOPIC_LABELS))
    out = running(user, KEY, "turn", [
        Running("name", "first", rx.find(t, rules.NAME, 1, unicode_words=True, ignore_case=False), include_current=False),
        Running("_courses", "bit_or", F.col("_course")),
        Running("_topics", "bit_or", F.col("_topic")),
        Running("level", "first", slot(rules.LEVEL)),
        Running("year", "first", slot(rules.YEAR)),
        Running("campus", "first", slot(rules.CAMPUS)),
        Running("anchor", "last", here),
    ], blocked)
    return out.select(
        "conv_id", "turn", "name", mask_first(F.col("_courses"), COURSE_LABELS).alias("course"), "level", "year", "campus",
        mask_list(F.col("_topics"), TOPIC_LABELS).alias("topic_stack"), "anchor")


def recent_topics(turns: DataFrame, keep: int = 5, blocked: bool = False) -> DataFrame:
    """Distinct topics of the user turns in the order they were raised, last ``keep``."""
    t = F.col("text")
    user = turns.where("role = 'user'")
    specs = [Running(f"_t{i}", "min", F.when(rx.matches(t, p), F.col("turn"))) for i, (p, _) in enumerate(rules.TOPICS_RECENT)]
    out = running(user, KEY, "turn", specs, blocked)
    raised = F.sort_array(F.array_compact(F.array(*[
        F.when(F.col(f"_t{i}").isNotNull(), F.struct(F.col(f"_t{i}").alias("at"), F.lit(i).alias("i"), F.lit(label).alias("label")))
        for i, label in enumerate(RECENT_LABELS)])))
    last = F.slice(raised, F.greatest(F.size(raised) - keep + 1, F.lit(1)), F.lit(keep))
    return out.select("conv_id", "turn", F.transform(last, lambda s: s["label"]).alias("topics"))


def introduced_name(text: Column) -> Column:
    """Self-introduced first name: TitleCase and not a common word after the introduction."""
    found = [rx.find(text, p, 1) for p in rules.NAME_INTROS]
    return F.coalesce(*[
        F.when(n.rlike("^[A-Z][a-z]") & ~F.lower(n).isin(*rules.BAD_NAMES), n) for n in found])


def student_context(turns: DataFrame, blocked: bool = False) -> DataFrame:
    """Wider profile from this turn and the user turns among the last six."""
    df = with_previous(turns, KEY, "turn", HISTORY, F.struct("role", "text"), "_hist", blocked).where("role = 'user'")
    texts = F.concat(F.array("text"), F.transform(recent(F.col("_hist"), "user", HISTORY), lambda h: h["text"]))
    df = df.withColumn("_all", F.array_join(texts, " \n "))
    c = F.col("_all")
    campus = rx.find(c, rules.CAMPUS_WIDE, 1)
    named = F.lower(campus)
    for cy, en in rules.CAMPUS_NAMES.items():
        named = F.when(F.lower(campus) == cy, en).otherwise(named)
    out = df.select(
        "conv_id", "turn", introduced_name(c).alias("name"),
        rx.first_label(c, rx.flip(rules.STUDENT_TYPES)).alias("student_type"),
        rx.first_label(c, rx.flip(rules.LEVELS_WIDE)).alias("level"),
        rx.first_label(c, rx.flip(rules.YEARS_WIDE)).alias("year"),
        F.initcap(named).alias("campus"), rx.first_label(c, rx.flip(rules.COURSES_WIDE)).alias("course"))
    return out.join(recent_topics(turns, blocked=blocked), ["conv_id", "turn"])


def state_line(state: DataFrame) -> DataFrame:
    """One prompt line per profile: filled slots and the last three topics."""
    slots = [F.concat(F.lit(f"{s}: "), F.col(s)) for s in ("name", "course", "level", "year", "campus")]
    n = F.size("topic_stack")
    last = F.slice("topic_stack", F.greatest(n - 2, F.lit(1)), F.lit(3))
    topics = F.when(n > 0, F.concat(F.lit("recent topics: "), F.array_join(last, ", ")))
    line = F.array_join(F.array_compact(F.array(*slots, topics)), "; ")
    return state.withColumn("line", F.when(line != "", F.concat(F.lit("STUDENT CONTEXT: "), line)).otherwise(""))


def context_lines(ctx: DataFrame, lang: Column) -> DataFrame:
    """Bilingual bullet list of a wider profile."""
    labels = [("name", "Name", "Enw"), ("student_type", "Student type", "Math o fyfyriwr"), ("level", "Level", "Lefel"),
              ("year", "Year/status", "Blwyddyn"), ("campus", "Campus", "Campws"), ("course", "Course of interest", "Maes diddordeb")]
    cy_values = {"international": "rhyngwladol", "home": "cartref/DU", "postgraduate": "ôl-raddedig", "undergraduate": "israddedig"}
    welsh = lang == "cy"
    bits = []
    for col, en, cy in labels:
        value = F.col(col)
        if col in ("student_type", "level"):
            for a, b in cy_values.items():
                value = F.when(welsh & (F.col(col) == a), b).otherwise(value)
        bits.append(F.concat(F.when(welsh, cy).otherwise(en), F.lit(": "), value))
    topics = F.when(F.size("topics") > 0, F.concat(
        F.when(welsh, "Pynciau a drafodwyd: ").otherwise("Topics discussed so far: "), F.array_join("topics", " → ")))
    return ctx.withColumn("lines", F.array_join(F.array_compact(F.array(*bits, topics)), "\n- "))


# -------------------------------------------------------------------- history
def clean_history(turns: DataFrame, blocked: bool = False, keep: int = HISTORY, chars: int = 600) -> DataFrame:
    """The last six turns before each turn, texts cut to 600 characters."""
    short = F.struct("role", F.substring("text", 1, chars).alias("text"))
    return with_previous(turns, KEY, "turn", keep, short, "history", blocked)


def same_language_history(turns: DataFrame, blocked: bool = False, keep: int = HISTORY) -> DataFrame:
    """Prior turns in the language of the current one: their number and the last six texts."""
    df = turns.withColumn("lang", lg.quick_or_english(F.col("text")))
    df = running(df, [*KEY, "lang"], "turn", [Running("n_same", "sum", F.lit(1), include_current=False)], blocked)
    df = with_previous(df, [*KEY, "lang"], "turn", keep, F.struct("role", "text"), "history", blocked)
    return df.withColumn("n_same", F.coalesce("n_same", F.lit(0)))


def running_language(turns: DataFrame, blocked: bool = False) -> DataFrame:
    """User-turn language with the previous turn's own detection as tie-break."""
    own = lg.scored_language(turns.where("role = 'user'"), "text", "own_lang")
    df = with_previous(own, KEY, "turn", 1, F.struct("own_lang"), "_prev", blocked)
    df = df.withColumn("_run", F.get("_prev", F.lit(0))["own_lang"])
    return lg.scored_language(df, "text", "lang", running=F.col("_run")).drop("_prev", "_run")


def validate(turns: DataFrame) -> DataFrame:
    """Validity flags of raw rows (any role)."""
    n = F.char_length("text")
    role_ok = F.col("role").isin("user", "assistant")
    return turns.select(
        "conv_id", "turn", role_ok.alias("role_ok"), n.between(1, 4000).alias("message_ok"),
        n.between(1, 8000).alias("translate_ok"), (n > 1000).alias("cut"),
        (role_ok & n.between(1, 4000)).alias("valid"))


def split_valid(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined) rows."""
    ok = F.col("role").isin("user", "assistant") & F.char_length("text").between(1, 4000)
    return turns.where(ok), turns.where(~F.coalesce(ok, F.lit(False)))


# ---------------------------------------------------------------- turn labels
def question_type(text: Column) -> Column:
    return F.coalesce(rx.first_label(F.lower(F.trim(text)), rules.QUESTION_TYPES), F.lit("GENERAL"))


def query_class(text: Column) -> Column:
    return F.coalesce(rx.first_label(F.lower(text), [(n, p) for n, p, _ in rules.QUERY_CLASSES]), F.lit("other"))


def qualifiers(text: Column) -> Column:
    return rx.all_labels(F.lower(text), rules.QUALIFIERS)


def smalltalk(text: Column) -> Column:
    return rx.first_label(text, rules.SMALLTALK)


def is_crisis(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for phrase in rules.CRISIS:
        out = out | F.contains(low, F.lit(phrase))
    return out


def is_follow_up(text: Column) -> Column:
    t = tx.strip(text)
    return (t != "") & ((tx.word_count(t) <= 6) | rx.matches_any(t, rules.FOLLOWUPS))


def entities(text: Column) -> Column:
    """array<struct<text,type,norm>> of the first mention per entity rule."""
    low = F.lower(text)
    found = []
    for pattern, kind, norm in rules.ENTITIES:
        hit = rx.find(low, pattern)
        found.append(F.when(hit.isNotNull(), F.struct(hit.alias("text"), F.lit(kind).alias("type"), F.lit(norm).alias("norm"))))
    return F.array_compact(F.array(*found))


def sentiment(text: Column) -> Column:
    """2 minus negative plus positive lexicon words, clipped to 0..4."""
    tokens = tx.word_runs(text)
    neg = F.size(F.filter(tokens, lambda t: t.isin(*rules.NEGATIVE_WORDS)))
    pos = F.size(F.filter(tokens, lambda t: t.isin(*rules.POSITIVE_WORDS)))
    return F.greatest(F.lit(0), F.least(F.lit(4), 2 - neg + pos))


def boosted_tags(norm: str) -> list[str]:
    """Tags boosted by an entity's normal form (either string contains the other)."""
    return list(dict.fromkeys(t for key, tags in rules.ENTITY_TAGS if key in norm or norm in key for t in tags))


def entity_tags(text: Column) -> Column:
    """Distinct tags boosted by the entities of a text."""
    low = F.lower(text)
    lists = [F.when(rx.matches(low, p), tx.words(boosted_tags(n))) for p, _, n in rules.ENTITIES if boosted_tags(n)]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*lists))))


def term_patterns(terms: Sequence[str]) -> list[str]:
    return [r"\b" + t + r"\b" for t in terms]


def first_term(text: Column, terms: Sequence[str]) -> Column:
    """First term of the list (not of the text) that occurs; null when none does."""
    any_hit = rx.matches(text, r"\b(?:" + "|".join(terms) + r")\b")
    return F.when(any_hit, F.coalesce(*[F.when(rx.matches(text, p), t) for t, p in zip(terms, term_patterns(terms))]))


ANCHOR_TERMS = [*rules.NAMED_TERMS, *rules.QUALIFIER_TERMS]


def subject_anchor(text: Column) -> Column:
    """First listed term, else a TitleCase phrase, else the last content word."""
    return F.coalesce(
        first_term(text, ANCHOR_TERMS), rx.find(text, rules.TITLE_PHRASE, 1, ignore_case=False),
        F.get(F.reverse(tx.keywords(text, 12)), F.lit(0)))


def has_anchor_term(text: Column) -> Column:
    pattern = r"\b(?:" + "|".join(ANCHOR_TERMS) + r")\b"
    return rx.may_match(text, [pattern])[1] & rx.matches(text, pattern)


def casual_vents(turns: DataFrame, blocked: bool = False) -> DataFrame:
    """Short emotional expressions that are no question and have no earlier topic to refer to."""
    df = turns.withColumn("_term", has_anchor_term(F.col("text")))
    df = with_previous(df, KEY, "turn", HISTORY, F.struct("role", F.col("_term").alias("term")), "_hist", blocked)
    t = tx.strip(F.col("text"))
    prior = F.exists(recent(F.col("_hist"), "user", 3), lambda h: h["term"])
    topic = rx.matches(F.col("text"), rules.HAS_TOPIC)
    short = (tx.word_count(t) <= 3) & ~F.contains(t, F.lit("?"))
    return df.where("role = 'user'").select(
        "conv_id", "turn", topic.alias("has_topic"), prior.alias("prior_topic"),
        (~topic & ~prior & (rx.matches(t, rules.CASUAL) | short)).alias("casual_vent"))


def pronoun_anchors(turns: DataFrame, blocked: bool = False) -> DataFrame:
    """For follow-ups with a pronoun or an elliptic form: the anchor of an earlier turn."""
    t = tx.strip(F.col("text"))
    df = turns.withColumn("_anchor", subject_anchor(F.col("text")))
    df = with_previous(df, KEY, "turn", HISTORY, F.struct("role", F.col("_anchor").alias("anchor")), "_hist", blocked)

    def latest(role, n):
        good = F.filter(recent(F.col("_hist"), role, n), lambda h: F.char_length(h["anchor"]) > 2)
        return F.get(F.reverse(good), F.lit(0))["anchor"]

    asks = is_follow_up(t) & (F.size("_hist") > 0) & (
        rx.matches(t, rules.PRONOUN) | ((tx.word_count(t) <= 6) & rx.matches_any(t, rules.ELLIPTIC)))
    return df.where("role = 'user'").select(
        "conv_id", "turn", asks.alias("asks_back"),
        F.when(asks, F.coalesce(latest("user", 3), latest("assistant", 2))).alias("anchor"))


def rewrite_follow_ups(turns: DataFrame, blocked: bool = False) -> DataFrame:
    """Expanded retrieval query of follow-ups: anchor, earlier topics, keywords, resolved pronoun."""
    text = F.col("text")
    named = F.array_compact(F.array(*[F.when(rx.matches(text, p), t) for t, p in
                                      zip(rules.NAMED_TERMS, term_patterns(rules.NAMED_TERMS))]))
    general = F.array_compact(F.array(*[F.when(rx.matches(text, p), t) for t, p in
                                        zip(rules.QUALIFIER_TERMS, term_patterns(rules.QUALIFIER_TERMS))]))
    no_terms = F.array().cast("array<string>")
    df = turns.select(
        "*", named.alias("_named"), F.when(F.col("role") == "user", general).otherwise(no_terms).alias("_general"),
        tx.keywords(text, 5).alias("_kw"), subject_anchor(text).alias("_anchor"))
    entry = F.struct("role", F.get("_named", F.lit(0)).alias("named"), F.concat("_named", "_general").alias("terms"),
                     F.col("_kw").alias("kw"), F.col("_anchor").alias("anchor"))
    df = with_previous(df, KEY, "turn", HISTORY, entry, "_hist", blocked).where("role = 'user'")
    last5 = F.slice("_hist", F.greatest(F.size("_hist") - 4, F.lit(1)), F.lit(5))
    df = df.withColumn("_u", recent(last5, "user", 2)).withColumn("_a", F.get(recent(last5, "assistant", 1), F.lit(0)))
    df = df.withColumn("_lu", F.get(F.reverse("_u"), F.lit(0)))
    raw_kw = tx.keywords(text, 10)
    user_kw = F.flatten(F.transform("_u", lambda h: h["kw"]))
    assist_kw = F.coalesce(F.slice("_a.kw", 1, 4), no_terms)
    df = df.select(
        "conv_id", "turn", "text", F.size("_hist").alias("_n"),
        F.coalesce("_lu.named", "_a.named", "_lu.anchor", "_a.anchor").alias("_subject"),
        F.slice(F.array_except(user_kw, raw_kw), 1, 8).alias("_lead"),
        F.slice(F.array_except(F.concat(user_kw, assist_kw), raw_kw), 1, 10).alias("_ctx"),
        F.slice(F.array_distinct(F.flatten(F.transform("_hist", lambda h: h["terms"]))), 1, 4).alias("_topics"))
    subject = F.col("_subject")
    pronoun = F.lit(rx.compile_rule(rules.PRONOUN_SUBSTITUTE))
    resolved = F.when(subject.isNotNull(), F.regexp_replace(text, pronoun, F.regexp_replace(subject, r"([\\$])", r"\\$1"))).otherwise(text)
    twice = subject.isin(*rules.NAMED_TERMS)
    lead = F.concat(
        F.when(subject.isNull(), no_terms).when(twice, F.array(subject, subject)).otherwise(F.array(subject)),
        F.col("_topics"), F.slice("_lead", 1, 5))
    rewritten = F.concat(F.array_join(lead, " "), F.lit(" "), resolved, F.lit(" [context: "), F.array_join("_ctx", " "), F.lit("]"))
    changes = is_follow_up(text) & (F.col("_n") > 0) & ((F.size("_lead") > 0) | (F.size("_ctx") > 0))
    return df.select("conv_id", "turn", F.when(changes, rewritten).otherwise(text).alias("rewritten"), changes.alias("changed"))


# -------------------------------------------------------------------- replies
def previous_user_text(turns: DataFrame, blocked: bool = False) -> DataFrame:
    """Every turn with the latest earlier user text."""
    return running(turns, KEY, "turn", [
        Running("asked", "last", F.when(F.col("role") == "user", F.col("text")), include_current=False)], blocked)


def clarifying_replies(turns: DataFrame, blocked: bool = False) -> DataFrame:
    """Assistant turns that bounce a concrete question (four or more words) back."""
    df = previous_user_text(turns, blocked).where("role = 'assistant'")
    bounced = rx.matches_any(F.col("text"), rules.CLARIFY_REPLY)
    return df.select("conv_id", "turn", F.coalesce(bounced & (tx.word_count(F.col("asked")) >= 4), F.lit(False)).alias("bounced"))


def greet_by_name(turns: DataFrame, blocked: bool = False) -> DataFrame:
    """Assistant turns greeted when the turn before introduced a name the reply lacks."""
    entry = F.struct("role", "text")
    df = with_previous(turns, KEY, "turn", 1, entry, "_prev", blocked).where("role = 'assistant'")
    prev = F.get("_prev", F.lit(0))
    name = F.when(prev["role"] == "user", introduced_name(prev["text"]))
    df = df.withColumn("_name", name).withColumn("_lang", lg.quick_or_english(prev["text"]))
    hello = F.when(F.col("_lang") == "cy", "Helô ").otherwise("Hi ")
    rest = F.concat(F.lower(F.substring("text", 1, 1)), F.expr("substring(text, 2)"))
    greet = F.col("_name").isNotNull() & ~F.contains(F.col("text"), F.col("_name"))
    return df.select("conv_id", "turn", F.col("_name").alias("name"),
                     F.when(greet, F.concat(hello, "_name", F.lit(" — "), rest)).otherwise(F.col("text")).alias("reply"))


RETRY = {
    "cy": "Mae'n ddrwg gen i, ni allwn lunio ateb yn Gymraeg. Allwch chi ofyn eto?",
    "en": "Sorry, I could not form a reply in English. Could you ask again?",
}


def coerce_language(turns: DataFrame, blocked: bool = False) -> DataFrame:
    """Assistant replies in the wrong language are replaced by a fixed retry text."""
    df = previous_user_text(turns, blocked).where("role = 'assistant'")
    target = lg.quick_or_english(F.col("asked"))
    actual = F.when(lg.reply_is_welsh(F.col("text")), "cy").otherwise("en")
    drift = (tx.strip(F.col("text")) != "") & (actual != target)
    retry = F.when(target == "cy", RETRY["cy"]).otherwise(RETRY["en"])
    return df.select("conv_id", "turn", target.alias("target"), actual.alias("actual"), drift.alias("drift"),
                     F.when(drift, retry).otherwise(F.col("text")).alias("reply"))


# --------------------------------------------------------------- intent boost
COURSE_FRAGMENTS = [frags for _, frags in rules.COURSE_BOOSTS]
FAMILIES = [name for name, _ in rules.FAMILY_BOOSTS]


def recent_subjects(turns: DataFrame, blocked: bool = False, span: int = 4) -> DataFrame:
    """Bit masks of the courses and families mentioned in the last four turns."""
    low = F.lower("text")
    df = turns.withColumn("_c", rule_mask(low, [p for p, _ in rules.COURSE_BOOSTS], True)).withColumn(
        "_f", rule_mask(low, [p for _, p in rules.FAMILY_BOOSTS], True))
    df = with_previous(df, KEY, "turn", span, F.struct(F.col("_c").alias("c"), F.col("_f").alias("f")), "_hist", blocked)
    zero = F.lit(0).cast("bigint")
    return df.withColumn("courses", F.aggregate("_hist", zero, lambda a, h: a.bitwiseOR(h["c"]))).withColumn(
        "families", F.aggregate("_hist", zero, lambda a, h: a.bitwiseOR(h["f"]))).drop("_c", "_f", "_hist")


def history_boost(tag: Column, courses: Column, families: Column) -> Column:
    """Score multiplier of a tag given what was mentioned recently; first rule wins."""
    tag = F.lower(tag)

    def any_of(flags):
        out = F.lit(False)
        for f in flags:
            out = out | f
        return out

    same = any_of(mask_has(courses, i) & any_of(F.contains(tag, F.lit(x)) for x in frags)
                  for i, frags in enumerate(COURSE_FRAGMENTS))
    family = any_of(mask_has(families, i) & F.contains(tag, F.lit(x)) for i, x in enumerate(FAMILIES))
    return (
        F.when(same, rules.BOOST_COURSE)
        .when((courses != 0) & F.startswith(tag, F.lit("courses_")), rules.BOOST_OTHER_COURSE)
        .when(family, rules.BOOST_FAMILY).otherwise(1.0)
    )
