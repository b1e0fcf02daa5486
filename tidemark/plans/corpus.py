"""Registered queries: corpus building, lexicon, knowledge base."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import lang as lg
from tidemark.functions import stem as st
from tidemark.functions import text as tx
from tidemark.operators import acts, bayes
from tidemark.operators import corpus as cp
from tidemark.operators import knowledge as kb
from tidemark.operators import lexicon as lx
from tidemark.plans import inputs as src
from tidemark.session import cut, scratch_path
from tidemark.sources import records

SAMPLE = 500
SUBJECTS = [f"src{i}" for i in range(10)]
KEEP_IN = [("of the", "fees_tuition"), ("the and", "graduation"), ("that the", "no_such_tag")]
SERVICES = [("library", "library", "llyfrgell"), ("parking", "parking", "parcio")]
CONCERNS = [("fees", "tuition fees", "ffioedd dysgu"), ("visa", "visa", "fisa")]


def _bands(text):
    return [cp.in_band(text, low, high).alias(name) for name, low, high in rules.LENGTH_BANDS]


def bounded_sample(spark, d):
    rows = src.passages(spark, d).select("doc_id", "text")
    keep = cp.in_band(F.col("text"), 80, 1200)
    return cp.bounded_sample(rows, "doc_id", SAMPLE, keep).select(
        "doc_id", cp.relevant(F.col("text"), rules.RELEVANT_STUDY).alias("relevant"))


def keyword_filter(spark, d):
    t = F.col("text")
    return src.passages(spark, d).select(
        "doc_id", cp.relevant(t, rules.RELEVANT_STUDY).alias("study"), cp.relevant(t, rules.RELEVANT_GENERAL).alias("general"))


def length_band(spark, d):
    t = F.col("text")
    return src.passages(spark, d).select(
        "doc_id", *_bands(t), (F.char_length(t) >= rules.MIN_PAGE_CHARS).alias("page"),
        (F.char_length(t) >= rules.MIN_PASSAGE_CHARS).alias("passage"))


def welsh_filter(spark, d):
    return src.passages(spark, d).select("doc_id", cp.answer_is_welsh(F.col("text")).alias("welsh"))


def filter_funnel(spark, d):
    t = F.col("text")
    rows = src.passages(spark, d).select(
        cp.relevant(t, rules.RELEVANT_GENERAL).alias("r"), cp.in_band(t, 80, 1200).alias("q"))
    return rows.agg(
        F.count("*").alias("scanned"), F.count_if("r").alias("relevant"), F.count_if("q").alias("quality"),
        F.count_if(F.col("r") & F.col("q")).alias("matched"), F.count_if(~(F.col("r") & F.col("q"))).alias("skipped"))


def first_qa_pair(spark, d):
    return src.first_pairs(spark, d)


def qa_docs(spark, d):
    return cp.qa_documents(src.first_pairs(spark, d)).select("conv_id", "title", F.md5("text").alias("text_md5"), "lang")


def qa_incremental(spark, d):
    pairs = src.first_pairs(spark, d)
    stored = pairs.where("conv_id % 2 = 0")
    fresh = pairs.where("conv_id % 3 <> 0")
    return cp.append_new(fresh, stored).select("conv_id", "question")


def answer_aliases(spark, d):
    return src.documents(spark, d).select("doc_id", F.md5(cp.join_aliases(F.split("text", "\n"))).alias("joined_md5"))


def corpus_chunks(spark, d):
    docs = src.passages(spark, d).select("doc_id", "text")
    return cp.chunk_documents(docs, "doc_id").select(
        "doc_id", "pos", F.char_length("chunk").alias("n_chars"), "lang", F.md5("chunk").alias("chunk_md5"))


def facts_docs(spark, d):
    return cp.fact_documents(src.facts(spark, d)).select("title", "source", "lang", F.md5("text").alias("text_md5"))


def knowledge_docs(spark, d):
    return cp.response_documents(src.intent_responses(spark, d)).select("title", "lang", F.md5("text").alias("text_md5"))


def _pairs(spark, d):
    """The merged lexicon: a build product, written once and then read by its users."""
    rec = src.lexicon_records(spark, d)
    return cut(lx.merge(rec.where("doc_id % 4 = 0"), rec.where("doc_id % 4 <> 0"), SUBJECTS))


def lexicon_merge(spark, d):
    pairs = _pairs(spark, d)
    back = lx.reverse_map(pairs).select("en", F.col("cy").alias("back"))
    return pairs.join(back, "en", "left").orderBy("cy")


def lexicon_bootstrap(spark, d):
    return lx.bootstrap_docs(_pairs(spark, d))


def term_normalise(spark, d):
    rec = src.lexicon_records(spark, d)
    n, cy, en = F.col("seq") % 4, F.col("cy"), F.col("en")
    raw = rec.select(
        "seq",
        F.when(n == 0, cy).when(n == 1, "").alias("termCy"), F.when(n == 1, cy).alias("welsh"),
        F.when(n == 2, F.concat(F.lit(" "), cy)).alias("cy"), F.when(n == 3, F.upper(cy)).alias("WelshTerm"),
        F.when(n == 3, en).when(n == 2, "").alias("termEn"), F.when(n == 2, en).when(n == 1, "  ").alias("english"),
        F.when(n == 1, en).alias("en"), F.when(n == 0, en).alias("EnglishTerm"))
    return lx.normalise_terms(raw, ["termCy", "welsh", "cy", "WelshTerm"], ["termEn", "english", "en", "EnglishTerm"], "seq")


def _terms(spark, d):
    line = src.documents(spark, d).select(F.explode(F.split("text", "\n")).alias("line"))
    return lx.term_tokens(line, "line")


def term_tokens(spark, d):
    return _terms(spark, d).select("term").orderBy("term")


def vocab_build(spark, d):
    return lx.vocabulary(_terms(spark, d), _pairs(spark, d))


def term_tsv(spark, d):
    path = scratch_path(spark, "terms")
    rec = src.lexicon_records(spark, d).select("seq", "cy", "en")
    rec.write.option("sep", "\t").option("header", True).csv(path)
    return lx.term_tokens(records.read_tsv(spark, path, "seq long, cy string, en string"), "cy")


def embed_refresh(spark, d):
    docs = src.documents(spark, d)
    text = cp.embedding_text(F.array("source"), F.col("text"))
    corpus = docs.select("doc_id", cp.content_hash(text).alias("hash"))
    stale = F.when(F.col("doc_id") % 7 == 0, F.concat(text, F.lit("x"))).otherwise(text)
    cache = docs.where("doc_id % 5 <> 0").select("doc_id", cp.content_hash(stale).alias("hash"))
    return cp.refresh_plan(corpus, cache, "doc_id")


def embed_write(spark, d):
    docs = src.tagged_documents(spark, d)
    text = cp.embedding_text(F.array("source"), F.col("text"))
    path = scratch_path(spark, "vectors")
    docs.select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "cy", "cy").otherwise("en").alias("lang"),
                cp.content_hash(text).alias("hash"), cp.hashing_vectoriser()(text).alias("vec")).write.parquet(path)
    back = spark.read.parquet(path)
    return back.select("id", "lang", "hash", F.size("vec").alias("dim"))


def corpus_union(spark, d):
    docs = src.documents(spark, d)
    corpus = cp.passage_records(docs.withColumn("heading", F.lit(None).cast("string")), ["text"], ["heading"], "doc_id")
    corpus = corpus.select("title", F.lit("corpus").alias("source"), lg.quick_or_english(F.col("text")).alias("lang"), "text")
    facts = cp.fact_documents(src.facts(spark, d))
    know = cp.response_documents(src.intent_responses(spark, d)).withColumn("source", F.lit("knowledge"))
    boot = lx.bootstrap_docs(_pairs(spark, d)).withColumn("source", F.lit("lexicon"))
    union = corpus
    for part in (facts, know, boot):
        union = union.unionByName(part, allowMissingColumns=True)
    return union.select("source", "title", "lang", F.md5("text").alias("text_md5"))


def index_append(spark, d):
    path = scratch_path(spark, "index")
    docs = src.tagged_documents(spark, d).select(
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("title"), "text",
        F.coalesce("lang", F.lit("en")).alias("lang"))
    cp.append_passages(spark, docs.where("hash(title) % 2 = 0"), path)
    cp.append_passages(spark, docs, path)
    cp.append_passages(spark, docs, path)
    return spark.read.parquet(path).select("title", "lang", F.char_length("text").alias("n_chars"))


def dialogue_acts(spark, d):
    user = src.turns(spark, d).where("role = 'user'")
    return acts.mined_phrases(user, "text", spark)


def exemplar_chunks(spark, d):
    return acts.exemplars(acts.mined_phrases(src.turns(spark, d).where("role = 'user'"), "text", spark), shown=20)


def _tagged_turns(spark, d):
    u = src.table(spark, d, "conversations").where("role = 'user'")
    tag = F.when(F.col("conv_id") % 7 == 0, "unknown_tag").otherwise(src._tag(F.col("conv_id")))
    return u.select((F.col("conv_id") * src.SEQ + F.col("turn")).alias("seq"), tag.alias("tag"),
                    F.array_join(tx.letter_tokens(F.col("text")), " ").alias("pattern"))


def _whole_patterns(spark, d):
    return src.intent_patterns(spark, d).select(
        "seq", "tag", F.array_join(tx.letter_tokens(F.col("pattern")), " ").alias("pattern"))


def pattern_merge(spark, d):
    return _merged_patterns(spark, d).select("tag", "origin", F.md5("pattern").alias("pattern_md5"))


def pattern_dedupe(spark, d):
    rows = _whole_patterns(spark, d).unionByName(
        _tagged_turns(spark, d).withColumn("seq", F.col("seq") + (1 << 62)))
    return kb.dedupe_patterns(rows, KEEP_IN)


def kb_audit(spark, d):
    facts = src.facts(spark, d)
    return kb.audit(_whole_patterns(spark, d), src.intent_responses(spark, d), facts, shown=30).select("rule", "tag", "msg", "n_issues")


def inventory_counts(spark, d):
    def one(name, df):
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("metric"), "n")

    out, pairs = one("documents", src.documents(spark, d)), _pairs(spark, d)
    for name, df in (("vocabulary", lx.vocabulary(_terms(spark, d), pairs)), ("pairs", pairs),
                     ("reverse_pairs", lx.reverse_map(pairs)), ("topics", src.topics(spark, d))):
        out = out.unionByName(one(name, df))
    phrases = src.topics(spark, d).agg(F.sum(F.size(F.split("phrases", "\n"))).alias("n"))
    return out.unionByName(phrases.select(F.lit("phrases").alias("metric"), "n"))


def topic_grid(spark, d):
    part = src.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("en"))
    supp = src.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("en"))
    seg = src.table(spark, d, "customer").select(F.lower("c_mktsegment").alias("id")).distinct().select("id", F.col("id").alias("en"))
    nat = src.table(spark, d, "nation").select(
        F.concat(F.lit("subject-"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("en"))

    def cy(df):
        return df.withColumn("cy", F.concat(F.lit("y "), "en"))

    built = kb.build_topics([
        kb.simple_topics(cy(nat), 0, ["{en}", "help with {en}"], ["cymorth {cy}"], "{en} support", 7),
        kb.subject_topics(cy(part), 1), kb.campus_topics(cy(supp), SERVICES, 4), kb.student_topics(cy(seg), CONCERNS, 5)])
    return built.select(
        "id", "title", "title_cy", "priority", "hint",
        F.size("phrases_en").cast("bigint").alias("n_en"), F.size("phrases_cy").cast("bigint").alias("n_cy"),
        F.md5(F.array_join("phrases_en", "|")).alias("en_md5"), F.md5(F.array_join("phrases_cy", "|")).alias("cy_md5"))


def _merged_patterns(spark, d):
    training = src.intent_patterns(spark, d).where("seq % 2 = 0")
    return kb.merge_patterns(training, _whole_patterns(spark, d), _tagged_turns(spark, d))


def nb_intent(spark, d):
    """Tag of every user turn by Naive Bayes over the merged patterns."""
    asked = src.turns(spark, d).where("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("turn_id"), "text")
    return bayes.classify(bayes.train(_merged_patterns(spark, d)), asked, "turn_id")


def stem_normalise(spark, d):
    toks = tx.preprocess(F.col("text"))
    return src.documents(spark, d).select("doc_id", F.md5(F.array_join(st.stems(toks), " ")).alias("stems_md5"),
                                          F.size(toks).alias("n_terms"))


def response_pick(spark, d):
    resp = src.intent_responses(spark, d)
    lang = F.when(F.col("responses_cy").isNotNull(), "cy").otherwise("en")
    text = F.coalesce("responses_en", "responses_cy", "responses_list")[0]
    turns = src.turns(spark, d).where("role = 'user' AND conv_id >= 0")
    asked = turns.select("conv_id", "turn", src._tag(F.col("conv_id") + F.col("turn")).alias("tag"),
                         F.when(F.col("turn") % 4 == 0, "cy").otherwise("en").alias("lang"))
    picked = kb.pick_response(asked, resp.select("seq", "tag", lang.alias("lang"), text.alias("text")),
                              F.col("conv_id") * 31 + F.col("turn"))
    return picked.select("conv_id", "turn", "tag", F.md5("response").alias("response_md5"))


QUERIES = {f.__name__: f for f in (
    bounded_sample, keyword_filter, length_band, welsh_filter, filter_funnel, first_qa_pair, qa_docs, qa_incremental,
    answer_aliases, corpus_chunks, facts_docs, knowledge_docs, lexicon_merge, lexicon_bootstrap, term_normalise,
    term_tokens, vocab_build, term_tsv, embed_refresh, embed_write, corpus_union, index_append, dialogue_acts,
    exemplar_chunks, pattern_merge, pattern_dedupe, kb_audit, inventory_counts, topic_grid, nb_intent, stem_normalise,
    response_pick)}
