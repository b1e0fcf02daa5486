"""Registered queries: sparse, dense and fused retrieval of benchmark questions over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import text as tx
from tidemark.operators import answers
from tidemark.operators import retrieval as rt
from tidemark.operators import store as st
from tidemark.operators.ordered import top_k
from tidemark.plans import inputs as src
from tidemark.session import cut

TOP = 5
# default k and pool size per query language (None means no language given)
DEFAULT_K = {"cy": 5, "en": 4, None: 2}


def pool(k: int) -> int:
    return max(2 * k, 8)


def _asked(queries, lang):
    return queries.where(F.col("query_lang").eqNullSafe(lang) if lang else F.col("query_lang").isNull())


def _allowed(lang):
    """Language filter on a tag column; a missing tag passes the English filter."""
    if lang == "cy":
        return F.col("lang").eqNullSafe("cy")
    return ~F.col("lang").eqNullSafe("cy") if lang == "en" else F.lit(True)


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def bm25_stats(spark, d):
    stats = rt.build_stats(src.documents(spark, d).select("doc_id", "text"), tx.index_tokens(F.col("text")))
    return stats.terms.select("term", "df", F.round("idf", 6).alias("idf"), F.lit(round(stats.avgdl, 6)).alias("avgdl"))


def _sparse(spark, d):
    """One BM25 store over the tagged documents, and the query side of the benchmark."""
    tokens = tx.index_tokens(F.col("text"))
    store = st.build_sparse(src.tagged_documents(spark, d).select("doc_id", "lang", "text"), tokens)
    return store, rt.query_terms(src.questions(spark, d), "item_id", tokens)


def _bm25(spark, d, k, built=None):
    store, asked = built or _sparse(spark, d)
    asked = cut(asked)
    return st.sparse_lists(st.narrowed(store, asked), asked, k)[0]


def bm25_topk(spark, d):
    return _bm25(spark, d, TOP)


def _bm25_by_lang(spark, d, built=None):
    """Ranked lists per query under its own language filter and pool size; each filter prunes the store's partitions."""
    store, asked = built or _sparse(spark, d)
    asked = cut(asked)
    store = st.narrowed(store, asked)
    langs = src.questions(spark, d).select("item_id", "query_lang")
    return _union([
        st.sparse_lists(store, asked.join(_asked(langs, lang).select("item_id"), "item_id"), pool(k), keep=_allowed(lang))[0]
        for lang, k in DEFAULT_K.items()]).select("item_id", "doc_id", "score", "rnk")


def bm25_topk_lang(spark, d):
    return _bm25_by_lang(spark, d)


def tfidf_topk(spark, d):
    return _tfidf(spark, d, 20)


def _tfidf(spark, d, k):
    """Stemmed tf-idf: source and text of each passage, stoplist and stems by its language (English unless Welsh)."""
    def english(lang):
        return F.when(F.col(lang) == "cy", "cy").otherwise("en").alias("lang")

    docs = src.tagged_documents(spark, d).select("doc_id", F.concat_ws("\n", "source", "text").alias("text"), english("lang"))
    asked = src.questions(spark, d).select("item_id", "text", english("query_lang"))
    terms = tx.preprocess_by(F.col("text"), F.col("lang"))
    store = st.build_sparse(docs, terms, bm25=False, stems=True)
    asked = cut(rt.query_terms(asked, "item_id", terms, stems=True))
    return st.sparse_lists(st.narrowed(store, asked), asked, k, floor=rules.TFIDF_FLOOR)[0]


def _dense(spark, d):
    """One store of all vectors with the language tag of their document."""
    tag = src.tagged_documents(spark, d).select(F.col("doc_id").alias("vec_id"), "lang")
    return st.build_dense(src.vectors(spark, d).join(tag, "vec_id", "left"))


def dense_ranked(spark, d, k):
    """The k nearest vectors of every question with a positive cosine."""
    ranked, _ = st.dense_lists(_dense(spark, d), src.question_vectors(spark, d).drop("query_lang"), k, floor=0.0)
    return ranked.select("item_id", "vec_id", "score", "rnk")


def dense_topk(spark, d):
    return dense_ranked(spark, d, 20)


def _by_lang(cy, en, none):
    return F.when(F.col("query_lang") == "cy", cy).when(F.col("query_lang") == "en", en).otherwise(none)


def _dense_lists(spark, d):
    """The filtered list of every query and the general one where a filter applies, from one pass over the store."""
    keep = {"filtered": _by_lang(_allowed("cy"), _allowed("en"), F.lit(True)), "general": F.col("query_lang").isNotNull()}
    pools = [pool(DEFAULT_K[lang]) for lang in ("cy", "en", None)]
    return st.dense_lists(_dense(spark, d), src.question_vectors(spark, d), _by_lang(*pools), keep, max(pools))[0]


def dense_topk_lang(spark, d):
    ranked = _dense_lists(spark, d).where("list = 'filtered'").drop("list")
    return ranked.select("item_id", "vec_id", "score", "rnk")


def _keys(spark, d, *hits):
    """Passage keys of the documents that a list of ids names; only their texts are shuffled and hashed, in one pass."""
    ids = cut(_union([h.toDF("doc_id") for h in hits]).distinct())
    found = rt.among(src.tagged_documents(spark, d), ids, "doc_id")
    return cut(found.select(F.col("doc_id").alias("vec_id"), "doc_id", rt.passage_key(F.col("text")).alias("key"), "lang"))


def _filled_dense(spark, d, min_fill, lists, keys):
    """Filtered dense lists topped up from the unfiltered ranking when under-filled."""
    asked = src.questions(spark, d).select("item_id", "query_lang")
    lists = lists.join(keys, "vec_id").join(asked, "item_id")
    filtered = lists.where("list = 'filtered'")
    # ranks close up where a vector has no passage
    plain = top_k(filtered.where("query_lang IS NULL").withColumnRenamed("rnk", "_at"), ["item_id"], [F.col("_at")], pool(DEFAULT_K[None]))
    frames = [plain.select("item_id", "key", "doc_id", "rnk")]
    for lang in ("cy", "en"):
        general = lists.where((F.col("list") == "general") & (F.col("query_lang") == lang))
        if lang == "en":
            general = general.where(_allowed("en"))
        mine = filtered.where(F.col("query_lang") == lang)
        frames.append(rt.top_up(*(x.select("item_id", "key", "doc_id", "rnk") for x in (mine, general)), min_fill or DEFAULT_K[lang]))
    return _union(frames)


def dense_topup(spark, d):
    # a fill target above the pool size exercises the top-up for every query
    lists = cut(_dense_lists(spark, d))
    return _filled_dense(spark, d, 12, lists, _keys(spark, d, lists.select("vec_id"))).select("item_id", "rnk", "doc_id")


def vector_normalise(spark, d):
    v = src.vectors(spark, d)
    first = rt.unit(F.col("embedding"))
    total = F.aggregate(first, F.lit(0.0), lambda a, x: a + x)
    return v.select(
        "vec_id", F.round(first[0], 6).alias("first"), F.round(total, 5).alias("total"),
        F.round(2 - 2 * rt.cosine(F.col("embedding"), F.reverse("embedding")), 5).alias("distance_to_reverse"))


def vector_load(spark, d):
    tag = src.tagged_documents(spark, d).select(F.col("doc_id").alias("vec_id"), "lang")
    v = src.vectors(spark, d).join(tag, "vec_id", "left").where(F.size("embedding") > 0)
    return v.select("vec_id", F.coalesce("lang", F.lit("en")).alias("lang"), F.size("embedding").cast("bigint").alias("dim"))


def _dense_sparse_lists(spark, d, k):
    dense, sparse = cut(dense_ranked(spark, d, k)), cut(_bm25(spark, d, k))
    keys = _keys(spark, d, dense.select("vec_id"), sparse.select("doc_id"))
    dense, sparse = dense.join(keys, "vec_id"), sparse.join(keys.drop("vec_id"), "doc_id")
    return {"dense": dense.select("item_id", "key", "rnk"), "sparse": sparse.select("item_id", "key", "rnk")}


def rrf_fuse(spark, d):
    fused = rt.fuse(_dense_sparse_lists(spark, d, 8), 4)
    return fused.select("item_id", "rnk", F.md5("key").alias("key"), "score", "dense_rank", "sparse_rank")


def hybrid_search(spark, d):
    """Full retrieval: language-filtered dense pool with top-up, filtered sparse pool, fusion, adaptive k."""
    lists, sparse = cut(_dense_lists(spark, d)), cut(_bm25_by_lang(spark, d))
    keys = _keys(spark, d, lists.select("vec_id"), sparse.select("doc_id"))
    dense = _filled_dense(spark, d, None, lists, keys).select("item_id", "key", "rnk")
    sparse = sparse.join(keys.select("doc_id", "key"), "doc_id").select("item_id", "key", "rnk")
    fused = rt.fuse({"dense": dense, "sparse": sparse}, max(DEFAULT_K.values()))
    k = _by_lang(*(DEFAULT_K[lang] for lang in ("cy", "en", None)))
    asked = src.questions(spark, d).where(F.trim("text") != "").select("item_id", "query_lang")
    return fused.join(asked, "item_id").where(F.col("rnk") <= k).select(
        "item_id", "rnk", F.md5("key").alias("key"), "score")


def _with_texts(spark, d, hits, **made):
    """Hits with the texts of their question and document, or what is ``made`` once of each document; only hits are shuffled."""
    hits = cut(hits)
    q = src.questions(spark, d).select("item_id", F.col("text").alias("query_text"))
    docs = rt.among(src.documents(spark, d).select("doc_id", "text"), hits.select("doc_id").distinct(), "doc_id")
    return hits.join(q, "item_id").join(tx.computed(docs, "doc_id", **made) if made else docs, "doc_id")


def _reranked(spark, d, hits):
    hits = _with_texts(spark, d, hits, tokens=rt.rerank_tokens(F.col("text")))
    return rt.rerank(hits, TOP, tokens=F.col("tokens"))


def rerank(spark, d):
    hits = _bm25(spark, d, 10).withColumn("score", F.round(1.0 / (rules.RRF_K + F.col("rnk")), 6))
    return _reranked(spark, d, hits)


def _hybrid_hits(spark, d, n):
    """TF-IDF pool fused with the dense pool by passage id."""
    known = src.documents(spark, d).select("doc_id")
    lexical = _tfidf(spark, d, 20).select("item_id", F.col("doc_id").alias("key"), "rnk")
    dense = dense_topk(spark, d).select("item_id", F.col("vec_id").alias("key"), "rnk")
    fused = rt.fuse({"lexical": lexical, "dense": dense}, n)
    return fused.withColumnRenamed("key", "doc_id").join(known, "doc_id", "left_semi")


def hybrid_rerank(spark, d):
    return _reranked(spark, d, _hybrid_hits(spark, d, max(2 * TOP, 10)))


def context_block(spark, d):
    """Prompt block per question: two passages of 500 characters, 1200 in total; and the capped variant."""
    hits = _with_texts(spark, d, _bm25(spark, d, 4))
    stripped = tx.strip(F.col("text"))
    capped = F.when(F.char_length(stripped) > 300, F.concat(F.rtrim(F.substring(stripped, 1, 300)), F.lit("…"))).otherwise(stripped)
    listed = hits.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct(
        "rnk", F.substring("text", 1, 500).alias("short"), F.when(stripped != "", capped).alias("capped")))).alias("p"))
    first_two = F.slice("p", 1, 2)
    total = F.transform(first_two, lambda s, i: F.aggregate(
        F.slice(first_two, F.lit(1), i + 1), F.lit(0), lambda a, x: a + F.char_length(x["short"])))
    kept = F.filter(F.arrays_zip(first_two.alias("s"), total.alias("t")), lambda x: x["t"] <= 1200)
    return listed.select(
        "item_id",
        F.md5(F.array_join(F.transform(kept, lambda x: x["s"]["short"]), "\n\n")).alias("short_block"),
        F.md5(F.array_join(F.array_compact(F.transform("p", lambda x: x["capped"])), "\n\n")).alias("long_block"))


def extractive_answer(spark, d):
    return answers.compose(_with_texts(spark, d, _bm25(spark, d, TOP)))


def relevance_gate(spark, d):
    """Keep the first external hit only when a longer query word occurs in it."""
    hit = top_k(_with_texts(spark, d, _bm25(spark, d, TOP)), ["item_id"], [F.asc("rnk")], 1, "first")
    asked = F.filter(F.split(F.lower("query_text"), r"\s+"), lambda w: F.char_length(w) > 3)
    body = F.lower(F.col("text"))
    return hit.select("item_id", "doc_id", F.exists(asked, lambda w: F.contains(body, w)).alias("relevant"))


QUERIES = {f.__name__: f for f in (
    bm25_stats, bm25_topk, bm25_topk_lang, tfidf_topk, dense_topk, dense_topk_lang, dense_topup, vector_normalise,
    vector_load, rrf_fuse, hybrid_search, rerank, hybrid_rerank, context_block, relevance_gate,
    extractive_answer)}
