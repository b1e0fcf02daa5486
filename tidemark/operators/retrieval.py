"""Sparse, dense and fused retrieval for whole tables of queries."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import text as tx
from tidemark.functions.stem import stem_table, stemmed
from tidemark.operators.blocks import pair_blocks
from tidemark.operators.ordered import top_k
from tidemark.operators.scan import Adjust, best_matches, counted, pack
from tidemark.session import cut, saved

# a term row is some 40 bytes, so this bounds a broadcast to about 80 MB
MAX_BROADCAST_TERMS = 2_000_000


def sized(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side whose row count was measured; otherwise leave the join to shuffle."""
    return F.broadcast(df) if rows <= MAX_BROADCAST_TERMS else df


def among(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed; a short list (it is counted) is broadcast, so that the others are not shuffled."""
    return df.join(sized(ids, ids.count()), key, "left_semi")


# ------------------------------------------------------------------ sparse index
def postings(docs: DataFrame, doc_id: str, tokens: Column, *carry: str) -> DataFrame:
    """(doc, carried columns, dl, term, tf); row-local, documents without tokens drop out."""
    return tx.counted_terms(docs, tokens, doc_id, *carry)


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


@dataclass(frozen=True)
class SparseStats:
    """Corpus statistics of the sparse index: (term, df, idf), document count, mean length."""

    terms: DataFrame
    n: int
    avgdl: float


def build_stats(docs: DataFrame, tokens: Column) -> SparseStats:
    """One pass over the corpus; the vocabulary table is written once and reused.

    Every document has exactly one posting at place 0, so the same grouping also
    yields the number of non-empty documents and their total length.  Negative idf
    values are floored at a share of the mean raw idf over the whole vocabulary.
    """
    per_term = cut(tx.counted_terms(docs, tokens).groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("total"), F.count_if(F.col("place") == 0).alias("docs")))
    whole = per_term.agg(F.sum("docs"), F.sum("total")).first()
    n = whole[0] or 0
    raw = per_term.withColumn("raw", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = (raw.agg(F.avg("raw")).first()[0] or 0.0) * rules.BM25_EPSILON
    idf = raw.select("term", "df", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))
    return SparseStats(idf, n, whole[1] / n if n else 0.0)


def query_terms(queries: DataFrame, query_id: str, tokens: Column, stems: bool = False) -> DataFrame:
    """(query, term, qtf): repeated query tokens count repeatedly; with ``stems`` English queries are stemmed by their ``lang``."""
    if stems:
        asked = tx.counted_terms(queries, tokens, query_id, "lang")
        table = cut(stem_table(asked.where("lang = 'en'").select("term")))
        return stemmed(asked, table, query_id).select(query_id, "term", F.col("tf").alias("qtf"))
    return tx.counted_terms(queries, tokens, query_id).select(query_id, "term", F.col("tf").alias("qtf"))


def _accumulate(weighted: DataFrame, wanted: DataFrame, doc_id: str, query_id: str, carry: list[str],
                n_terms: int) -> DataFrame:
    """Sum the weights of matching terms per (query, document).

    The vocabulary-restricted postings are placed by document once; the join with
    the (measured) query side and the per-pair sum then stay inside a partition,
    so the query x document scores themselves are never shuffled.
    """
    placed = weighted.repartition(doc_id)
    return (
        placed.join(sized(wanted, n_terms), "term")
        .groupBy(query_id, doc_id, *carry)
        .agg(F.sum(F.col("w") * F.col("qtf")).alias("score"))
    )


def bm25_scores(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", query_id: str = "item_id",
                carry: tuple[str, ...] = (), keep: Column | None = None, stats: SparseStats | None = None) -> DataFrame:
    """Okapi BM25 of every (query, document) pair that shares a term.

    ``keep`` restricts the scored documents; statistics always come from all, and
    can be built once with ``build_stats`` for many query tables.
    """
    tokens = tx.index_tokens(F.col("text"))
    stats = stats or build_stats(docs, tokens)
    wanted = query_terms(queries, query_id, tokens)
    n_terms = wanted.count()
    vocabulary = wanted.select("term").distinct()
    idf = stats.terms.select("term", "idf").join(sized(vocabulary, n_terms), "term", "left_semi")
    post = postings(docs if keep is None else docs.where(keep), doc_id, tokens, *carry)
    norm = F.col("tf") + rules.BM25_K1 * (1 - rules.BM25_B + rules.BM25_B * F.col("dl") / F.lit(stats.avgdl))
    weighted = post.join(sized(idf, n_terms), "term").select(
        doc_id, *carry, "term", (F.col("idf") * F.col("tf") * (rules.BM25_K1 + 1) / norm).alias("w"))
    return _accumulate(weighted, wanted, doc_id, query_id, list(carry), n_terms)


def bm25_best(docs: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", query_id: str = "item_id",
              carry: tuple[str, ...] = (), query_carry: tuple[str, ...] = (), adjust: Adjust | None = None) -> DataFrame:
    """(query, document, score): each query's k best by Okapi BM25 above zero, without a row per pair (see ``scan``)."""
    tokens = tx.index_tokens(F.col("text"))
    packed = pack(docs, doc_id, tokens, carry)
    n = packed.filled
    raw = saved(packed.document_frequency().select("term", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")), "terms")
    floor = (raw.agg(F.avg("raw")).first()[0] or 0.0) * rules.BM25_EPSILON
    idf = raw.select("term", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("weight"))
    wanted = saved(counted(queries, query_id, tokens, query_carry), "wanted")
    return best_matches(packed, wanted, idf, k, query_id, packed.tokens / n if n else 1.0, query_carry, carry, adjust=adjust)


def _tfidf_sides(docs: DataFrame, queries: DataFrame, doc_tokens: Column, query_tokens: Column, doc_id: str, query_id: str,
                 carry: tuple[str, ...], stems: bool) -> tuple[int, DataFrame, DataFrame]:
    """(number of documents, their postings, the query terms)."""
    n = docs.agg(F.count("*").alias("n")).scalar()
    lang = ("lang",) if stems else ()
    post = postings(docs, doc_id, doc_tokens, *carry, *lang)
    asked = tx.counted_terms(queries, query_tokens, query_id, *lang)
    if stems:
        english = [x.where("lang = 'en'").select("term") for x in (post, asked)]
        table = cut(stem_table(english[0].union(english[1])))
        table = sized(table, table.count())
        post = stemmed(post, table, doc_id, *carry)
        asked = stemmed(asked, table, query_id)
    return n, post, asked.select(query_id, "term", F.col("tf").alias("qtf"))


def tfidf_best(docs: DataFrame, queries: DataFrame, doc_tokens: Column, query_tokens: Column, doc_id: str, query_id: str, k: int,
               carry: tuple[str, ...] = (), stems: bool = False, group: str | None = None, query_carry: tuple[str, ...] = (),
               adjust: Adjust | None = None) -> DataFrame:
    """(query, document or group, score): a superset of each query's k best by ``tfidf_scores``, without a row per pair (see ``scan``)."""
    wanted = saved(counted(queries, query_id, query_tokens, query_carry, stems), "wanted")
    packed = pack(docs, doc_id, doc_tokens, carry, stems, group, wanted.select("term").distinct())
    weights = packed.document_frequency().select("term", (1 + F.log(packed.n / (1 + F.col("df")))).alias("weight"))
    return best_matches(packed, wanted, weights, k, query_id, None, query_carry, carry, group, adjust)


def tfidf_scores(docs: DataFrame, queries: DataFrame, doc_tokens: Column, query_tokens: Column,
                 doc_id: str, query_id: str, carry: tuple[str, ...] = (), stems: bool = False) -> DataFrame:
    """Sum over query tokens of tf * (1 + ln(N / (1 + df))); with ``stems`` both sides have a ``lang`` and English terms are stemmed."""
    n, post, wanted = _tfidf_sides(docs, queries, doc_tokens, query_tokens, doc_id, query_id, carry, stems)
    n_terms = wanted.count()
    vocabulary = wanted.select("term").distinct()
    freq = document_frequency(post).join(sized(vocabulary, n_terms), "term", "left_semi")
    weighted = post.join(sized(freq, n_terms), "term").select(
        doc_id, *carry, "term", (F.col("tf") * (1 + F.log(n / (1 + F.col("df"))))).alias("w"))
    return _accumulate(weighted, wanted, doc_id, query_id, list(carry), n_terms)


def ranked(scores: DataFrame, k: int, doc_id: str = "doc_id", query_id: str = "item_id",
           floor: float = 0.0) -> DataFrame:
    """Top k per query above a floor; rounded scores with an id tie-break."""
    rounded = scores.withColumn("score", F.round("score", 6)).where(F.col("score") > floor)
    return top_k(rounded, [query_id], [F.desc("score"), F.col(doc_id)], k)


# ------------------------------------------------------------------------- dense
def unit(vector: Column) -> Column:
    """L2-normalised vector in double precision; a zero vector stays zero."""
    wide = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(wide, lambda x: F.when(norm == 0, F.lit(0.0)).otherwise(x / norm))


def cosine(left: Column, right: Column) -> Column:
    """Cosine over the shared length of two vectors; zero when either norm is zero."""
    n = F.least(F.size(left), F.size(right))
    a, b = (F.slice(v.cast("array<double>"), F.lit(1), n) for v in (left, right))

    def total(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)

    na, nb = total(a, a), total(b, b)
    return F.when((na == 0) | (nb == 0), F.lit(0.0)).otherwise(total(a, b) / (F.sqrt(na) * F.sqrt(nb)))


def _matrix(column: pd.Series) -> np.ndarray:
    rows = [np.asarray(v, dtype=np.float64) for v in column]
    m = np.vstack(rows)
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


#: Similarities held at a time by one task.
TILE = 1 << 22


def dense_top(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str = "vec_id", query_id: str = "item_id",
              vector: str = "embedding", query_vector: str = "query", positive: bool = True) -> DataFrame:
    """Exact cosine top k of every query over all vectors.

    Each block pair is one matrix product that returns its own top k, so at most
    k rows per query leave a block; the final ranking sees only those.
    """
    ids = dict((f.name, f.dataType.simpleString()) for f in [*vectors.schema, *queries.schema])
    schema = f"{query_id} {ids[query_id]}, {vec_id} {ids[vec_id]}, score double"

    def kernel(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        block = block[block[vector].map(lambda v: v is not None and len(v) > 0)]
        if block.empty or asked.empty:
            return pd.DataFrame({query_id: [], vec_id: [], "score": []})
        right, block_ids, out = _matrix(block[vector]).T, block[vec_id].to_numpy(), []
        rows = max(1, TILE // len(block))
        for at in range(0, len(asked), rows):  # a tile of similarities at a time
            part = asked.iloc[at : at + rows]
            sims = np.round(_matrix(part[query_vector]) @ right, 6)
            least = np.partition(sims, -k, axis=1)[:, -k] if k < sims.shape[1] else np.full(len(part), -np.inf)
            for name, row, floor in zip(part[query_id], sims, least, strict=True):
                able = np.flatnonzero(row >= floor)
                able = able[np.lexsort((block_ids[able], -row[able]))[:k]]
                out.append((np.repeat(name, len(able)), block_ids[able], row[able]))
        names, found, scores = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({query_id: names, vec_id: found, "score": scores})

    found = pair_blocks(vectors.select(vec_id, vector), queries.select(query_id, query_vector), kernel, schema,
                        vec_id, query_id)
    if positive:
        found = found.where("score > 0")
    return top_k(found, [query_id], [F.desc("score"), F.col(vec_id)], k)


# ------------------------------------------------------------------------ fusion
def fuse(lists: dict[str, DataFrame], k: int, query_id: str = "item_id", key: str = "key") -> DataFrame:
    """Reciprocal-rank fusion of ranked lists given as (query, key, rnk).

    A key twice in one list contributes twice.  Ties: first list's rank, then the
    next list's, then the key.
    """
    union = None
    for name, ranked_list in lists.items():
        part = ranked_list.select(query_id, key, F.col("rnk").alias("_rank"), F.lit(name).alias("_src"))
        union = part if union is None else union.unionByName(part)
    fused = union.groupBy(query_id, key).agg(
        F.round(F.sum(1.0 / (rules.RRF_K + F.col("_rank"))), 6).alias("score"),
        *[F.min(F.when(F.col("_src") == n, F.col("_rank"))).alias(f"{n}_rank") for n in lists],
    )
    order = [F.desc("score"), *[F.asc_nulls_last(f"{n}_rank") for n in lists], F.col(key)]
    return top_k(fused, [query_id], order, k)


def passage_key(text: Column) -> Column:
    """What makes two hits the same passage: the whole text."""
    return F.md5(text)


def top_up(filtered: DataFrame, general: DataFrame, wanted: int, query_id: str = "item_id") -> DataFrame:
    """Extend under-filled filtered lists with general hits whose key is new.

    Both inputs are (query, key, doc_id, rnk); general hits keep their order and
    follow the filtered ones.
    """
    both = filtered.withColumn("_extra", F.lit(0)).unionByName(general.withColumn("_extra", F.lit(1)))
    per_query = W.partitionBy(query_id)
    per_key = W.partitionBy(query_id, "key")
    kept = (
        both.withColumn("_have", F.sum(1 - F.col("_extra")).over(per_query))
        .withColumn("_seen", F.min("_extra").over(per_key))
        .withColumn("_first", F.row_number().over(per_key.orderBy("_extra", "rnk")))
        .where((F.col("_extra") == 0)
               | ((F.col("_have") < wanted) & (F.col("_seen") == 1) & (F.col("_first") == 1)))
    )
    order = W.partitionBy(query_id).orderBy("_extra", "rnk")
    return kept.withColumn("rnk", F.row_number().over(order)).drop("_have", "_seen", "_first", "_extra")


# ------------------------------------------------------------------------ rerank
def rerank_tokens(text: Column) -> Column:
    return tx.content_tokens(text, 3, rules.RERANK_STOP)


def rerank(candidates: DataFrame, k: int, query_id: str = "item_id", doc_id: str = "doc_id",
           query_text: str = "query_text", text: str = "text", score: str = "score", tokens: Column | None = None) -> DataFrame:
    """Candidate-set idf reranking; queries without usable terms keep input order (``rnk``).

    ``tokens`` are the ``rerank_tokens`` of the text where they were worked out before, once for all queries of a document.
    """
    asked = F.array_distinct(tx.content_tokens(F.col(query_text), 3, rules.RERANK_STOP))
    have = rerank_tokens(F.col(text)) if tokens is None else tokens
    given = tx.computed(candidates, query_id, doc_id, score, "rnk", _asked=asked, _have=have)
    base = given.select(
        query_id, doc_id, F.col(score).alias("fused"), F.col("rnk").alias("input_rank"),
        F.size("_asked").alias("_nq"), F.size("_have").alias("_len"), F.array_intersect("_have", "_asked").alias("_hit"),
    ).withColumn("_n", F.count("*").over(W.partitionBy(query_id)))
    terms = base.select("*", F.size("_hit").alias("_nhit"), F.explode_outer("_hit").alias("_term"))
    df = F.count("*").over(W.partitionBy(query_id, "_term"))
    weight = F.when(F.col("_term").isNotNull(), F.log(1 + F.col("_n") / (1 + df)))
    scored = terms.withColumn("_w", weight).groupBy(
        query_id, doc_id, "fused", "input_rank", "_nq", "_len", "_nhit"
    ).agg(F.coalesce(F.sum("_w"), F.lit(0.0)).alias("_overlap"))
    coverage = F.when(F.col("_nq") > 0, F.col("_nhit") / F.col("_nq")).otherwise(0.0)
    value = (1 + 2 * F.col("fused")) * (1 + coverage) * F.col("_overlap") / (1 + F.log(1 + F.col("_len")))
    out = scored.select(
        query_id, doc_id, "input_rank",
        F.round(F.when(F.col("_nq") > 0, value).otherwise(0.0), 6).alias("rerank_score"),
        F.round(coverage, 6).alias("coverage"),
    )
    return top_k(out, [query_id], [F.desc("rerank_score"), F.col("input_rank")], k).drop("input_rank")
