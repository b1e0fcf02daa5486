"""Persisted retrieval stores that read only the blocks that can reach a query's k-th score.

A store is a Parquet table partitioned by language whose rows are blocks of packed documents or vectors. A query is answered
in two phases. Block bounds (sparse: the largest impact of each term in the block; dense: the least angle to the block's
centre and its radius) give an upper bound for every (query, block). The block with the best bound is scored first and gives a
k-th score; of the other blocks only those whose bound reaches it are read and scored. Blocks are scored inside a task and
return k rows for each query, so neither the (query, document) pairs that share a term nor all similarities are ever rows.
Both phases are exact. Queries of one block are scored in slices of bounded length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import text as tx
from tidemark.functions.slices import slices
from tidemark.functions.stem import stemmed_words
from tidemark.operators.ordered import top_k
from tidemark.session import arrow_batches, cut, saved

BLOCK_DOCS, BLOCK_TOKENS = 1024, 400_000
BLOCK_VECTORS, SAMPLE_VECTORS = 1024, 4096
#: Blocks are some MB each: so much of them reaches a Python worker at a time.
BATCH = "8m"
#: Queries of one block that are scored together.
SLICE = 1024
#: Broadcast bounds: rows of (query, term), of (block, queries with their vectors) and of (block, queries); all were counted.
MAX_TERMS, MAX_ASKED, MAX_SHORT = 1_000_000, 2_000, 20_000
DIGITS = 6


def _sized(df: DataFrame, rows: int, bound: int) -> DataFrame:
    return F.broadcast(df) if rows <= bound else df


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of the given ranges, one after the other."""
    sizes = ends - starts
    return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())


def _best(scores: np.ndarray, ids: np.ndarray, k: int, floor: float) -> np.ndarray:
    """Places of the k best rounded scores above the floor, ties by id."""
    able = np.flatnonzero(scores > floor)
    if len(able) > k:
        able = able[scores[able] >= np.partition(scores[able], len(able) - k)[len(able) - k]]
    return able[np.lexsort((ids[able], -scores[able]))][:k]


def _two_phase(bounds: DataFrame, scored: Callable[[DataFrame], DataFrame], keys: list[str], k: int, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """(ranked lists, pairs read): ``bounds`` has the keys of a list, lang, block and ``most``; ``scored`` answers such pairs."""
    with arrow_batches(bounds.sparkSession, BATCH):
        return _answered(cut(bounds), scored, keys, k, doc_id)


def _answered(bounds: DataFrame, scored: Callable[[DataFrame], DataFrame], keys: list[str], k: int, doc_id: str) -> tuple[DataFrame, DataFrame]:
    first = cut(bounds.groupBy(*keys).agg(F.max_by(F.struct("lang", "block"), F.struct("most", "block")).alias("b")).select(*keys, "b.lang", "b.block"))
    found = cut(scored(first))
    kth = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k).drop("n")
    same = F.col("lang").eqNullSafe(F.col("l")) & (F.col("block") == F.col("b"))
    for c in keys:
        same &= F.col(c) == F.col(f"_{c}")
    seen = first.select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("lang").alias("l"), F.col("block").alias("b"))
    rest = bounds.join(kth, keys, "left").where(F.col("kth").isNull() | (F.col("most") >= F.col("kth") - 10.0**-DIGITS)).join(seen, same, "left_anti")
    rest = cut(rest.select(*keys, "lang", "block"))
    both = found.unionByName(scored(rest)) if rest.limit(1).count() else found
    return cut(top_k(both, keys, [F.desc("score"), F.col(doc_id)], k)), first.unionByName(rest)


# ------------------------------------------------------------------------ sparse
@dataclass(frozen=True)
class Sparse:
    """Packed postings (``blocks``), largest gain of each term in each block (``tops``), and a weight for each term.

    A posting adds weight(term) * gain(tf, length); the gain is that of Okapi BM25, or tf itself where ``mean`` is None.
    """

    blocks: DataFrame
    tops: DataFrame
    weights: DataFrame
    mean: float | None
    n: int


def _gain(tf: np.ndarray, length: np.ndarray, mean: float | None) -> np.ndarray:
    if mean is None:
        return tf.astype(np.float64)
    return tf * (rules.BM25_K1 + 1) / (tf + rules.BM25_K1 * (1 - rules.BM25_B + rules.BM25_B * length / mean))


_BLOCK = "lang string, block bigint, docs array<bigint>, lengths array<int>, terms array<string>, starts array<int>, places array<int>, tfs array<int>"
_TOPS = "tops array<double>, dfs array<int>"
_KERNEL = [c.split()[0] for c in _BLOCK.split(", ")]


def _pack(group: pa.Table) -> pa.Table:
    """Documents of one block -> one row: terms in order, their postings one after the other."""
    return _packed(group, False)


def _packed(group: pa.Table, stems: bool) -> pa.Table:
    group = group.combine_chunks()
    listed = group.column("tokens").combine_chunks()
    coded = listed.flatten().dictionary_encode()
    if stems:
        by_word = stemmed_words(coded.dictionary).dictionary_encode()
        coded = pa.DictionaryArray.from_arrays(by_word.indices.take(coded.indices), by_word.dictionary)
    names = coded.dictionary.cast(pa.utf8())
    order = pc.array_sort_indices(names).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    lengths = pc.list_value_length(listed).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    both, tf = np.unique(rank[coded.indices.to_numpy(zero_copy_only=False)] * len(lengths) + doc, return_counts=True)
    term, place = both // len(lengths), both % len(lengths)
    starts = np.searchsorted(term, np.arange(len(order) + 1))
    lists = [group.column("doc").combine_chunks(), pa.array(lengths, pa.int32()), names.take(pa.array(order)), *(pa.array(x, pa.int32()) for x in (starts, place, tf))]
    one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
    return pa.table([group.column("lang").slice(0, 1), group.column("block").slice(0, 1), *one],
                    names=["lang", "block", "docs", "lengths", "terms", "starts", "places", "tfs"])


def _packer(mean: float | None, stems: bool) -> Callable:
    """Packs a block, with the largest gain and the number of documents of each of its terms.

    With ``stems`` the words of an English block are replaced by their stems.
    """
    def pack(group: pa.Table) -> pa.Table:
        packed = _packed(group, stems and group.column("lang")[0].as_py() == "en")
        block = _Block(packed.to_batches()[0], mean)
        tops = np.maximum.reduceat(block.gain, block.starts[:-1]) if len(block.gain) else np.zeros(0)
        for name, x in (("tops", pa.array(tops)), ("dfs", pa.array(np.diff(block.starts), pa.int32()))):
            packed = packed.append_column(name, pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x))
        return packed
    return pack


class _Block:
    """A block row as arrays."""

    def __init__(self, row: pa.RecordBatch, mean: float | None) -> None:
        def values(name: str) -> pa.Array:
            return row.column(row.schema.get_field_index(name)).flatten()

        self.lang, self.number = row.column(row.schema.get_field_index("lang"))[0].as_py(), row.column(row.schema.get_field_index("block"))[0].as_py()
        self.docs, self.terms = values("docs").to_numpy(), values("terms").cast(pa.string())
        self.starts, self.places = values("starts").to_numpy().astype(np.int64), values("places").to_numpy()
        self.gain = _gain(values("tfs").to_numpy().astype(np.float64), values("lengths").to_numpy()[self.places], mean)


def build_sparse(docs: DataFrame, tokens: Column, doc_id: str = "doc_id", bm25: bool = True, stems: bool = False) -> Sparse:
    """A store over (id, text columns, lang); a document is tokenised once, and shuffled once to its block.

    With ``stems`` the words of English blocks are stemmed, each word of a block once.

    Without ``bm25`` term weights are 1 + ln(N / (1 + df)) over all documents, else the floored idf over documents with tokens.
    """
    split = tx.computed(docs.withColumn("doc", F.col(doc_id).cast("long")), "doc", "lang", tokens=tokens)
    full = cut(split.where(F.size("tokens") > 0).select("doc", F.col("lang").cast("string"), "tokens"))
    n, total = full.agg(F.count(F.lit(1)), F.sum(F.size("tokens").cast("long"))).first()
    count = max(1, math.ceil(max(n / BLOCK_DOCS, (total or 0) / BLOCK_TOKENS)))
    dealt = full.select("lang", F.pmod(F.xxhash64("doc"), F.lit(count)).alias("block"), "doc", "tokens")
    mean = total / n if n and bm25 else None
    blocks = saved(dealt.groupBy("lang", "block").applyInArrow(_packer(mean, stems), f"{_BLOCK}, {_TOPS}"), "postings", "lang")
    tops = blocks.select("lang", "block", F.explode(F.arrays_zip("terms", "tops", "dfs")).alias("t")).select(
        "lang", "block", F.col("t.terms").alias("term"), F.col("t.tops").alias("top"), F.col("t.dfs").alias("df"))
    if bm25:
        raw = cut(_df(tops).select("term", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")))
        floor = rules.BM25_EPSILON * (raw.agg(F.avg("raw")).first()[0] or 0.0)
        weights = raw.select("term", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("weight"))
    else:
        n = docs.count()
        weights = _tfidf_weights(tops, n)
    return Sparse(blocks.select(*_KERNEL), tops, weights, mean, n)


def _df(tops: DataFrame) -> DataFrame:
    return tops.groupBy("term").agg(F.sum("df").alias("df"))


def _tfidf_weights(tops: DataFrame, n: int) -> DataFrame:
    return _df(tops).select("term", (1 + F.log(n / (1 + F.col("df")))).alias("weight"))


def narrowed(store: Sparse, queries: DataFrame) -> Sparse:
    """The store with the impacts of the terms of ``queries`` only, read once for all lists of these queries."""
    words = cut(queries.select("term").distinct())
    tops = cut(store.tops.join(_sized(words, words.count(), MAX_TERMS), "term", "left_semi"))
    return replace(store, tops=tops, weights=store.weights if store.mean is not None else _tfidf_weights(tops, store.n))


@dataclass(frozen=True)
class _Vectors:
    """Query vectors that were counted to be few: each query's terms are ``codes[edges[i]:edges[i + 1]]``, places in ``words``."""

    ids: pa.Array
    words: pa.Array
    edges: np.ndarray
    codes: np.ndarray
    weights: np.ndarray


def _vectors(terms: pa.Table, query_id: str) -> _Vectors:
    terms = terms.sort_by([(query_id, "ascending"), ("term", "ascending")]).combine_chunks()
    ids, coded = (terms.column(c).combine_chunks().dictionary_encode() for c in (query_id, "term"))
    edges = np.searchsorted(ids.indices.to_numpy(), np.arange(len(ids.dictionary) + 1))
    return _Vectors(ids.dictionary, coded.dictionary, edges, coded.indices.to_numpy(), terms.column("w").to_numpy())


def _sparse_kernel(mean: float | None, k: int, floor: float, names: list[str], types: list[pa.DataType], shipped: Broadcast | None) -> Callable:
    """Scores the ``asked`` queries of a block; they hold their vectors, or are names of ``shipped`` ones."""
    def vectors_of(block: _Block, asked: pa.Array) -> tuple[pa.Array, Iterator[tuple[np.ndarray, np.ndarray]]]:
        if shipped:
            v = shipped.value
            at = pc.index_in(v.words, block.terms).fill_null(-1).to_numpy(zero_copy_only=False)
            rows = pc.index_in(asked, v.ids).to_numpy(zero_copy_only=False)
            return asked, ((at[v.codes[v.edges[i] : v.edges[i + 1]]], v.weights[v.edges[i] : v.edges[i + 1]]) for i in rows)
        what = asked.field("v")
        edge = np.concatenate([[0], np.cumsum(pc.list_value_length(what).to_numpy(zero_copy_only=False))])
        flat = what.flatten()
        at = pc.index_in(flat.field("term"), block.terms).fill_null(-1).to_numpy(zero_copy_only=False)
        w = flat.field("w").to_numpy(zero_copy_only=False)
        return asked.field("query"), ((at[edge[i] : edge[i + 1]], w[edge[i] : edge[i + 1]]) for i in range(len(asked)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in slices(batch, 1):
                block = _Block(row, mean)
                who, vectors = vectors_of(block, row.column(row.schema.get_field_index("asked")).flatten())
                out = []
                for i, (mine, weight) in enumerate(vectors):
                    mine, weight = mine[mine >= 0], weight[mine >= 0]
                    first, last = block.starts[mine], block.starts[mine + 1]
                    posting = _ranges(first, last)
                    score = np.bincount(block.places[posting], np.repeat(weight, last - first) * block.gain[posting], len(block.docs))
                    met = np.zeros(len(block.docs), bool)
                    met[block.places[posting]] = True
                    score = np.where(met, np.round(score, DIGITS), -np.inf)
                    best = _best(score, block.docs, k, floor)
                    out.append((np.full(len(best), i), block.docs[best], score[best]))
                if out:
                    q, d, s = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([who.take(pa.array(q)).cast(types[0]), pa.array(d, pa.int64()), pa.array(s, pa.float64())], names=names)
    return run


def sparse_lists(store: Sparse, queries: DataFrame, k: int, query_id: str = "item_id", doc_id: str = "doc_id", keep: Column | None = None,
                 floor: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """((query, doc, score, rnk), (query, lang, block) pairs read) for queries given as (query, term, qtf).

    ``keep`` is a condition on ``lang``; it prunes the partitions of both tables. Vectors of a bounded number of terms are
    shipped to the tasks once; more of them travel with the blocks that they ask.
    """
    terms = cut(queries.join(store.weights, "term").select(query_id, "term", (F.col("qtf") * F.col("weight")).alias("w")))
    n_terms = terms.count()
    tops, blocks = (store.tops, store.blocks) if keep is None else (store.tops.where(keep), store.blocks.where(keep))
    bounds = tops.join(_sized(terms, n_terms, MAX_TERMS), "term").groupBy(query_id, "lang", "block").agg(
        F.sum(F.greatest(F.col("w"), F.lit(0.0)) * F.col("top")).alias("most"))
    kind = dict(queries.dtypes)[query_id]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    shipped = terms.sparkSession.sparkContext.broadcast(_vectors(terms.toArrow(), query_id)) if n_terms <= MAX_TERMS else None
    vectors = terms.groupBy(query_id).agg(F.collect_list(F.struct("term", "w")).alias("v"))

    def scored(pairs: DataFrame) -> DataFrame:
        asked = pairs.withColumn("part", F.pmod(F.xxhash64(query_id), F.lit(1 + n_terms // (64 * SLICE))))
        if shipped:
            one = F.col(query_id)
        else:
            asked, one = asked.join(vectors, query_id), F.struct(F.col(query_id).alias("query"), "v")
        asked = cut(asked.groupBy("lang", "block", "part").agg(F.collect_list(one).alias("asked")))
        side = asked.select(F.col("lang").alias("l"), F.col("block").alias("b"), "asked")
        # without vectors a row is some bytes a query
        side = _sized(side, asked.count(), MAX_SHORT if shipped else MAX_ASKED)
        met = blocks.join(side, F.col("lang").eqNullSafe(F.col("l")) & (F.col("block") == F.col("b"))).drop("l", "b")
        return met.mapInArrow(_sparse_kernel(store.mean, k, floor, [query_id, doc_id, "score"], [arrow], shipped),
                              f"{query_id} {kind}, {doc_id} bigint, score double")

    return _two_phase(bounds, scored, [query_id], k, doc_id)


# ------------------------------------------------------------------------- dense
@dataclass(frozen=True)
class Dense:
    """Unit vectors packed by their nearest centre and language; ``centres`` are rows of a bounded sample."""

    blocks: DataFrame
    caps: DataFrame
    centres: np.ndarray


def _unit(m: np.ndarray) -> np.ndarray:
    norms = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def _matrix(listed: pa.Array, dim: int) -> np.ndarray:
    return listed.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def build_dense(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> Dense:
    """A store over (id, vector, lang). Null and empty vectors drop out; all others have one length."""
    kind = dict(vectors.dtypes)[vector]
    given = vectors.where(F.size(vector) > 0).select(F.col(vec_id).cast("long").alias("id"), F.col("lang").cast("string"),
                                                     F.col(vector).cast(kind if kind == "array<float>" else "array<double>").alias("v"))
    n = given.count()
    wanted = min(SAMPLE_VECTORS, max(1, math.ceil(n / BLOCK_VECTORS)))
    sample = given.orderBy(F.xxhash64("id"), "id").limit(wanted).toArrow().column("v").combine_chunks()
    dim = len(sample[0]) if len(sample) else 1
    centres = _unit(_matrix(sample, dim)) if len(sample) else np.zeros((1, 1))
    parts = max(1, math.ceil(n / BLOCK_VECTORS / len(centres)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest = np.concatenate([(_unit(_matrix(v, dim)) @ centres.T).argmax(axis=1) for v in slices(batch.column(2), BLOCK_VECTORS)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest, pa.int64())], names=["id", "lang", "v", "centre"])

    def pack(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        x = _unit(_matrix(group.column("v").combine_chunks(), dim))
        c = centres[group.column("centre")[0].as_py()]
        lively = (x * x).sum(axis=1) > 0
        radius = float(np.arccos(np.clip((x[lively] @ c).min(), -1, 1))) if lively.any() else 0.0
        return pa.table([pa.array([group.column("lang")[0].as_py()], pa.string()), pa.array([group.column("block")[0].as_py()], pa.int64()),
                         pa.array([group.column("centre")[0].as_py()], pa.int64()), pa.array([radius]), pa.array([bool((~lively).any() or not c.any())]),
                         pa.array([group.column("id").to_numpy()], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary())],
                        names=["lang", "block", "centre", "radius", "zero", "ids", "x"])

    at = given.mapInArrow(place, f"id bigint, lang string, v {dict(given.dtypes)['v']}, centre bigint")
    at = at.withColumn("block", F.col("centre") * parts + F.pmod(F.xxhash64("id"), F.lit(parts)))
    packed = at.groupBy("lang", "block").applyInArrow(pack, "lang string, block bigint, centre bigint, radius double, zero boolean, ids array<bigint>, x binary")
    blocks = saved(packed, "vectors", "lang")
    return Dense(blocks, blocks.select("lang", "block", "centre", "radius", "zero"), centres)


def dense_lists(store: Dense, queries: DataFrame, k: int | Column, keep: dict[str, Column] | None = None, most: int | None = None, query_id: str = "item_id",
                vec_id: str = "vec_id", query: str = "query", floor: float = -math.inf) -> tuple[DataFrame, DataFrame]:
    """((query, list, vec, score, rnk), (query, list, lang, block) read): exact cosine top k of every named list in one pass.

    ``keep`` gives each list a condition on the vector's ``lang`` and the query's columns, null meaning no; ``k`` may depend
    on the query (``most`` is then its largest value).
    """
    named, queries = keep or {"all": F.lit(True)}, queries.where(F.size(query) > 0)
    top = most or k
    if not store.centres.any() and not store.blocks.limit(1).count():
        none = queries.select(query_id, F.lit("").alias("list"), F.lit(0).cast("long").alias(vec_id), F.lit(0.0).alias("score"), F.lit(0).alias("rnk")).limit(0)
        return none, none.select(query_id, "list", F.lit("").alias("lang"), F.lit(0).cast("long").alias("block"))
    kind = dict(queries.dtypes)[query_id]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    dim, centres = store.centres.shape[1], store.centres
    others = [c for c in queries.columns if c not in (query_id, query)]

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _unit(_matrix(batch.column(1), dim))
            near = np.where(q.any(axis=1, keepdims=True), np.clip(q @ centres.T, -1, 1), 2.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(near), pa.list_(pa.float64()))], names=[query_id, "near"])

    lists = F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in named.items()]))).alias("list")
    near = queries.select(query_id, query).mapInArrow(angles, f"{query_id} {kind}, near array<double>").select(query_id, F.posexplode("near").alias("centre", "cosine"))
    met = near.withColumn("centre", F.col("centre").cast("long")).join(store.caps, "centre").join(queries.select(query_id, *others), query_id)
    # cosine 2 to the centres marks a zero query: its scores are all zero
    bound = F.when(F.col("cosine") > 1, 0.0).otherwise(F.cos(F.greatest(F.lit(0.0), F.acos("cosine") - F.col("radius") - 1e-7)))
    bounds = met.select(query_id, lists, "lang", "block", F.when(F.col("zero"), F.greatest(bound, F.lit(0.0))).otherwise(bound).alias("most"))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(i).slice(r, 1) for i, n in enumerate(batch.schema.names)}
                ids = row["ids"].flatten().to_numpy()
                x = np.frombuffer(row["x"][0].as_py(), np.float64).reshape(-1, dim)
                asked = row["asked"].flatten()
                scores = np.round(_unit(_matrix(asked.field("q"), dim)) @ x.T, DIGITS)
                best = [_best(s, ids, top, floor) for s in scores]
                who = pa.array(np.repeat(np.arange(len(best)), [len(b) for b in best]))
                yield pa.RecordBatch.from_arrays(
                    [asked.field("query").take(who).cast(arrow), asked.field("list").take(who).cast(pa.string()), pa.array(np.concatenate([ids[b] for b in best]), pa.int64()),
                     pa.array(np.concatenate([s[b] for s, b in zip(scores, best, strict=True)]))], names=[query_id, "list", vec_id, "score"])

    def scored(pairs: DataFrame) -> DataFrame:
        asked = pairs.join(queries.select(query_id, F.col(query).alias("q")), query_id).withColumn("part", F.pmod(F.xxhash64(query_id), F.lit(slices)))
        asked = cut(asked.groupBy("lang", "block", "part").agg(F.collect_list(F.struct(F.col(query_id).alias("query"), "list", "q")).alias("asked")))
        side = _sized(asked.select(F.col("lang").alias("l"), F.col("block").alias("b"), "asked"), asked.count(), MAX_ASKED)
        read = store.blocks.join(side, F.col("lang").eqNullSafe(F.col("l")) & (F.col("block") == F.col("b"))).select("ids", "x", "asked")
        return read.mapInArrow(kernel, f"{query_id} {kind}, list string, {vec_id} bigint, score double")

    slices = 1 + queries.count() // SLICE
    ranked, read = _two_phase(bounds, scored, [query_id, "list"], top, vec_id)
    if isinstance(k, Column):
        ranked = ranked.join(queries.select(query_id, *others), query_id).where(F.col("rnk") <= k).drop(*others)
    return ranked, read
