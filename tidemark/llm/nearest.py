"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing with exact distances.

Vectors are scaled by the greatest norm and lengthened by one component to unit length, which turns the largest inner product
into the smallest Euclidean distance. Each of ``TABLES`` tables hashes a vector to the cells of some Gaussian (2-stable)
projections. A query visits its own and perturbed cells in falling order of their estimated success (the chance that a
neighbour at the usual distance of the k-th one lies there) until the chances add up to ``TARGET``; there is no cap on visits.
The usual distance comes from ``SAMPLE`` queries compared with all rows; every row is indexed. Cells are dealt to regions, and
cells, queries and regions of any size are met block by block: rows of a region with the queries that visit it, both in slices
of at most about ``BLOCK_ROWS`` and ``BLOCK_QUERIES``. A block computes inner products of visited rows only and returns its
k best for each query, and of these only rows that are not far behind the k-th ones of the whole sample; the tables' candidates
are merged by exact inner products, summed in order of the components in double precision. Queries left with fewer than k rows
are compared with all rows, again in blocks and without that bar, so it costs none of their neighbours.

Vectors that are null, zero, or hold null or non-finite components take no part. A vector meets vectors of its own length only.
Repeated rows each count; a row is no candidate of its own. Ties go to the smaller id, null ids last. Rows whose ``is_query``
is null ask nothing. Other columns are not read. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import shingles
from tidemark.llm.common import sized, stage

K, TABLES, TARGET, SAMPLE = 20, 2, 0.8, 64
#: Cell width in usual distances; the usual distance is this quantile of the sample's.
WIDTH, QUANTILE, LEAST_DISTANCE = 2.5, 0.9, 0.02
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048
BROADCAST_REGIONS = 500_000
_PAIRS = 1 << 16
_FOUND = "query bigint, query_id bigint, row bigint, vec_id bigint, score double"


@dataclass
class Index:
    """What all tasks hash by: the same for every row, drawn from fixed seeds."""

    functions: int
    largest: float
    distance: float
    regions: int
    _drawn: dict = field(default_factory=dict)

    def drawn(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        """Directions (component, table, function) and offsets in cells (table, function)."""
        if dim not in self._drawn:
            rng = np.random.default_rng([dim, self.functions])
            self._drawn[dim] = rng.normal(size=(dim + 1, TABLES, self.functions)), rng.random((TABLES, self.functions))
        return self._drawn[dim]

    def places(self, vectors: np.ndarray, query: bool) -> np.ndarray:
        """Projections in units of a cell: (row, table, function)."""
        norms = _norms(vectors)
        if query:
            unit, more = vectors / norms[:, None], np.zeros(len(vectors))
        else:
            unit = vectors / self.largest
            more = np.sqrt(np.maximum(0.0, 1.0 - (norms / self.largest) ** 2))
        a, b = self.drawn(vectors.shape[1])
        return np.einsum("nd,dtf->ntf", np.column_stack([unit, more]), a) / (WIDTH * self.distance) + b


def _norms(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(axis=1)
    return top * np.sqrt(((vectors / top[:, None]) ** 2).sum(axis=1))


def bucket(cells: np.ndarray) -> np.ndarray:
    """64 bits for a cell (last axis: functions); cells that share them are visited together."""
    h = np.zeros(cells.shape[:-1], np.uint64)
    for i in range(cells.shape[-1]):
        h = shingles.mix(h + np.uint64(0x9E3779B97F4A7C15) + cells[..., i].astype(np.int64).view(np.uint64))
    return h.view(np.int64)


def _below(x: float) -> float:
    return 0.5 * (1.0 + math.erf(x / math.sqrt(2.0)))


def visits(place: np.ndarray, target: float) -> tuple[np.ndarray, np.ndarray]:
    """Cells by falling estimated success until it adds up to ``target``, and the estimates."""
    spread = 1.0 / WIDTH
    slack = 1.0 - (1.0 - target) / (2 * len(place))
    cells, chance = np.zeros((1, 0), np.int64), np.ones(1)
    for p in place:
        near = np.arange(math.floor(p - 4 * spread), math.floor(p + 4 * spread) + 1)
        edges = np.array([_below((k - p) / spread) for k in [*near, near[-1] + 1]])
        both = np.multiply.outer(chance, np.diff(edges)).ravel()
        order = np.argsort(-both, kind="stable")
        gathered = np.cumsum(both[order])
        order = order[: np.searchsorted(gathered, slack * gathered[-1]) + 1]
        cells = np.column_stack([cells[order // len(near)], near[order % len(near)]])
        chance = both[order]
    n = np.searchsorted(np.cumsum(chance), target) + 1
    return cells[:n], chance[:n]


def _matrices(batches: Iterator[pa.RecordBatch], column: str = "v") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches with vectors of one length."""
    for batch in batches:
        listed = batch.column(batch.schema.get_field_index(column))
        sizes = np.diff(listed.offsets.to_numpy())
        for dim in np.unique(sizes):
            part = batch.filter(pa.array(sizes == dim))
            yield part, _matrix(part.column(part.schema.get_field_index(column)), int(dim))


def _matrix(listed: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    listed = listed.combine_chunks() if isinstance(listed, pa.ChunkedArray) else listed
    return listed.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _hashed(index: Index) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches):
            codes = bucket(np.floor(index.places(x, False)))
            for t in range(TABLES):
                region = codes[:, t] % index.regions
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(x), t)), pa.array(region), pa.array(codes[:, t]), *(part.column(part.schema.get_field_index(c)) for c in ("row", "id", "v"))],
                    names=["t", "region", "bucket", "row", "id", "v"])
    return run


def _probed(index: Index, target: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches):
            owner, table, region, listed = [], [], [], []
            for i, place in enumerate(index.places(x, True)):
                for t in range(TABLES):
                    codes = np.unique(bucket(visits(place[t], target)[0]))
                    home = codes % index.regions
                    order = np.argsort(home, kind="stable")
                    first = np.flatnonzero(np.diff(home[order], prepend=-1))
                    for mine in np.split(codes[order], first[1:]):
                        owner.append(i)
                        table.append(t)
                        region.append(mine[0] % index.regions)
                        listed.append(mine)
            rows = pa.array(owner, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(table, pa.int64()), pa.array(region, pa.int64()), pa.array(listed, pa.list_(pa.int64())),
                 *(part.column(part.schema.get_field_index(c)).take(rows) for c in ("row", "id", "v"))],
                names=["t", "region", "buckets", "row", "id", "v"])
    return run


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def _block(k: int, bar: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best visited rows of the block for each of its queries, of rows whose product with the unit query is ``bar`` at least."""
    names = ["query", "query_id", "row", "vec_id", "score"]
    types = [pa.int64()] * 4 + [pa.float64()]

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        parts = []
        if rows.num_rows and queries.num_rows:
            dim = rows.column("dim")[0].as_py()
            x, q = _matrix(rows.column("v"), dim), _matrix(queries.column("v"), dim)
            row, ids = rows.column("row").to_numpy(), rows.column("id").fill_null(np.iinfo(np.int64).max).to_numpy()
            known, cell = np.unique(rows.column("bucket").to_numpy(), return_inverse=True)
            sought, asked = queries.column("buckets").to_pylist(), queries.column("row").to_numpy()
            largest = _norms(x).max()
            step = max(1, (4 << 20) // len(x))
            for lo in range(0, len(q), step):
                mine = q[lo : lo + step]
                open_ = np.zeros((len(mine), len(known)), bool)
                for i, codes in enumerate(sought[lo : lo + step]):
                    if codes is None:
                        open_[i] = True
                    else:
                        at = np.searchsorted(known, codes)
                        at = at[(at < len(known)) & (known[np.minimum(at, len(known) - 1)] == codes)]
                        open_[i, at] = True
                visited = open_[:, cell] & (asked[lo : lo + step, None] != row[None, :])
                rough = np.where(visited, mine @ x.T, -np.inf)
                norms = _norms(mine)
                least = bar * norms
                if len(x) > k:
                    least = np.maximum(least, np.partition(rough, len(x) - k, axis=1)[:, len(x) - k] - 1e-9 * largest * norms)
                qi, xi = np.nonzero(visited & (rough >= least[:, None]))
                score = np.concatenate([np.zeros(0), *(_in_order(mine[qi[j : j + _PAIRS]], x[xi[j : j + _PAIRS]]) for j in range(0, len(qi), _PAIRS))])
                order = np.lexsort((row[xi], ids[xi], -score, qi))
                qi, xi, score = qi[order], xi[order], score[order]
                start = np.searchsorted(qi, qi)
                best = np.arange(len(qi)) - start < k
                qi, xi, score = pa.array(qi[best] + lo), pa.array(xi[best]), score[best]
                parts.append(pa.table([queries.column("row").take(qi), queries.column("id").take(qi), rows.column("row").take(xi), rows.column("id").take(xi),
                                       pa.chunked_array([pa.array(score)])], names=names))
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], t) for t in types], names=names)
    return run


def _met(rows: DataFrame, queries: DataFrame, k: int, bar: float = -math.inf) -> DataFrame:
    """Every query row with the rows of its table and region, in blocks of slices of both; k best of each block."""
    keys = ["t", "region", "dim"]
    rows, queries = (d.withColumn("dim", F.size("v")) for d in (rows, queries))
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(queries.groupBy(*keys).agg(F.count(F.lit(1)).alias("asked")), keys)
    cuts = sized(stage(counts.select(*keys, F.ceil(F.col("n") / BLOCK_ROWS).alias("rs"), F.ceil(F.col("asked") / BLOCK_QUERIES).alias("qs")), "slices"), BROADCAST_REGIONS)

    def dealt(side: DataFrame, own: str, others: str) -> DataFrame:
        mine = F.pmod(F.xxhash64("row"), F.col(own)).alias(own)
        return side.join(cuts, keys).select(*side.columns, mine, F.explode(F.sequence(F.lit(0).cast("long"), F.col(others) - 1)).alias(others))

    by = [*keys, "rs", "qs"]
    return dealt(rows, "rs", "qs").groupBy(*by).cogroup(dealt(queries, "qs", "rs").groupBy(*by)).applyInArrow(_block(k, bar), _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.dropDuplicates(["query", "row"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _usual(rows: DataFrame, queries: DataFrame, largest: float, k: int, quantile: float) -> tuple[float, float]:
    """From a bounded sample of queries compared with all rows: the distance of the k-th neighbour that the given share does
    not exceed, and a product with the unit query that k neighbours of nearly every query pass."""
    picked = queries.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).toArrow()
    listed = list(zip(picked.column("row").to_pylist(), [np.array(v, np.float64) for v in picked.column("v").to_pylist()], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for part, x in _matrices(batches):
            row = part.column(part.schema.get_field_index("row")).to_numpy()
            for r, v in listed:
                if len(v) == x.shape[1]:
                    best[r] = -np.sort(-np.concatenate([best.get(r, np.zeros(0)), (x @ v)[row != r]]))[:k]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([r for r, s in best.items() for _ in s], pa.int64()), pa.array(np.concatenate(list(best.values())))], names=["row", "score"])

    scores = rows.mapInArrow(run, "row bigint, score double")
    last = scores.withColumn("rank", F.row_number().over(W.partitionBy("row").orderBy(F.desc("score")))).where(F.col("rank") <= k)
    kth = {r["row"]: (r["s"], r["n"]) for r in last.groupBy("row").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n")).collect()}
    near = np.array([kth[r][0] / float(_norms(v[None])[0]) for r, v in listed if r in kth])
    if not len(near):
        return 1.0, -math.inf
    away = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * near / largest))
    full = len(near) == len(listed) and all(n == k for _, n in kth.values())
    return max(LEAST_DISTANCE, float(np.quantile(away, quantile))), float(2 * near.min() - np.median(near)) if full else -math.inf


def nearest(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, target: float = TARGET) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every query row, nearest first."""
    kind = dict(vectors.dtypes)[vector]
    base = vectors.select(F.col(vec_id).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"),
                          F.col(vector).cast(kind if kind in ("array<float>", "array<double>") else "array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = base.where(finite & F.exists("v", lambda x: x != 0))
    rows = stage(usable.withColumn("row", F.monotonically_increasing_id()), "vectors")
    queries = rows.where("asks")
    n, largest = rows.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))).first()
    if not n:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    functions = min(16, max(4, round(math.log2(n) / 2)))
    distance, bar = _usual(rows, queries, float(largest), k, QUANTILE)
    index = Index(functions, float(largest), distance, max(1, math.ceil(n / BLOCK_ROWS)))

    kept = f"row bigint, id bigint, v {dict(rows.dtypes)['v']}"
    hashed = rows.select("row", "id", "v").mapInArrow(_hashed(index), f"t bigint, region bigint, bucket bigint, {kept}")
    probed = queries.select("row", "id", "v").mapInArrow(_probed(index, target), f"t bigint, region bigint, buckets array<bigint>, {kept}")
    found = stage(_ranked(_met(hashed, stage(probed, "visits"), k, bar), k), "neighbours")

    met = found.groupBy("query").agg(F.count(F.lit(1)).alias("met"))
    short = stage(queries.join(met, queries["row"] == met["query"], "left").where(F.coalesce("met", F.lit(0)) < k).select("row", "id", "v"), "short")
    if short.limit(1).count():
        everywhere = short.select(F.lit(0).cast("long").alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(index.regions - 1).cast("long"))).alias("region"),
                                  F.lit(None).cast("array<bigint>").alias("buckets"), "row", "id", "v")
        again = _ranked(_met(hashed.where("t = 0"), everywhere, k), k)
        found = found.join(short.select(F.col("row").alias("again")), F.col("query") == F.col("again"), "left_anti").unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score")
