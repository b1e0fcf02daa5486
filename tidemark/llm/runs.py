"""Periodic runs of words: maximal stretches that repeat with a smallest period, in whole texts.

Scale-tiled distribution. Periods are dealt to octaves ``[P, 2P)`` and every octave has a boundary each ``P`` words. A run of
period q and at least ``max(12, 2q)`` words holds a boundary c from which ``words[c:]`` and ``words[c+q:]`` (forwards) and the
words before both (backwards) agree over ``max(q, 12-q)`` words together. Texts are exploded to overlapping tiles around the
boundaries of each octave; a rolling hash over half of that agreement drops tiles that cannot hold a run (equal words have
equal hashes, so none is lost). The tiles left are dealt evenly over the tasks and solved one by one with two Z-functions at
the boundary, which compare the words themselves. Their intervals are shuffled by document and period, where those that share
q words are stitched; of equal intervals the smallest period stays.

Null and empty texts have no words and no runs. Repeated rows are treated alike. Input columns come back inside ``row``, so
their names cannot clash. An empty table gives an empty table. Nothing is cut: texts of any length are searched for all periods.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm import shingles
from tidemark.llm.common import MANY, let, row_key, stage, words

#: A run has at least so many words.
LEAST = 12
#: Boundaries of one tile row: about so many words, and at least so many boundaries.
TILE_WORDS, TILE_BOUNDARIES = 4096, 16
#: Runs (some 60 bytes each with their share of the row) up to which they are broadcast to the texts.
BROADCAST_RUNS = 1_000_000

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_TILES = "a bigint, b bigint, octave bigint, first bigint, boundaries bigint, lead bigint, ids binary"
_FOUND = "a bigint, b bigint, period bigint, start bigint, end bigint"


def screen(octave: int) -> int:
    """Words that must agree on one side of a boundary for any period of the octave."""
    return min((max(q, LEAST - q) + 1) // 2 for q in range(octave, min(2 * octave, octave + LEAST)))


def reach(octave: int) -> tuple[int, int]:
    """How far a tile looks behind its boundary and beyond the second copy after it."""
    return max(octave, LEAST), max(2 * octave, 2 * LEAST)


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word codes of all texts in a row, edges between texts); equal words of the batch have equal codes."""
    listed = pc.ascii_split_whitespace(texts.fill_null("") if texts.null_count else texts)
    flat, owner = listed.flatten(), pc.list_parent_indices(listed)
    worded = pc.greater(pc.binary_length(flat), 0)
    flat, owner = flat.filter(worded), owner.filter(worded).to_numpy()
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32) if len(flat) else np.zeros(0, np.int32)
    return codes, np.searchsorted(owner, np.arange(len(texts) + 1))


def suspects(codes: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(octave, text of a boundary, boundary) for all boundaries at which some period of the octave passes the screen."""
    sizes = np.diff(edges)
    if not len(codes) or sizes.max() < LEAST:
        return
    steps = np.arange(len(codes), dtype=np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(codes), _BASE)]))
    back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(len(codes), _BACK)]))
    prefix = np.concatenate([[np.uint64(0)], np.cumsum(shingles.mix(codes.astype(np.uint64) + np.uint64(1)) * power[:-1])])
    octave, at = 1, steps
    while 2 * octave <= sizes.max():
        long_enough = sizes[text[at]] >= max(LEAST, 2 * octave)
        at = at if long_enough.all() else at[long_enough]
        width = screen(octave)
        window = (prefix[width:] - prefix[:-width]) * back[: len(prefix) - width]
        place = at - edges[text[at]]
        usable = place >= octave
        there, place = at[usable], place[usable]
        boundary = (place // octave - 1) * octave
        anchor = there - place + boundary
        ahead = place + width <= sizes[text[there]]
        hit = np.zeros(len(there), bool)
        hit[ahead] = window[there[ahead]] == window[anchor[ahead]]
        behind = ~hit & (boundary >= width)
        hit[behind] = window[there[behind] - width] == window[anchor[behind] - width]
        if hit.any():
            found = np.unique(anchor[hit])
            yield octave, text[found], found - edges[text[found]]
        octave *= 2


def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tile rows of the suspect boundaries; neighbours share a row, so that their overlap is carried once."""
    for batch in batches:
        for part in shingles.pieces(batch, 2):
            codes, edges = split_words(part.column(2))
            a, b = part.column(0).to_numpy(), part.column(1).to_numpy()
            rows: list[tuple] = []
            for octave, texts, boundaries in suspects(codes, edges):
                behind, beyond = reach(octave)
                most = max(TILE_BOUNDARIES, TILE_WORDS // octave)
                new = (np.diff(texts, prepend=-1) != 0) | (np.diff(boundaries, prepend=-1) != octave)
                run = np.flatnonzero(new)
                ends = np.append(run[1:], len(new))
                for lo, hi in zip(run, ends, strict=True):
                    for i in range(lo, hi, most):
                        n, t, first = min(most, hi - i), texts[i], boundaries[i]
                        begin = max(0, first - behind)
                        end = min(edges[t + 1] - edges[t], first + n * octave + octave + beyond)
                        rows.append((a[t], b[t], octave, first, n, first - begin, codes[edges[t] + begin : edges[t] + end].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([r[i] for r in rows], pa.int64()) for i in range(6)), pa.array([r[6] for r in rows], pa.binary())],
                    names=["a", "b", "octave", "first", "boundaries", "lead", "ids"])


def z_function(s: list[int]) -> list[int]:
    """How many items from every place on agree with the beginning."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def _root(q: int, ahead: list[int]) -> int:
    """Smallest divisor d of q such that the q words after the boundary repeat d words."""
    rest, d = q, 2
    root = q
    while rest > 1:
        if d * d > rest:
            d = rest
        if rest % d:
            d += 1
            continue
        rest //= d
        if ahead[root // d] >= q - root // d:
            root //= d
    return root


def solve(ids: list[int], c: int, octave: int) -> Iterator[tuple[int, int, int]]:
    """(period, start, end) of the repetitions around boundary c with a period of the octave that is no multiple of a smaller one."""
    behind, beyond = reach(octave)
    ahead = z_function(ids[c : c + 2 * octave + beyond])
    before = ids[max(0, c - behind) : c][::-1]
    around = ids[max(0, c + octave - behind) : c + 2 * octave]
    back = z_function([*before, -1, *around[::-1]])
    last = c + len(around) - (c - max(0, c + octave - behind))  # end of ``around``
    top = min(2 * octave, len(ahead))
    whole = next((t for t in range(1, min(octave, len(ahead))) if ahead[t] + t >= min(2 * octave, len(ids) - c)), 0)
    for q in range(octave, top):
        if whole and q % whole == 0 and q > whole:
            continue
        right = min(ahead[q], beyond)
        at = len(before) + 1 + last - c - q
        left = min(back[at], behind) if at < len(back) else 0
        if left + right >= max(q, LEAST - q) and _root(q, ahead) == q:
            yield q, c - left, c + q + right


def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for r in batch.to_pylist():
            ids = np.frombuffer(r["ids"], np.int32).tolist()
            shift = r["first"] - r["lead"]
            for i in range(r["boundaries"]):
                rows += [(r["a"], r["b"], q, start + shift, end + shift)
                         for q, start, end in solve(ids, r["lead"] + i * r["octave"], r["octave"])]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["a", "b", "period", "start", "end"])


def stitched(found: DataFrame) -> DataFrame:
    """Interval fragments -> one row per run: (a, b, period, start, end). Fragments of one period that share a period's words join."""
    by = W.partitionBy("a", "b", "period").orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    apart = found.withColumn("new", F.coalesce(F.col("start") > before - F.col("period"), F.lit(True)).cast("int"))
    numbered = apart.withColumn("part", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    whole = numbered.groupBy("a", "b", "period", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return whole.groupBy("a", "b", "start", "end").agg(F.min("period").alias("period")).where(
        F.col("end") - F.col("start") >= F.greatest(F.lit(LEAST), 2 * F.col("period")))


def _by_text(runs: DataFrame) -> DataFrame:
    """(a, b) -> runs by start and period, stretches of kept words before the last dropped one, first word after it."""
    dropped = F.col("start") + F.col("period")
    done = F.coalesce(F.max("end").over(W.partitionBy("a", "b").orderBy(dropped, "end").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    gaps = runs.withColumn("done", done)
    return gaps.groupBy("a", "b").agg(
        F.sort_array(F.collect_list(F.struct("start", (F.col("end") - F.col("start")).alias("length"), "period"))).alias("runs"),
        F.sort_array(F.collect_list(F.when(dropped > F.col("done"), F.struct(F.col("done").alias("first"), (dropped - F.col("done")).alias("n"))))).alias("kept"),
        F.max("end").alias("rest"))


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per input row: ``row`` (its columns), ``runs`` (array of start, length, period; by start, then period) and ``collapsed``:
    the words joined by one blank, without those that any run holds after its first period."""
    base = docs.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text"))
    # equal texts have equal runs: the key stands for the text, and the tiles of its copies are solved once
    keyed = base.select("row", "text", row_key(F.col("text")).alias("k"))
    tiles = keyed.select("k.a", "k.b", "text").mapInArrow(tiled, _TILES)
    dealt = tiles.dropDuplicates(["a", "b", "octave", "first"])
    runs = stage(_by_text(stitched(dealt.mapInArrow(solved, _FOUND))), "runs")
    right = runs.select(F.col("a").alias("ra"), F.col("b").alias("rb"), "runs", "kept", "rest")
    few = (runs.agg(F.sum(F.size("runs") + F.size("kept") + 1)).first()[0] or 0) <= BROADCAST_RUNS
    joined = keyed.join(F.broadcast(right) if few else right,
                        (F.col("k.a") == F.col("ra")) & (F.col("k.b") == F.col("rb")), "left")
    split = joined.select("row", "runs", "kept", "rest", words(F.col("text")).alias("words"))
    left = F.flatten(F.concat(F.transform("kept", lambda g: F.slice("words", (g["first"] + 1).cast("int"), g["n"].cast("int"))),
                              F.array(F.slice("words", (F.col("rest") + 1).cast("int"), F.lit(MANY)))))
    none = F.array().cast("array<struct<start:bigint,length:bigint,period:bigint>>")
    return split.select("row", F.coalesce("runs", none).alias("runs"),
                        F.array_join(F.when(F.col("runs").isNull(), F.col("words")).otherwise(left), " ").alias("collapsed"))


def planted(text: Column, doc_id: Column) -> Column:
    """The query's input: one document in ten repeats its words from some place on, as the checksum of its id says."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    w = words(text)
    n, g = F.size(w), F.floor(h / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))

    def again(x: Column) -> Column:
        rest = (x["n"] - x["a"]).cast("int")
        block = F.slice(x["w"], (x["a"] + 1).cast("int"), x["p"].cast("int"))
        copies = F.flatten(F.array_repeat(block, F.ceil(rest / x["p"]).cast("int")))
        return F.array_join(F.concat(F.slice(x["w"], F.lit(1), x["a"].cast("int")), F.slice(copies, F.lit(1), rest)), " ")

    parts = F.struct(w.alias("w"), n.alias("n"), a.alias("a"), p.alias("p"))
    return F.when((F.pmod(h, F.lit(10)) == 0) & (n > 0), let(parts, again)).otherwise(text)
