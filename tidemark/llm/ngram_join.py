"""Exact n-gram Jaccard join with signature trees.

Two texts link when their sets of five-word shingles have Jaccard similarity of 0.75 at least. Equal sets are one vertex.

Blocks. In a common order of shingles (those frequent in some batch last, then by hash) a set's first
``n - ceil(0.75 n) + k`` shingles, k = max(1, n // 10), meet those of any partner, so every link has a shingle that both
hold in front. Tasks send these front shingles packed, by hash range. Vertices that share one form a block. A pair that
shares c front shingles has at most ``c + max(rest, rest')`` in common, rest being what is not in front; pairs and
vertices that so miss ``3 (n + n') / 7`` are dropped before any text is read. Blocks of up to ``SMALL`` vertices give
their pairs. In larger blocks every vertex is first compared with the block centre it shares most with.

Trees. Large blocks that then still hold several components get a signature tree: leaves carry a vertex's size and bitmap
of shingles, inner nodes the OR of the bitmaps and the size range below. A dual traversal from (root, root) down drops node
pairs whose largest possible overlap misses ``3 (n + n') / 7``, whose sizes cannot match or that lie in one component. A task
keeps of the pairs left at the leaves a spanning forest. The forests of all blocks make groups, which hold every link not yet
found; a group's vertices get their shingles once, are traversed again, and pairs left are compared exactly in the task, which
passes over pairs inside one component by then and returns the links that join two. No task returns more rows than it was given.

Bounds only drop pairs that cannot link: the result is exact up to collisions of 64-bit hashes. Null and empty texts have
no shingles and link with nothing. Repeated rows and texts are one vertex; null ids count only if a component has no other.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import shingles
from tidemark.llm.common import body, row_key, sized, stage
from tidemark.llm.components import components

SMALL = 8
FAN = 16
#: Largest block that one task takes whole; a larger one is dealt as pairs of slices.
SLICE, SLICE_SHINGLES = 2048, 1 << 19
#: Front shingles in a task's packet, and aimed at per hash range.
PACKET = 1 << 20
PER_RANGE = 600_000
#: A shingle in at least so many texts of a batch may be frequent; in this share of all texts it is put last.
LOCAL = 8
FREQUENT = 0.002
BROADCAST_ROWS = 500_000
_BITS = (6, 16)


def front(n: int) -> int:
    """How many shingles of a set of n stand in front."""
    return min(n, n - (3 * n + 3) // 4 + max(1, n // 10))


def _rest(n: str) -> Column:
    k = F.greatest(F.lit(1), F.floor(F.col(n) / 10))
    return F.greatest(F.lit(0), F.ceil(0.75 * F.col(n)) - k)


def _reaches(c: Column) -> Column:
    """Whether c shared front shingles leave room for a link of sets of n_a and n_b shingles."""
    return (4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b")) & (7 * (c + F.greatest(_rest("n_a"), _rest("n_b"))) >= 3 * (F.col("n_a") + F.col("n_b")))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def bitmap(values: np.ndarray) -> bytes:
    """Bitmap with four to eight bits per shingle, a power of two long."""
    width = min(max(4 * len(values) - 1, 1).bit_length(), _BITS[1])
    bits = np.zeros(1 << max(width, _BITS[0]), dtype=bool)
    bits[values & np.uint64(len(bits) - 1)] = True
    return np.packbits(bits, bitorder="little").tobytes()


# ---- sets and shapes ------------------------------------------------------------------------------------------------

def shapes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, own, v, n) of every row, and rows with a frequent shingle of a batch in ``hot`` and its texts in ``n``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("own"), body(F.col(text_col)).alias("text"))
    rows = rows.select("id", F.col("own.a").alias("oa"), F.col("own.b").alias("ob"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shingles.pieces(batch, 3):
                found = list(shingles.sets(part.column(3)))
                n = np.array([len(s) for s in found], dtype=np.int64)
                v = np.array([shingles.vertex(s) for s in found], dtype=np.int64)
                nulls = pa.nulls(len(found), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(v), pa.array(n), nulls], names)
                first = np.unique(v, return_index=True)[1]
                values, counts = np.unique(np.concatenate([found[i] for i in first]), return_counts=True)
                hot = counts >= LOCAL
                gap = pa.nulls(int(hot.sum()), pa.int64())
                yield pa.RecordBatch.from_arrays([gap, gap, gap, gap, pa.array(counts[hot]), pa.array(values[hot].view(np.int64))], names)

    names = ["id", "oa", "ob", "v", "n", "hot"]
    return rows.mapInArrow(run, "id long, oa long, ob long, v long, n long, hot long")


def front_packets(docs: DataFrame, text_col: str, ranges: int, frequent: np.ndarray) -> DataFrame:
    """(range, shingles, vertices): packed front shingles; a task sends a repeated set once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, owners, size = set(), [], [], 0

        def flush() -> pa.RecordBatch:
            s, v = np.concatenate(held), np.concatenate(owners)
            place = (shingles.mix(s) % np.uint64(ranges)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            s, v, place = s[order], v[order], place[order]
            cuts = np.flatnonzero(np.diff(place, prepend=-1))
            ends = [*cuts[1:], len(place)]
            return pa.RecordBatch.from_arrays([
                pa.array(place[cuts]), pa.array([s[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary()),
                pa.array([v[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())], ["range", "s", "v"])

        for batch in batches:
            for part in shingles.pieces(batch, 0):
                for values in shingles.sets(part.column(0)):
                    n, v = len(values), shingles.vertex(values)
                    if not n or v in seen:
                        continue
                    seen.add(v)
                    last = np.isin(values, frequent, assume_unique=True) if len(frequent) else np.zeros(n, bool)
                    chosen = np.concatenate([values[~last], values[last]])[: front(n)]
                    held.append(chosen)
                    owners.append(np.full(len(chosen), v, dtype=np.int64))
                    size += len(chosen)
                    if size >= PACKET:
                        yield flush()
                        held, owners, size = [], [], 0
        if held:
            yield flush()

    return docs.select(body(F.col(text_col)).alias("text")).mapInArrow(run, "range long, s binary, v binary")


def _shared(group: pd.DataFrame) -> pd.DataFrame:
    """Blocks of one hash range: pairs of small ones (a < b, c shingles), members of large ones (a = block, b = vertex)."""
    s = np.frombuffer(b"".join(group["s"]), np.uint64)
    v = np.frombuffer(b"".join(group["v"]), np.int64)
    order = np.lexsort((v, s))
    s, v = s[order], v[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (v[1:] != v[:-1])
    s, v = s[fresh], v[fresh]
    starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, int)
    sizes = np.diff(np.append(starts, len(s)))
    pairs = []
    for k in range(2, SMALL + 1):
        rows = v[starts[sizes == k][:, None] + np.arange(k)]
        pairs += [rows[:, [i, j]] for i, j in combinations(range(k), 2)]
    out = []
    if pairs := [p for p in pairs if len(p)]:
        ab, c = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
        out.append(pd.DataFrame({"large": False, "a": ab[:, 0], "b": ab[:, 1], "c": c}))
    members: dict[int, tuple[np.ndarray, int]] = {}
    for at, k in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        block = v[at : at + k]
        name = shingles.vertex(block)
        members[name] = (block, members[name][1] + 1 if name in members else 1)
    for name, (block, c) in members.items():
        out.append(pd.DataFrame({"large": True, "a": name, "b": block, "c": c}))
    return pd.concat(out) if out else pd.DataFrame({"large": [], "a": [], "b": [], "c": []}).astype({"large": bool, "a": "int64", "b": "int64", "c": "int64"})


# ---- exact comparison -----------------------------------------------------------------------------------------------

def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) pairs that link, by their whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shingles.pieces(batch, 2, 2 << 20):
                linked = [similar(x, y) for x, y in zip(shingles.sets(part.column(2)), shingles.sets(part.column(3)), strict=True)]
                yield part.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    left = texts.select(F.col("v").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("v").alias("b"), F.col("text").alias("y"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a long, b long")


# ---- signature trees ------------------------------------------------------------------------------------------------

class Level:
    """Nodes of one level: OR-combined bitmaps, size range, most shingles without a bit of their own, component or -1."""

    def __init__(self, bits, low, high, extra, root) -> None:
        self.bits, self.low, self.high, self.extra, self.root = bits, low, high, extra, root

    def above(self) -> Level:
        cuts = np.arange(0, len(self.low), FAN)
        least, most = np.minimum.reduceat(self.root, cuts), np.maximum.reduceat(self.root, cuts)
        mixed = (least != most) | np.logical_or.reduceat(self.root == -1, cuts)
        return Level(np.bitwise_or.reduceat(self.bits, cuts, axis=0), np.minimum.reduceat(self.low, cuts), np.maximum.reduceat(self.high, cuts),
                     np.maximum.reduceat(self.extra, cuts), np.where(mixed, -1, least))

    def survivors(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Which node pairs can still hold a link between two components."""
        keep = (self.root[p] != self.root[q]) | (self.root[p] == -1)
        keep &= (4 * self.high[p] >= 3 * self.low[q]) & (4 * self.high[q] >= 3 * self.low[p])
        at = np.flatnonzero(keep)
        stride = max(256, (1 << 20) // self.bits.shape[1])  # bounded memory for long bitmaps
        for i in range(0, len(at), stride):
            a, b = p[at[i : i + stride]], q[at[i : i + stride]]
            most = np.bitwise_count(self.bits[a] & self.bits[b]).sum(axis=1, dtype=np.int64) + np.minimum(self.extra[a], self.extra[b])
            keep[at[i : i + stride]] = 7 * np.minimum(most, np.minimum(self.high[a], self.high[b])) >= 3 * (self.low[a] + self.low[b])
        return keep


def _tiled(maps: list[bytes], width: int) -> np.ndarray:
    """Bitmaps of one width: a shorter one is repeated, which keeps every bit that the longer one could share with it."""
    out = np.empty((len(maps), width // 8), np.uint64)
    for i, m in enumerate(maps):
        out[i] = np.tile(np.frombuffer(m, np.uint64), width // len(m))
    return out


def open_pairs(n: np.ndarray, maps: list[bytes], root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of different components that the bounds leave, part by part, from one tree for every two neighbouring
    bitmap widths. Sets of sizes that can link have the same width or neighbouring ones."""
    widths = np.array([len(m) for m in maps])
    counts = np.fromiter((int.from_bytes(m, "little").bit_count() for m in maps), np.int64, len(maps))
    for width in np.unique(widths):
        wider = (widths == 2 * width).any()
        if not wider and (2 * widths == width).any():
            continue  # the tree of the width below held these already
        chosen = np.flatnonzero((widths == width) | (widths == 2 * width))
        if len(np.unique(root[chosen])) > 1:
            top = int(widths[chosen].max())
            for p, q in _traversed(n[chosen], _tiled([maps[i] for i in chosen], top), counts[chosen], root[chosen]):
                yield chosen[p], chosen[q]


def dual_traversal(v: np.ndarray, n: np.ndarray, maps: list[bytes], root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All those pairs by vertex, a < b."""
    found = [np.stack([np.minimum(v[p], v[q]), np.maximum(v[p], v[q])], axis=1) for p, q in open_pairs(n, maps, root)]
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


def _traversed(n: np.ndarray, bits: np.ndarray, counts: np.ndarray, root: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """One tree against itself; leaves are ordered by component and size."""
    codes = np.unique(root, return_inverse=True)[1]
    order = np.lexsort((n, codes))
    n, codes, extra = n[order], codes[order], (n - counts)[order]
    levels = [Level(bits[order], n, n, extra, codes)]
    while len(levels[-1].low) > FAN:
        levels.append(levels[-1].above())
    top = np.arange(len(levels[-1].low))
    p, q = (x.ravel() for x in np.meshgrid(top, top, indexing="ij"))
    p, q = p[p <= q], q[p <= q]
    work = [(len(levels) - 1, p, q)]
    while work:
        at, p, q = work.pop()
        keep = levels[at].survivors(p, q)
        p, q = p[keep], q[keep]
        if not len(p):
            continue
        if at == 0:
            keep = p != q
            yield order[p[keep]], order[q[keep]]
            continue
        below = len(levels[at - 1].low)
        for i in range(0, len(p), 1024):  # bounded memory however many node pairs are open
            a = (p[i : i + 1024, None] * FAN + np.arange(FAN))[:, :, None]
            b = (q[i : i + 1024, None] * FAN + np.arange(FAN))[:, None, :]
            a, b = (x.ravel() for x in np.broadcast_arrays(a, b))
            inside = (a < below) & (b < below) & (a <= b)
            work.append((at - 1, a[inside], b[inside]))


class Parts:
    """Growing parts of the places of a group."""

    def __init__(self, label: np.ndarray) -> None:
        self.label = np.unique(label, return_inverse=True)[1]

    def joining(self, p: np.ndarray, q: np.ndarray, linked: Callable[[int, int], bool]) -> Iterator[tuple[int, int]]:
        """The pairs that join two parts, of those that ``linked`` accepts; pairs inside one part are passed over."""
        for at in range(0, len(p), 4096):
            x_at, y_at = p[at : at + 4096], q[at : at + 4096]
            apart = self.label[x_at] != self.label[y_at]
            for x, y in zip(x_at[apart].tolist(), y_at[apart].tolist(), strict=True):
                if self.label[x] != self.label[y] and linked(x, y):
                    self.label[self.label == self.label[y]] = self.label[x]
                    yield x, y


def _dealt(members: DataFrame, group: str) -> DataFrame:
    """Members of a group in slices of bounded rows and shingles, each copied to the pairs (i, j) of slices that it is in."""
    slices = members.groupBy(group).agg(F.ceil(F.greatest(F.count(F.lit(1)) / SLICE, F.sum("n") / SLICE_SHINGLES)).cast("int").alias("slices"), F.count_distinct("root").alias("roots"))
    cut = members.join(slices.where("roots > 1").drop("roots"), group).withColumn("own", F.pmod(F.xxhash64("v"), F.col("slices")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    return cut.select("*", other.alias("other")).select(*members.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")


def _of_slices(group: pd.DataFrame, maps: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Open pairs that belong to the slices (i, j) of this task: a pair inside one slice belongs to that slice alone."""
    own, i, j = group["own"].to_numpy(), group["i"].iat[0], group["j"].iat[0]
    for p, q in open_pairs(group["n"].to_numpy(), maps, group["root"].to_numpy()):
        here = (np.minimum(own[p], own[q]) == i) & (np.maximum(own[p], own[q]) == j)
        yield p[here], q[here]


def tree_groups(members: DataFrame) -> DataFrame:
    """(block, v, n, bits, root) -> (a, b): fewer pairs than members that connect all pairs across components that the trees leave."""
    def traverse(group: pd.DataFrame) -> pd.DataFrame:
        v = group["v"].to_numpy()
        parts = Parts(v)
        pairs = [(v[x], v[y]) for p, q in _of_slices(group, list(group["bits"])) for x, y in parts.joining(p, q, lambda x, y: True)]
        return pd.DataFrame({"a": [min(e) for e in pairs], "b": [max(e) for e in pairs]}, dtype="int64")

    return _dealt(members, "block").groupBy("block", "i", "j").applyInPandas(traverse, "a long, b long").distinct()


def tree_links(members: DataFrame) -> DataFrame:
    """(group, v, n, shingles, root) -> (a, b): links that join all components of a group that have one, by exact comparison
    of the pairs that the trees leave; a link inside components joined by now is passed over."""
    def compare(group: pd.DataFrame) -> pd.DataFrame:
        v, sets = group["v"].to_numpy(), [np.frombuffer(x, np.uint64) for x in group["shingles"]]
        parts = Parts(group["root"].to_numpy())
        pairs = [(v[x], v[y]) for p, q in _of_slices(group, [bitmap(s) for s in sets])
                 for x, y in parts.joining(p, q, lambda x, y: similar(sets[x], sets[y]))]
        return pd.DataFrame({"a": [min(e) for e in pairs], "b": [max(e) for e in pairs]}, dtype="int64")

    return _dealt(members, "group").groupBy("group", "i", "j").applyInPandas(compare, "a long, b long")


def _stars(members: DataFrame, facts: DataFrame) -> DataFrame:
    """(a, b): every member of a large block and the centre it shares most with, the vertex whose front is shared most for its size."""
    ranked = members.join(facts.select("v", "n", "large"), "v").select("block", "c", "v", (F.col("large") / F.col("n")).alias("weight"))
    centres = ranked.groupBy("block").agg(F.max_by("v", F.struct("weight", "v")).alias("centre"))
    near = members.join(centres, "block").where("v <> centre").groupBy("v", "centre").agg(F.sum("c").alias("c"))
    near = near.groupBy("v").agg(F.max_by("centre", F.struct("c", "centre")).alias("centre"))
    side = {x: facts.select(*[F.col(c).alias(f"{c}_{x}") for c in facts.columns]) for x in "ab"}
    near = near.select(F.least("v", "centre").alias("a"), F.greatest("v", "centre").alias("b"))
    near = near.join(side["a"], F.col("a") == F.col("v_a")).join(side["b"], F.col("b") == F.col("v_b"))
    return near.where(_reaches(F.least("large_a", "large_b") + F.least("small_a", "small_b"))).select("a", "b").distinct()


# ---- the join -------------------------------------------------------------------------------------------------------

def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, oa, ob) of every row; oa, ob identify (id, text)."""
    everything = stage(shapes(docs, id_col, text_col), "shapes")
    rows = everything.where("hot IS NULL").drop("hot")
    sets = stage(rows.where("n > 0").groupBy("v").agg(F.first("n").alias("n"), F.min(F.struct("oa", "ob")).alias("own"), F.min("id").alias("low")), "sets")
    total = sets.agg(F.count(F.lit(1)), F.sum("n")).first()
    frequent = everything.where("hot IS NOT NULL").groupBy("hot").agg(F.sum("n").alias("n")).where(F.col("n") >= max(2 * LOCAL, FREQUENT * total[0]))
    # at most (mean set size) / FREQUENT shingles can be in that share of all texts
    frequent = np.sort(frequent.select("hot").toPandas()["hot"].to_numpy(dtype=np.int64).view(np.uint64))
    ranges = max(16, (total[1] or 0) * 3 // 10 // PER_RANGE)
    packets = front_packets(docs, text_col, ranges, frequent)
    shared = stage(packets.groupBy("range").applyInPandas(_shared, "large boolean, a long, b long, c long"), "shared")

    pairs = stage(shared.where("NOT large").groupBy("a", "b").agg(F.sum("c").alias("c")), "small-pairs")
    members = shared.where("large").groupBy(F.col("a").alias("block"), F.col("b").alias("v")).agg(F.sum("c").alias("c"))
    large = members.select("v", "c").groupBy("v").agg(F.sum("c").alias("large"))
    small = pairs.select(F.explode(F.array("a", "b")).alias("v"), "c").groupBy("v").agg(F.sum("c").alias("small"))
    facts = sets.select("v", "n").join(large.join(small, "v", "full"), "v")
    facts = stage(facts.select("v", "n", F.coalesce("large", F.lit(0)).alias("large"), F.coalesce("small", F.lit(0)).alias("small")), "facts")
    side = {x: facts.select(*[F.col(c).alias(f"{c}_{x}") for c in facts.columns]) for x in "ab"}
    counted = pairs.join(side["a"], F.col("a") == F.col("v_a")).join(side["b"], F.col("b") == F.col("v_b"))
    direct = counted.where(_reaches(F.col("c") + F.least("large_a", "large_b"))).select("a", "b")

    # a vertex whose front shingles are too seldom shared for any partner leaves the large blocks
    able = facts.where((F.col("large") > 0) & (7 * (F.col("large") + F.col("small") + _rest("n")) >= 3 * (F.col("n") + F.ceil(0.75 * F.col("n")))))
    members = stage(members.join(able.select("v"), "v", "left_semi"), "members")
    first = stage(direct.union(_stars(members, facts)).distinct(), "first-pairs")

    live = first.select(F.col("a").alias("v")).union(first.select("b")).union(members.select("v")).distinct()
    live = stage(sets.join(live, "v", "left_semi").select("v", "own.oa", "own.ob"), "live")
    keyed = docs.select(row_key(F.col(id_col), F.col(text_col)).alias("own"), body(F.col(text_col)).alias("text"))
    keyed = keyed.select(F.col("own.a").alias("oa"), F.col("own.b").alias("ob"), "text")
    texts = stage(keyed.join(sized(live, BROADCAST_ROWS), ["oa", "ob"]).select("v", "text"), "live-texts")
    links = stage(verified(first, texts), "first-links")

    roots = components(links)
    known = members.join(roots, "v", "left").select("block", "c", "v", F.coalesce("root", "v").alias("root"))
    open_blocks = stage(known.groupBy("block").agg(F.count_distinct("root").alias("roots")).where("roots > 1").select("block"), "open-blocks")
    inside = stage(known.join(open_blocks, "block", "left_semi"), "open-members")
    signed = stage(_per_set(texts.join(inside.select("v").distinct(), "v", "left_semi"), "bits", bitmap), "signatures")
    groups = components(tree_groups(inside.select("block", "v", "root").join(signed, "v"))).withColumnRenamed("root", "group")
    grouped = inside.select("v", "root").distinct().join(groups, "v")
    more = stage(tree_links(grouped.join(_per_set(texts.join(groups.select("v"), "v", "left_semi"), "shingles", np.ndarray.tobytes), "v")), "second-links")
    roots = components(links.union(more))

    placed = sets.join(roots, "v", "left").select("v", "low", F.coalesce("root", "v").alias("root"))
    least = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    placed = stage(placed.join(least, "root").select("v", "component_id"), "placed")
    out = rows.join(placed, "v", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "oa", "ob")


def _per_set(texts: DataFrame, name: str, make: Callable[[np.ndarray], bytes]) -> DataFrame:
    """(v, n, what ``make`` gives for the sorted shingles) of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in shingles.pieces(batch, 1):
                found = list(shingles.sets(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([make(s) for s in found], pa.binary())], ["v", "n", name])

    return texts.select("v", "text").mapInArrow(run, f"v long, n long, {name} binary")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component (its smallest id, then row key) and every row without words, with exactly the columns of ``docs``.

    Of rows that repeat an id and its text one stays.
    """
    found = near_duplicates(docs, id_col, text_col)
    best = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct(F.col(id_col).isNull().alias("z"), F.col(id_col).alias("i"), "oa", "ob")).alias("x"))
    kept = best.select("x.oa", "x.ob").union(found.where("n_shingles = 0").select("oa", "ob").distinct())
    keyed = docs.select(F.struct("*").alias("row"), row_key(F.col(id_col), F.col(text_col)).alias("own")).select("row", F.col("own.a").alias("oa"), F.col("own.b").alias("ob"))
    return keyed.join(kept, ["oa", "ob"], "left_semi").dropDuplicates(["oa", "ob"]).select("row.*")
