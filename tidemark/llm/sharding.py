"""Shards by best-fit-decreasing packing of indivisible groups.

Groups are packed in rounds. A round deals the groups over packets of about ``PACKET`` groups, and every packet packs its
groups, largest first, each into the open box with the least room that still takes it (a balanced search tree over the
remaining room). A box is a group of the next round, so the number of groups falls by about ``PACKET / BOXES`` a round and
the last round has at most ``PACKET`` of them at any input size. The last round looks for the least capacity at which
best-fit-decreasing needs no more than the wanted number of shards, then levels the last difference; a group above the fair share gets a shard of its own
and the others share the rest. Boxes are tiny against a shard, so shards end up near equal in bytes.

A null text has no bytes and goes with the empty texts. Equal texts are one group and stay together, repeated rows
included; ties are ordered by size, then digest, so a rerun gives the same shards. Other columns are not read. A group
of copies is counted by partial sums and never gathered; its rows get their shard by a join that Spark may split.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import body, digest, stage

PACKET = 4096
BOXES = 64
#: Rows of a shard that are numbered together.
SLOT_ROWS = 50_000


class RoomTree:
    """Balanced search tree (treap) of (room, box): the least room that is large enough, in logarithmic time."""

    def __init__(self) -> None:
        self._root = None
        self._seed = 1

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[2], right = self._split(node[2], key)
            return node, right
        left, node[1] = self._split(node[1], key)
        return left, node

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if a[3] > b[3]:
            a[2] = self._join(a[2], b)
            return a
        b[1] = self._join(a, b[1])
        return b

    def add(self, room: int, box: int) -> None:
        self._seed = (self._seed * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        a, b = self._split(self._root, (room, box))
        self._root = self._join(self._join(a, [(room, box), None, None, self._seed >> 11]), b)

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and return the tightest (room, box) with room >= size."""
        below, rest = self._split(self._root, (size, -1))
        if rest is None:
            self._root = below
            return None
        parent, node = None, rest
        while node[1] is not None:
            parent, node = node, node[1]
        if parent is None:
            rest = node[2]
        else:
            parent[1] = node[2]
        self._root = self._join(below, rest)
        return node[0]


def best_fit(sizes: Iterable[int], capacity: int, most: int | None = None) -> list[int] | None:
    """Box of each size (given largest first); None once more than ``most`` boxes are needed. Oversize groups get a box alone."""
    tree, out, boxes = RoomTree(), [], 0
    for size in sizes:
        found = tree.take(size)
        if found is None:
            if most is not None and boxes == most:
                return None
            found = (max(capacity, size), boxes)
            boxes += 1
        room, box = found
        out.append(box)
        tree.add(room - size, box)
    return out


def near_equal(sizes: list[int], shards: int) -> list[int]:
    """Shard of each size (given largest first), by the least capacity that fits; giants above the fair share first."""
    giants, left = 0, sum(sizes)
    while giants < min(len(sizes), shards - 1) and sizes[giants] * (shards - giants) > left:
        left -= sizes[giants]
        giants += 1
    rest, n = sizes[giants:], shards - giants
    low = max([-(-left // n), *rest[:1]])
    high = low + max(rest, default=0)
    best = None
    while low < high or best is None:
        middle = (low + high) // 2 if best is not None or low < high else high
        found = best_fit(rest, middle, n)
        if found is None:
            low = middle + 1
            high = max(high, low)
        else:
            best, high = found, middle
    return [*range(giants), *(giants + b for b in levelled(rest, best, n))]


def levelled(sizes: list[int], boxes: list[int], n: int) -> list[int]:
    """Best fit fills early boxes to the brim: move the least group of the fullest box to the emptiest while that narrows the gap."""
    loads, held, out = [0] * n, [[] for _ in range(n)], list(boxes)
    for i, (size, box) in enumerate(zip(sizes, boxes, strict=True)):
        loads[box] += size
        held[box].append((size, i))
    for h in held:
        h.sort(reverse=True)
    for _ in range(len(sizes)):
        full, light = loads.index(max(loads)), loads.index(min(loads))
        if not held[full] or held[full][-1][0] >= loads[full] - loads[light]:
            break
        size, i = held[full].pop()
        insort(held[light], (size, i), key=lambda x: (-x[0], -x[1]))
        loads[full] -= size
        loads[light] += size
        out[i] = light
    return out


def _packed(groups: DataFrame, boxes_of) -> DataFrame:
    """Per packet: (packet, key, size) -> (key, packet, box, size), largest group first."""
    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "key"], ascending=[False, True], kind="stable")
        return group.assign(box=boxes_of([int(x) for x in group["size"]]))[["key", "packet", "box", "size"]]

    return groups.groupBy("packet").applyInPandas(pack, "key binary, packet bigint, box bigint, size bigint")


def pack_groups(groups: DataFrame, shards: int) -> DataFrame:
    """(key binary, size bigint), keys distinct -> (key, shard)."""
    rounds, level = [], groups
    while (n := level.count()) > PACKET:
        packets = -(-n // PACKET)
        dealt = level.select("key", "size", F.pmod(F.xxhash64("key", F.lit(len(rounds))), F.lit(packets)).alias("packet"))
        boxes = max(min(BOXES, PACKET // 4), PACKET // (2 * packets))  # so that the last round has many boxes a shard
        inside = stage(_packed(dealt, lambda sizes, n=boxes: best_fit(sizes, max(1, sum(sizes) // n))), "boxes")
        box = F.sha2(F.concat_ws("/", F.lit(len(rounds)), "packet", "box"), 256)
        rounds.append(inside.select("key", F.unhex(box).alias("up")))
        level = stage(inside.groupBy("packet", "box").agg(F.sum("size").alias("size")).select(F.unhex(box).alias("key"), "size"), "level")
    last = _packed(level.select("key", "size", F.lit(0).cast("long").alias("packet")), lambda sizes: near_equal(sizes, shards))
    out = last.select("key", F.col("box").cast("int").alias("shard"))
    for step in reversed(rounds):
        out = step.join(out.withColumnRenamed("key", "up"), "up").select("key", "shard")
    return stage(out, "shards")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Gapless ``slot`` from 0 in every shard: count per (shard, bucket), running offsets, then a rank inside a bucket."""
    buckets = max(1, rows.count() // SLOT_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(max(64, buckets))))
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(W.partitionBy("shard", "bucket").orderBy(*order)) - 1
    ranked = rows.withColumn("rank", rank).join(F.broadcast(offsets) if buckets <= 4096 else offsets, ["shard", "bucket"])
    return ranked.withColumn("slot", F.col("offset") + F.col("rank")).drop("bucket", "rank", "offset")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot); ``size`` is the text's UTF-8 bytes plus one."""
    text = body(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), digest(text).alias("key"))
    rows = stage(rows, "sizes")
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"))
    placed = stage(rows.join(pack_groups(groups, shards), "key"), "placed")
    return numbered(placed.drop("key"), ["id", "text_crc32"]).withColumnRenamed("id", id_col)
