"""Look-back and running values over ordered histories that stay bounded per task.

A history (one conversation) may be arbitrarily long, so a plain window over its
key would put it in one task.  When histories are long, rows are cut into blocks
of consecutive positions: each block is processed on its own and receives the
state carried over from the blocks before it, which is a scan over one small row
per block.  Short histories (checked) use the plain window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import cut

BLOCK = 10_000


def has_long_groups(df: DataFrame, position: str, block: int = BLOCK) -> bool:
    """Whether any history reaches past one block (positions count from zero)."""
    top = df.agg(F.max(position)).first()[0]
    return top is not None and top >= block


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is first, last, max, min, sum or bit_or of ``value``."""

    name: str
    kind: str
    value: Column
    include_current: bool = True


_MERGE = {
    "first": lambda local, carry: F.coalesce(carry, local),
    "last": lambda local, carry: F.coalesce(local, carry),
    "max": lambda local, carry: F.greatest(local, carry),
    "min": lambda local, carry: F.least(local, carry),
    "bit_or": lambda local, carry: F.coalesce(local, F.lit(0)).bitwiseOR(F.coalesce(carry, F.lit(0))),
    "sum": lambda local, carry: F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0)),
}


def _over(kind: str, col: Column, frame) -> Column:
    if kind in ("first", "last"):
        return getattr(F, kind)(col, ignorenulls=True).over(frame)
    return getattr(F, kind)(col).over(frame)


def running(df: DataFrame, keys: list[str], order: str, specs: list[Running], blocked: bool = False,
            block: int = BLOCK) -> DataFrame:
    """Add running values from the start of each history up to (or before) each row."""
    given = df.columns
    df = df.select("*", *[s.value.alias(f"_in_{s.name}") for s in specs])

    def frame(window, spec):
        return window.rowsBetween(W.unboundedPreceding, 0 if spec.include_current else -1)

    if not blocked:
        w = W.partitionBy(*keys).orderBy(order)
        out = df.select("*", *[_over(s.kind, F.col(f"_in_{s.name}"), frame(w, s)).alias(s.name) for s in specs])
        return out.drop(*[f"_in_{s.name}" for s in specs])

    df = df.withColumn("_block", F.floor(F.col(order) / block))
    w = W.partitionBy(*keys, "_block").orderBy(order)
    local = df.select("*", *[_over(s.kind, F.col(f"_in_{s.name}"), frame(w, s)).alias(f"_out_{s.name}") for s in specs])

    def total(spec):
        col = F.col(f"_in_{spec.name}")
        when = F.when(col.isNotNull(), F.col(order))
        if spec.kind == "first":
            return F.min_by(col, when)
        if spec.kind == "last":
            return F.max_by(col, when)
        return getattr(F, spec.kind)(col)

    totals = df.groupBy(*keys, "_block").agg(*[total(s).alias(f"_tot_{s.name}") for s in specs])
    past = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "_block",
        *[_over(s.kind, F.col(f"_tot_{s.name}"), past).alias(f"_carry_{s.name}") for s in specs],
    )
    joined = local.join(carried, [*keys, "_block"], "left")
    merged = joined.select(
        "*", *[_MERGE[s.kind](F.col(f"_out_{s.name}"), F.col(f"_carry_{s.name}")).alias(s.name) for s in specs]
    )
    return merged.select(*given, *[s.name for s in specs])


def with_previous(df: DataFrame, keys: list[str], order: str, k: int, value: Column, name: str,
                  blocked: bool = False, block: int = BLOCK) -> DataFrame:
    """Array of ``value`` (a struct) of the k preceding rows, oldest first."""
    if not blocked:
        w = W.partitionBy(*keys).orderBy(order).rowsBetween(-k, -1)
        return df.withColumn(name, F.collect_list(value).over(w))
    given = df.columns
    df = df.withColumn("_wp_block", F.floor(F.col(order) / block)).withColumn("_wp_value", value)
    w = W.partitionBy(*keys, "_wp_block").orderBy(order)
    local = df.withColumn("_wp_near", F.collect_list("_wp_value").over(w.rowsBetween(-k, -1)))

    def tail(arr: Column) -> Column:
        return F.slice(arr, F.greatest(F.size(arr) - k + 1, F.lit(1)), F.lit(k))

    ends = (
        local.withColumn("_wp_last", F.lead(F.lit(1)).over(w).isNull())
        .where("_wp_last")
        .select(*keys, "_wp_block", tail(F.concat("_wp_near", F.array("_wp_value"))).alias("_wp_tail"))
    )
    past = W.partitionBy(*keys).orderBy("_wp_block").rowsBetween(-k, -1)
    carried = ends.select(*keys, "_wp_block", tail(F.flatten(F.collect_list("_wp_tail").over(past))).alias("_wp_carry"))
    joined = local.join(carried, [*keys, "_wp_block"], "left")
    both = F.when(F.col("_wp_carry").isNull(), F.col("_wp_near")).otherwise(F.concat("_wp_carry", "_wp_near"))
    return joined.withColumn(name, tail(both)).select(*given, name)


def row_numbers(df: DataFrame, order: list[Column], name: str = "row_no") -> DataFrame:
    """1-based position in a total order without a single-task window.

    Rows are range-partitioned (balanced by sampling), frozen on the checkpoint
    folder so that positions are stable, numbered inside each partition, and
    shifted by the sizes of the partitions before.
    """
    low_bits = (1 << 33) - 1
    ranged = cut(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    part = F.shiftright("_id", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row per partition: bounded by the number of shuffle partitions
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        ranged.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit(low_bits)) + 1)
        .drop("_part", "_before", "_id")
    )


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int | Column, name: str = "rnk") -> DataFrame:
    """Best rows per group; a literal k is cut on the map side before the shuffle."""
    w = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
