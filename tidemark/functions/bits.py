"""Bit tables: a set of values folded to bits that a row tests before it is exploded or shuffled. A miss is certain, a hit is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the bits: 128 kB at most on the driver and in the plan, whatever the size of the set.
BITS = 20


def bit_table(values: DataFrame, column: str) -> Column:
    """One bit for the low bits of each value's hash, as an array of longs that the plan folds to a constant."""
    slot = F.xxhash64(column).bitwiseAND(F.lit((1 << BITS) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    table = ["0"] * (1 << (BITS - 6))
    for r in values.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).collect():
        table[r["at"]] = str(r["bits"])
    return F.split(F.lit(",".join(table)), ",").cast("array<bigint>")


def may_hold(table: Column, value: Column) -> Column:
    slot = F.xxhash64(value).bitwiseAND(F.lit((1 << BITS) - 1))
    return F.getbit(F.get(table, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1
