"""Benchmark passages in training texts by spaced-seed hashing.

Tokens are lower-case runs of letters and digits. A mask is a fixed set of token positions; the hash of those tokens is a
seed. The two masks below were chosen so that any ``WINDOW`` aligned tokens with at most ``SUBSTITUTIONS`` of them replaced
share a seed under one of them. Test seeds and training seeds are joined by hash, and around every hit the aligned tokens
are compared: an overlap counts if a window of ``WINDOW`` tokens (the whole item, unchanged, if it is shorter) agrees but for
the allowed substitutions. So the result does not depend on the masks.

Training seeds are first held against a bit table of the test seeds, inside the row and before anything is exploded;
only survivors become rows. The test side is broadcast after a count, beyond it the join shuffles by seed.

Items of fewer than ``LEAST_TOKENS`` tokens, null items and empty ones match nothing; null and empty texts are clean;
repeated items and rows give the same answer once per (id, item). Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import body, row_key, sized, stage

MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN = 8
WINDOW = 13
SUBSTITUTIONS = 2
LEAST_TOKENS = 8
#: log2 of the bits in the largest bit table.
BITS = 20
BROADCAST_SEEDS = 500_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(body(text)), r"[^\p{L}\p{N}]+"), "")


def _coded(rows: DataFrame, keep: list[Column]) -> DataFrame:
    """Rows with ``t``: one 64-bit code per token, and ``n``."""
    split = rows.select(*keep, tokens(F.col("text")).alias("words"))
    coded = split.select(*[c for c in split.columns if c != "words"], F.transform("words", lambda w: F.xxhash64(w)).alias("t"))
    return coded.select("*", F.size("t").alias("n"))


def _around(place: Column) -> Column:
    """Codes from WINDOW before a place to WINDOW past the seed there; nulls beyond the ends of the text."""
    before = F.greatest(F.lit(0), WINDOW - place)
    inside = F.slice("t", F.greatest(place - WINDOW, F.lit(0)) + 1, 2 * WINDOW + SPAN - before)
    after = 2 * WINDOW + SPAN - before - F.size(inside)
    gap = F.lit(None).cast("bigint")
    return F.concat(F.array_repeat(gap, before), inside, F.array_repeat(gap, after))


def _seeds(rows: DataFrame, keep: list[str], test: Column | None) -> DataFrame:
    """(keep..., mask, seed, around) for every place whose seed passes the test.

    The outer form of the generator keeps Spark from deriving a filter on the whole array, which it would push below
    the token codes and so compute them anew for every place.
    """
    found = []
    for m, mask in enumerate(MASKS):
        places = F.when(F.col("n") >= LEAST_TOKENS, F.sequence(F.lit(0), F.col("n") - SPAN))
        codes = F.transform(places, lambda i: F.xxhash64(F.lit(m), *[F.get("t", i + o) for o in mask]))
        held = F.transform(codes, lambda h, i: F.when(_passes(h, test), F.struct(F.lit(m).alias("mask"), h.alias("seed"), i.alias("at"))))
        found.append(F.array_compact(held))
    hits = rows.select(*keep, "t", F.concat(*found).alias("hits"))
    full = hits.select(*keep, F.transform("hits", lambda x: F.struct(x["mask"].alias("mask"), x["seed"].alias("seed"), x["at"].alias("at"), _around(x["at"]).alias("around"))).alias("hits"))
    return full.select(*keep, F.inline_outer("hits")).where("mask IS NOT NULL")


def _passes(seed: Column, table: Column | None) -> Column:
    if table is None:
        return F.lit(True)
    slot = seed.bitwiseAND(F.lit((1 << BITS) - 1))
    return F.getbit(F.get(table, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")) == 1


def _bit_table(seeds: DataFrame) -> Column:
    """One bit per low bits of a test seed, as an array of longs folded into the plan; at most 2 ** BITS bits."""
    slot = F.col("seed").bitwiseAND(F.lit((1 << BITS) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    rows = seeds.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).collect()
    table = ["0"] * (1 << (BITS - 6))
    for r in rows:
        table[r["at"]] = str(r["bits"])
    return F.split(F.lit(",".join(table)), ",").cast("array<bigint>")


def _most_agreeing() -> Column:
    """Largest number of agreeing tokens in any window of WINDOW places that the two surroundings span."""
    same = F.zip_with("around", "item_around", lambda a, b: F.when(a == b, 1).otherwise(0))
    sums = F.transform(F.sequence(F.lit(1), F.lit(WINDOW + SPAN + 1)), lambda i: F.aggregate(F.slice(same, i, WINDOW), F.lit(0), lambda s, x: s + x))
    return F.array_max(sums)


def overlaps(docs: DataFrame, items: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(keep..., item_id, agreeing): every item that a text overlaps, with the agreeing tokens of the best window."""
    tests = _coded(items.select(F.col(item_col).alias("item_id"), F.col(item_text).alias("text")), [F.col("item_id")])
    test_seeds = stage(_seeds(tests.select(F.struct("item_id", "n").alias("item"), "t", "n"), ["item"], None).select(
        F.col("item.item_id").alias("item_id"), F.col("item.n").alias("item_n"), "mask", "seed", F.col("around").alias("item_around")), "test-seeds")
    rows = _coded(docs.select(*keep, F.col(text_col).alias("text")), [F.col(c) for c in keep])
    hits = _seeds(rows, keep, _bit_table(test_seeds)).drop("at")
    joined = hits.join(sized(test_seeds, BROADCAST_SEEDS), ["mask", "seed"])
    checked = joined.select(*keep, "item_id", "item_n", _most_agreeing().alias("agreeing"))
    enough = F.when(F.col("item_n") < WINDOW, F.col("agreeing") >= F.col("item_n")).otherwise(F.col("agreeing") >= WINDOW - SUBSTITUTIONS)
    return checked.where(enough).groupBy(*keep, "item_id").agg(F.max("agreeing").alias("agreeing"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """The rows of ``docs`` that overlap no item, with exactly their columns."""
    keyed = docs.select(F.struct("*").alias("row"), row_key(F.col(id_col), F.col("text")).alias("own"))
    bad = overlaps(docs.select(row_key(F.col(id_col), F.col("text")).alias("own"), "text"), items, ["own"], **columns)
    bad = stage(bad.select("own").distinct(), "contaminated")
    return keyed.join(sized(bad, BROADCAST_SEEDS), "own", "left_anti").select("row.*")
