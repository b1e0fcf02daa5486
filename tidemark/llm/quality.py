"""Quality rules whose cutoffs follow the corpus: quantile digests per language and source.

Five ratios are measured on every whole text. Spark's quantile digests (one per group, built in every task and merged)
give the median and upper quartile of each ratio in its (language, source) group; the cutoff is
``median + spread * max(quartile - median, least)``. Groups under ``min_rows`` rows borrow the digest of their
language, small languages that of the corpus.

Null and empty texts have no words and fail the base rule. A null language or source is a group of its own. Repeated
rows are judged each by itself and alike. Other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import MANY, body, let, sized, stage, words

#: ratio -> (numerator, denominator, least distance of median and quartile that counts)
RATIOS = {
    "symbols": ("n_symbols", "n_words", 0.02),
    "dup_lines": ("n_dup_lines", "n_lines", 0.05),
    "repeats": ("n_repeat_words", "n_words", 0.03),
    "stutter": ("n_stutter", "n_words", 0.02),
    "capitals": ("n_capitals", "word_chars", 0.05),
    "length": ("word_chars", "n_words", 0.5),
}
TWO_SIDED = {"length"}
SPREAD = 6.0
#: A ratio counts against a text only with so many cases behind it.
LEAST_CASES = 4
GROUP_ROWS = 200
#: Relative rank error of the digests is 1 / ACCURACY.
ACCURACY = 10_000
BROADCAST_GROUPS = 200_000

_ROW = "row"


def _repeat_cover(hashes: Column) -> Column:
    """Words inside five-word windows whose hash occurs twice: sort (hash, place), keep equal neighbours, add up the cover."""
    def cover(starts: Column) -> Column:
        steps = F.zip_with(starts, F.slice(starts, 2, MANY), lambda a, b: F.least(F.coalesce(b - a, F.lit(5)), F.lit(5)))
        return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

    def starts(ordered: Column) -> Column:
        pairs = F.zip_with(ordered, F.slice(ordered, 2, MANY), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
        return F.sort_array(F.array_distinct(F.flatten(F.array_compact(pairs))))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(ordered, lambda o: let(starts(o), cover))


def measured(docs: DataFrame, keep: Column) -> DataFrame:
    """One row per input row: ``row`` (what ``keep`` says), lang, source and the measures of the whole text."""
    base = docs.select(keep.alias(_ROW), F.col("lang").cast("string"), F.col("source").cast("string"), body(F.col("text")).alias("text"))
    split = base.select(
        _ROW, "lang", "source", "text", words(F.col("text")).alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    counted = split.select(
        _ROW, "lang", "source",
        F.size("words").alias("n_words"),
        F.length(F.array_join("words", "")).alias("word_chars"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).alias("n_symbols"),
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")).alias("n_capitals"),
        F.size(F.filter(F.zip_with("words", F.slice("words", 2, MANY), lambda a, b: a == b), lambda x: x)).alias("n_stutter"),
        F.when(F.size("words") >= 5, F.transform(F.sequence(F.lit(1), F.size("words") - 4), lambda i: F.xxhash64(F.slice("words", i, F.lit(5)))))
         .otherwise(F.array().cast("array<bigint>")).alias("windows"))
    repeat = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), _repeat_cover(F.col("windows"))).otherwise(0)
    longs = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_capitals", "n_stutter"]
    return counted.select(_ROW, "lang", "source", *[F.col(c).cast("long").alias(c) for c in longs], repeat.cast("long").alias("n_repeat_words"))


def _ratio(name: str) -> Column:
    top, below, _ = RATIOS[name]
    return F.col(top) / F.greatest(F.col(below), F.lit(1))


def cutoffs(measures: DataFrame, spread: float = SPREAD, min_rows: int = GROUP_ROWS, accuracy: int = ACCURACY) -> DataFrame:
    """(lang, source) -> struct of low and high cutoffs for every ratio. Only texts with words count."""
    rows = measures.where("n_words > 0").select("lang", "source", *[_ratio(n).alias(n) for n in RATIOS])
    digests = rows.groupingSets([["lang", "source"], ["lang"], []], "lang", "source").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"),
        *[F.percentile_approx(n, [0.25, 0.5, 0.75], accuracy).alias(n) for n in RATIOS])

    def limits() -> Column:
        out = []
        for n, (_, _, least) in RATIOS.items():
            q = F.col(n)
            out.append((q[1] + spread * F.greatest(q[2] - q[1], F.lit(least))).alias(f"{n}_high"))
            if n in TWO_SIDED:
                out.append((q[1] - spread * F.greatest(q[1] - q[0], F.lit(least))).alias(f"{n}_low"))
        return F.struct(*out)

    levels = stage(digests.select("lang", "source", "level", "n", limits().alias("limits")), "cutoffs")
    own = levels.where("level = 0").select("lang", "source", F.when(F.col("n") >= min_rows, F.col("limits")).alias("own"))
    lang = levels.where("level = 1").select(F.col("lang").alias("l"), F.when(F.col("n") >= min_rows, F.col("limits")).alias("by_lang"))
    whole = levels.where("level = 3").select("limits").first()
    out = own.join(lang, F.col("lang").eqNullSafe(F.col("l")), "left")
    limit = F.coalesce("own", "by_lang")
    if whole:
        limit = F.coalesce(limit, F.struct(*[F.lit(v).alias(k) for k, v in whole["limits"].asDict().items()]))
    return out.select("lang", "source", limit.alias("limits"))


def judged(measures: DataFrame, limits: DataFrame) -> DataFrame:
    """The measures with ``base_failed`` and ``kept``; the join is by group, broadcast only after a count."""
    right = sized(limits.select(F.col("lang").alias("l"), F.col("source").alias("s"), "limits"), BROADCAST_GROUPS)
    joined = measures.join(right, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left").drop("l", "s")
    bad = F.lit(False)
    for n, (top, _, _) in RATIOS.items():
        bad |= (_ratio(n) > F.col("limits")[f"{n}_high"]) & (F.col(top) >= LEAST_CASES)
        if n in TWO_SIDED:
            bad |= _ratio(n) < F.col("limits")[f"{n}_low"]
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return joined.select("*", base.alias("base_failed"), (~base & ~F.coalesce(bad, F.lit(False))).alias("kept")).drop("limits")


def verdicts(docs: DataFrame, keep: Column, **options) -> DataFrame:
    """Measure once, write the measures, take the cutoffs from them, judge every row."""
    measures = stage(measured(docs, keep), "measures")
    return judged(measures, cutoffs(measures, **options))


def quality_filter(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that pass, with exactly their columns."""
    out = verdicts(docs, F.struct("*"), **options)
    return out.where("kept").select(f"{_ROW}.*")
