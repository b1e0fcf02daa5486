"""Feedback intake and reports: each report is one pass of distributive aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.operators.ordered import row_numbers

COMMENT_CHARS = 300


def clean(rows: DataFrame) -> DataFrame:
    """Reject missing or zero ratings, clamp to 1..5, keep flags three-valued, cut comments."""
    rating = F.col("raw_satisfaction")
    return rows.where(rating.isNotNull() & (rating != 0)).select(
        "event_id", "ts",
        F.least(F.lit(5), F.greatest(F.lit(1), rating)).cast("bigint").alias("satisfaction"),
        "helpful", "correct_language",
        F.coalesce(F.substring("comments", 1, COMMENT_CHARS), F.lit("")).alias("comments"),
    )


def percent(part: Column, whole: Column) -> Column:
    """One-decimal percentage, null when there is nothing to divide by."""
    return F.round(F.try_divide(part * 100.0, whole), 1)


def health(rows: DataFrame) -> DataFrame:
    """Overall health; the flag percentages are of rated rows only."""
    hit = F.count_if
    agg = rows.agg(
        F.count("*").alias("n"), F.round(F.avg("satisfaction"), 2).alias("avg_satisfaction"),
        hit(F.col("helpful")).alias("helpful"), hit(~F.col("helpful")).alias("unhelpful"),
        hit(F.col("correct_language")).alias("correct"), hit(~F.col("correct_language")).alias("wrong"),
        hit(F.col("satisfaction") <= 2).alias("low"), hit(F.col("satisfaction") >= 4).alias("high"),
    )
    return agg.select(
        "n", "avg_satisfaction",
        percent(F.col("helpful"), F.col("helpful") + F.col("unhelpful")).alias("helpful_pct"),
        percent(F.col("correct"), F.col("correct") + F.col("wrong")).alias("correct_pct"),
        percent(F.col("low"), F.col("n")).alias("low_pct"), percent(F.col("high"), F.col("n")).alias("high_pct"),
        # the alert compares wrong with correct, not with all rated rows
        (F.col("wrong") > F.col("correct") * 0.15).alias("language_alert"),
    )


def histogram(rows: DataFrame) -> DataFrame:
    """Counts for ratings 1..5 including zeros, one pass."""
    counts = rows.agg(*[F.count_if(F.col("satisfaction") == s).alias(f"s{s}") for s in range(1, 6)])
    pairs = ", ".join(f"{s}, s{s}" for s in range(1, 6))
    return counts.selectExpr(f"stack(5, {pairs}) AS (satisfaction, n)").select(
        F.col("satisfaction").cast("bigint").alias("satisfaction"), "n")


def newest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("ts"), F.desc("event_id"))


def since(rows: DataFrame, days: int, now: Column) -> DataFrame:
    """Rows of the last ``days`` days before ``now``; no-op for a non-positive span."""
    if days <= 0:
        return rows
    return rows.where(F.col("ts") >= now - F.make_dt_interval(F.lit(days)))


def daily_volume(rows: DataFrame, days: int = 14) -> DataFrame:
    per_day = rows.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return per_day.orderBy(F.desc("day")).limit(days).orderBy("day")


def comment_keywords(comments: DataFrame, top: int = 12) -> DataFrame:
    """Most frequent words of comments longer than three characters."""
    text = F.lower(F.trim("comment"))
    word = comments.where(F.char_length(text) > 3).select(F.explode(F.split(text, "[^a-zA-ZÀ-ÿŵŷ]+")).alias("word"))
    kept = word.where((F.char_length("word") > 2) & ~F.col("word").isin(*rules.COMMENT_STOP))
    return kept.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)


def admin_stats(rows: DataFrame) -> DataFrame:
    """Dashboard figures; here the flag percentages are of all rows."""
    whole = F.count("*")

    def share(flag):
        return F.floor(F.try_divide(F.count_if(flag) * 100.0, whole) + 0.5).cast("bigint")

    return rows.agg(
        whole.alias("total"), F.round(F.avg("satisfaction"), 1).alias("avg_satisfaction"),
        share(F.col("helpful")).alias("helpful_pct"), share(F.col("correct_language")).alias("lang_pct"),
        F.count_if(F.trim(F.coalesce("comments", F.lit(""))) != "").alias("with_comments"),
    )


def _yes_no(flag: str) -> Column:
    return F.when(F.col(flag), "Yes").when(~F.col(flag), "No").otherwise("")


def export_rows(rows: DataFrame) -> DataFrame:
    """Export rows: running number newest first, Yes/No/blank flags, comments as they are."""
    return row_numbers(rows, [F.desc("ts"), F.desc("event_id")]).select(
        "row_no", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.col("satisfaction").alias("rating"),
        _yes_no("helpful").alias("helpful"), _yes_no("correct_language").alias("correct_language"),
        F.coalesce("comments", F.lit("")).alias("comments"),
    )


def csv_rows(rows: DataFrame) -> DataFrame:
    """The export with comments quoted as a CSV line shows them."""
    quoted = F.concat(F.lit('"'), F.replace("comments", F.lit('"'), F.lit('""')), F.lit('"'))
    return export_rows(rows).withColumn("comments", quoted)


def write_csv(rows: DataFrame, path: str) -> None:
    """The export as CSV part files; the writer alone quotes."""
    export_rows(rows).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def drop_off_sessions(rows: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Sessions per user closed by a gap; flagged when the last rating is low.

    Gaps are cut inside (user, day) first, so a very active user is spread over
    days, and only the session summaries meet per user to be joined across midnight.
    """
    seconds = gap_minutes * 60
    order = [F.col("ts"), F.col("event_id")]
    day = W.partitionBy("user_id", "_day").orderBy(*order)
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    stamped = rows.withColumn("_day", F.to_date("ts")).withColumn("_t", t)
    opened = stamped.withColumn("_new", (F.col("_t") - F.lag("_t").over(day) > seconds * 1_000_000).cast("int"))
    numbered = opened.withColumn("_s", F.sum(F.coalesce("_new", F.lit(0))).over(day))
    parts = numbered.groupBy("user_id", "_day", "_s").agg(
        F.min("_t").alias("_from"), F.max("_t").alias("_to"), F.count("*").alias("_n"),
        F.max_by("satisfaction", F.struct("ts", "event_id")).alias("_last"))
    per_user = W.partitionBy("user_id").orderBy("_from")
    joined = parts.withColumn(
        "_new", F.coalesce((F.col("_from") - F.lag("_to").over(per_user) > seconds * 1_000_000).cast("int"), F.lit(1)))
    whole = joined.withColumn("session_no", F.sum("_new").over(per_user))
    return whole.groupBy("user_id", "session_no").agg(
        F.sum("_n").alias("n_events"), F.max_by("_last", "_from").alias("last_satisfaction"),
    ).withColumn("dropped_off", F.col("last_satisfaction") <= 2)
