"""Feedback intake as a stream: validated rows, rejected rows with a reason, daily volume and health.

Validation is the batch intake rule. The daily figures are an aggregation in update mode: a trigger brings only the days it
changed, and a watermark drops the state of days that no longer change. Each trigger's days land under its batch id in a
folder of their own, so a replay overwrites itself, and a reader takes the newest row of each day: it never meets an empty or
half-written table. Rejected rows go to a quarantine by a second query over the same source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.feedback import clean
from tidemark.session import scratch_path

EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
DAILY = "day string, n bigint, avg_satisfaction double"
#: How late a rating may come and still count.
LATE = "30 days"


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ratings(events: DataFrame) -> DataFrame:
    """Raw feedback of the event table: rating, flags and comment, not yet validated."""
    return events.select(
        "event_id", "ts", (F.col("event_id") % 9 - 1).alias("raw_satisfaction"),
        F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "error", False).alias("helpful"),
        F.lit(None).cast("boolean").alias("correct_language"), F.lit(None).cast("string").alias("comments"))


def rejected(rows: DataFrame) -> DataFrame:
    """Rows that intake refuses, with the reason."""
    rating = F.col("raw_satisfaction")
    reason: Column = F.when(rating.isNull(), "satisfaction is missing").when(rating == 0, "satisfaction is required")
    return rows.select("event_id", "ts", reason.alias("reason")).where("reason IS NOT NULL")


def daily_health(events: DataFrame, late: str = LATE) -> DataFrame:
    """Accepted entries and mean rating per day.

    Event time must be an instant, so the zone-free stamp is read as UTC whatever
    the session zone is; day windows are aligned to UTC.
    """
    zone = F.current_timezone()
    instant = F.from_utc_timestamp(F.col("ts").cast("timestamp"), zone)
    rated = clean(ratings(events)).select(instant.alias("ts"), "satisfaction")
    per_day = rated.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w")).agg(
        F.count("*").alias("n"), F.round(F.avg("satisfaction"), 6).alias("avg_satisfaction"))
    return per_day.select(F.date_format(F.to_utc_timestamp("w.start", zone), "yyyy-MM-dd").alias("day"), "n", "avg_satisfaction")


def newest(spark: SparkSession, out: str) -> DataFrame:
    """The newest figures of every day."""
    rows = spark.read.schema(f"{DAILY}, batch bigint").option("basePath", out).parquet(f"{out}/batch=*")
    best = rows.groupBy("day").agg(F.max_by(F.struct("n", "avg_satisfaction"), "batch").alias("r"))
    return best.select("day", "r.n", "r.avg_satisfaction")


def _drain(df: DataFrame, out: str, offsets: str, mode: str) -> None:
    query = (df.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", offsets)
             .foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}")).start())
    query.awaitTermination()


def take_in(spark: SparkSession, path: str, store: str, files_per_trigger: int = 64, late: str = LATE) -> None:
    """Process what is new in the source; a later call goes on where this one ended."""
    events = read_events(spark, path, files_per_trigger)
    _drain(daily_health(events, late), f"{store}/daily", f"{store}/daily-offsets", "update")
    _drain(rejected(ratings(events)), f"{store}/quarantine", f"{store}/quarantine-offsets", "append")


def run_daily(spark: SparkSession, path: str) -> DataFrame:
    """Drain the source once and read the daily figures."""
    store = scratch_path(spark, "feedback-intake")
    take_in(spark, path, store)
    return newest(spark, f"{store}/daily")
