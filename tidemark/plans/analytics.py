"""Registered queries: feedback reports, paging, property parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import feedback as fb
from tidemark.operators.ordered import row_numbers
from tidemark.plans import inputs as src

NOW = "2024-01-31 00:00:00"


def feedback_clean(spark, d):
    return fb.clean(src.feedback(spark, d)).drop("ts")


def feedback_health(spark, d):
    return fb.health(src.feedback(spark, d))


def feedback_hist(spark, d):
    return fb.histogram(src.feedback(spark, d))


def feedback_newest(spark, d):
    return fb.newest_first(src.feedback(spark, d)).select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "satisfaction")


def feedback_since(spark, d):
    now = F.lit(NOW).cast("timestamp_ntz")
    return fb.since(src.feedback(spark, d), 7, now).select("event_id", "satisfaction")


def daily_volume(spark, d):
    return fb.daily_volume(src.feedback(spark, d)).select(F.col("day").cast("string").alias("day"), "n")


def failure_keywords(spark, d):
    low = src.table(spark, d, "labels").where("quality = 0").select("doc_id")
    comments = src.documents(spark, d).join(low, "doc_id", "left_semi").select(F.col("text").alias("comment"))
    return fb.comment_keywords(comments)


def admin_stats(spark, d):
    return fb.admin_stats(src.feedback(spark, d))


def feedback_csv(spark, d):
    return fb.csv_rows(src.feedback(spark, d))


def session_dropoff(spark, d):
    return fb.drop_off_sessions(src.feedback(spark, d))


def props_parse(spark, d):
    parsed = F.from_json("props", "k bigint")["k"]
    return src.table(spark, d, "events").select(
        "event_id", parsed.alias("k"), F.get_json_object("props", "$.missing").alias("missing"),
        F.to_json(F.struct(F.col("event_type").alias("t"))).alias("dumped"))


def paged_scan(spark, d):
    rows = src.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    n = row_numbers(rows, [F.col("o_orderkey")], "n")
    return n.select(
        "o_orderkey", F.floor((F.col("n") - 1) / src.PAGE_SIZE).cast("bigint").alias("page"),
        ((F.col("n") - 1) % src.PAGE_SIZE).alias("position"))


QUERIES = {f.__name__: f for f in (
    feedback_clean, feedback_health, feedback_hist, feedback_newest, feedback_since, daily_volume,
    failure_keywords, admin_stats, feedback_csv, session_dropoff, props_parse, paged_scan)}
