"""Registered queries: the streams, drained once over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import corpus as cp
from tidemark.plans import inputs as src
from tidemark.session import scratch_path
from tidemark.streaming import feedback, turns, vectors


def stream_feedback_daily(spark, d):
    return feedback.run_daily(spark, f"{d}/events*.parquet")


def stream_turn_state(spark, d):
    return turns.run_turn_states(spark, f"{d}/conversations*.parquet")


def stream_embed_refresh(spark, d):
    """Three versions of the documents, one a trigger: the second changes every seventh, the third brings those left out."""
    docs = src.documents(spark, d)
    text = cp.embedding_text(F.array("source"), F.col("text"))
    first = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), text.alias("text"))
    edited = F.when(F.col("doc_id") % 7 == 0, F.concat(text, F.lit("x"))).otherwise(text)
    second = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), edited.alias("text"))
    third = docs.select(F.col("doc_id").alias("id"), edited.alias("text"))
    source, store, offsets = (scratch_path(spark, n) for n in ("versions", "vector-store", "vector-offsets"))
    for version, rows in enumerate((first, second, third), 1):
        rows.select("id", F.lit(version).alias("version"), "text").write.mode("append").parquet(source)
        stream = spark.readStream.schema("id bigint, version int, text string").parquet(source)
        vectors.drain(stream, store, offsets, cp.hashing_vectoriser())
    return vectors.current(spark, store).select("id", "hash", (F.col("batch") + 1).alias("embedded_in"), F.size("vec").cast("bigint").alias("dim"))


QUERIES = {f.__name__: f for f in (stream_feedback_daily, stream_turn_state, stream_embed_refresh)}
