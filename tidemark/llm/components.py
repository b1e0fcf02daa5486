"""Connected components by alternating star contractions; every round is two joins and two aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stage


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Link the neighbours on one side of every vertex to the least vertex around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("w")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("w")))
    if not larger:
        both = both.where("w < u")
    least = both.groupBy("u").agg(F.min("w").alias("low")).select(F.col("u").alias("v"), F.least("u", "low").alias("m"))
    moved = both.join(least, both["u"] == least["v"]).where("w > u" if larger else "true").select(F.col("w").alias("x"), "m")
    if not larger:
        moved = moved.union(least.select(F.col("v").alias("x"), "m"))
    return moved.where("x <> m").select(F.least("x", "m").alias("a"), F.greatest("x", "m").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (v, root) for every linked vertex; root is the least vertex of its component."""
    edges = stage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        edges = stage(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("b").alias("v"), F.col("a").alias("root")).union(edges.select(F.col("a"), F.col("a")).distinct())
