"""Incremental refresh of the embedding store: only passages whose content is new or changed are embedded.

Each trigger keeps the newest version of every id it brings, compares content hashes with the store and embeds what differs.
A trigger's rows land under its batch id in a folder of their own, so a replay overwrites itself; the store is the row of the
highest batch for every id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import corpus as cp

STORED = "id bigint, hash string, vec array<float>, batch bigint"


def current(spark: SparkSession, store: str, before: int | None = None) -> DataFrame:
    """(id, hash, vec, batch): the newest row of every id, of batches before a given one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return spark.createDataFrame([], STORED)
    rows = spark.read.schema(STORED).option("basePath", store).parquet(f"{store}/batch=*")
    if before is not None:
        rows = rows.where(F.col("batch") < before)
    return rows.groupBy("id").agg(F.max_by(F.struct("hash", "vec", "batch"), "batch").alias("r")).select("id", "r.hash", "r.vec", "r.batch")


def refresh(store: str, embed: Callable[[Column], Column]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over (id, version, text)."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        newest = batch.groupBy("id").agg(F.max_by("text", "version").alias("text"))
        hashed = newest.select("id", "text", cp.content_hash(F.col("text")).alias("hash"))
        known = current(batch.sparkSession, store, batch_id).select("id", "hash")
        changed = hashed.join(known, ["id", "hash"], "left_anti")
        changed.select("id", "hash", embed(F.col("text")).alias("vec")).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return merge


def drain(versions: DataFrame, store: str, offsets: str, embed: Callable[[Column], Column]) -> None:
    query = (versions.writeStream.trigger(availableNow=True).option("checkpointLocation", offsets).foreachBatch(refresh(store, embed)).start())
    query.awaitTermination()
