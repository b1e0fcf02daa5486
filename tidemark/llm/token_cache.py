"""Token counts through a digest cache.

A count is stored under two digests: SHA-256 of the content (the UTF-8 text; null counts as empty; nothing else is
normalised, because any other change could alter a count) and SHA-256 of the tokenizer file. A run joins its contents
with the stored pairs, sends one row of every distinct missing content to the tokenizer library, appends those counts to
the cache and answers every row from it. Two runs that append the same pair do no harm: pairs are made distinct on read.

Nulls and empty texts count 0 tokens; copies and repeated rows share one count; other columns are not read. Texts are
shuffled once, by a key of their own row, so a large group of copies meets in no task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import body, digest, row_key
from tidemark.session import scratch_path

CACHE_SCHEMA = "content binary, version binary, n_tokens bigint"
TOKEN_LIMIT = 4096
_BATCH = 256


def tokenizer_version(path: str) -> bytes:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).digest()


def _counter(path: str):
    """texts -> token counts by the library that reads this kind of file."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x.ids) for x in model.encode_batch(texts, add_special_tokens=False)]


def encode_counts(missing: DataFrame, path: str) -> DataFrame:
    """(content, text) -> (content, n_tokens), in small batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            count = count or _counter(path)
            for at in range(0, batch.num_rows, _BATCH):
                part = batch.slice(at, _BATCH)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(count(part.column(1).to_pylist()), pa.int64())], ["content", "n_tokens"])

    return missing.mapInArrow(run, "content binary, n_tokens bigint")


def read_cache(spark: SparkSession, cache: str, version: bytes) -> DataFrame:
    """Stored counts of one tokenizer; an empty table where nothing was stored yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "content binary, n_tokens bigint")
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    return stored.where(F.col("version") == F.lit(version)).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, cache: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = TOKEN_LIMIT) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row per input row. ``cache`` is a folder that all executors share."""
    spark, version = docs.sparkSession, tokenizer_version(path)
    rows = docs.select(F.col(id_col).alias("id"), body(F.col(text_col)).alias("text"))
    rows = rows.select("id", digest(F.col("text")).alias("content"), row_key(F.col("id"), F.col("text")).alias("own"), "text")
    first = rows.groupBy("content").agg(F.min("own").alias("own"))
    wanted = first.join(read_cache(spark, cache, version), "content", "left_anti").select("own")
    missing = rows.join(wanted, "own", "left_semi").dropDuplicates(["own"]).select("content", "text")
    fresh = encode_counts(missing, path)
    fresh.select("content", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    sizes = docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("content"),
                        F.octet_length(body(F.col(text_col))).cast("long").alias("n_bytes"))
    out = sizes.join(read_cache(spark, cache, version), "content")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def fresh_cache(spark: SparkSession) -> str:
    return scratch_path(spark, "token-cache")
