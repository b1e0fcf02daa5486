"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import scratch_path

#: White space between words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"


#: As a length: to the end of the array.
MANY = 1 << 30


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, though it is used several times inside lambdas."""
    return F.transform(F.array(value), use)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def body(text: Column) -> Column:
    """The text, empty where there is none."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Runs of other characters than white space, in order; no words in a null text."""
    return F.array_remove(F.split(body(text), BLANKS), "")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(body(text), 256))


def row_key(*columns: Column) -> Column:
    """128 bits that stand for a row; nulls differ from every value."""
    parts = [p for c in columns for p in (c.isNull(), c)]
    return F.struct(F.xxhash64(F.lit(17), *parts).alias("a"), F.xxhash64(F.lit(40503), *parts).alias("b"))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later steps reread it, also after an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint if a count shows at most so many rows; beyond, Spark shuffles both sides of the join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
