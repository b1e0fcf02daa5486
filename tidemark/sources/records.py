"""Readers for the stored record shapes: JSON passages, lexicons, vectors, TSV, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PASSAGE = "struct<text:string,content:string,title:string,heading:string,lang:string,source:string,url:string>"
CHAT = ("messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, "
        "prompt string, response string, question string, answer string, input string, instruction string, output string")
FEEDBACK = "timestamp string, satisfaction int, helpfulAnswer boolean, correctLanguage boolean, comments string"
VECTORS = "model string, dim int, ids array<string>, langs array<string>, hashes array<string>, vectors array<array<float>>"


def _list_or_wrapped(spark: SparkSession, path: str, element: str, *wrappers: str) -> DataFrame:
    """Rows of a JSON file that is either a list or an object wrapping the list under a known key."""
    raw = spark.read.text(path, wholetext=True)
    as_list = F.from_json("value", f"array<{element}>")
    wrapped = F.from_json("value", ", ".join(f"{w} array<{element}>" for w in wrappers))
    inner = F.coalesce(*[wrapped[w] for w in wrappers])
    items = F.when(F.startswith(F.ltrim("value"), F.lit("[")), as_list).otherwise(inner)
    return raw.select(F.posexplode(items).alias("pos", "item")).select("pos", "item.*")


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    """Passage records with their position; list or {"passages": [...]}."""
    return _list_or_wrapped(spark, path, PASSAGE, "passages")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Splittable JSON-lines input with an explicit schema; malformed rows become nulls."""
    return spark.read.schema(schema).json(path)


def read_term_map(spark: SparkSession, path: str) -> DataFrame:
    """(cy, en) of a JSON term map or list of pairs; comment keys are dropped."""
    raw = spark.read.text(path, wholetext=True)
    is_list = F.startswith(F.ltrim("value"), F.lit("["))
    flat = raw.where(~is_list).select(F.explode(F.from_json("value", "map<string,string>")).alias("cy", "en"))
    pair = "array<struct<cy:string,welsh:string,en:string,english:string>>"
    rows = raw.where(is_list).select(F.inline(F.from_json("value", pair)))
    listed = rows.select(F.coalesce(F.nullif("cy", F.lit("")), "welsh").alias("cy"),
                         F.coalesce(F.nullif("en", F.lit("")), "english").alias("en"))
    return flat.unionByName(listed).where(~F.startswith(F.col("cy"), F.lit("__")))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed lower-case ``term`` of a JSON list, or of an object that holds the list as terms or words."""
    raw = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", "terms array<string>, words array<string>")
    inner = F.coalesce(F.when(F.size(wrapped["terms"]) > 0, wrapped["terms"]), wrapped["words"])
    items = F.when(F.startswith(F.ltrim("value"), F.lit("[")), F.from_json("value", "array<string>")).otherwise(inner)
    return raw.select(F.explode(items).alias("term")).select(F.lower(F.trim("term")).alias("term")).where("term <> ''").distinct()


def read_vector_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """(id, lang, hash, vec) of parallel arrays; empty vectors dropped, language defaults to en."""
    raw = spark.read.schema(VECTORS).json(path, multiLine=True)
    zipped = F.arrays_zip(F.col("ids").alias("id"), F.col("langs").alias("lang"), F.col("hashes").alias("hash"),
                          F.col("vectors").alias("vec"))
    rows = raw.select(F.inline(zipped))
    return rows.where("id IS NOT NULL AND size(vec) > 0").withColumn("lang", F.coalesce(F.nullif("lang", F.lit("")), F.lit("en")))


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).csv(path)


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    """Stored feedback, newest first; internal ids are not read."""
    rows = spark.read.schema(FEEDBACK).json(path)
    return rows.withColumn("ts", F.try_to_timestamp("timestamp")).orderBy(F.desc("ts"))
