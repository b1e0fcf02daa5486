"""Corpus construction: question-answer pairs, filters, chunks, incremental writes."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import lang as lg
from tidemark.functions import regex as rx
from tidemark.functions import text as tx
from tidemark.functions.chunk import chunks


# ------------------------------------------------------------------ pairs
def first_qa(turns: DataFrame) -> DataFrame:
    """(conv_id, question, answer): first user and first assistant text, independently."""
    def first(role):
        mine = F.col("role") == role
        return tx.strip(F.min_by(F.when(mine, F.col("text")), F.when(mine, F.col("turn"))))

    return turns.groupBy("conv_id").agg(first("user").alias("question"), first("assistant").alias("answer")).where(
        "question IS NOT NULL AND answer IS NOT NULL")


def pair_from_record(messages: Column | None = None, conversations: Column | None = None,
                     flat: list[tuple[Column, Column]] = ()) -> Column:
    """struct<question,answer> from the three chat layouts, first layout that yields both sides."""
    def first(items, field, names, value):
        return F.get(F.filter(items, lambda m: m[field].isin(*names)), F.lit(0))[value]

    found = []
    if messages is not None:
        found.append((first(messages, "role", ["user"], "content"), first(messages, "role", ["assistant"], "content")))
    if conversations is not None:
        found.append((first(conversations, "from", ["human", "user"], "value"),
                      first(conversations, "from", ["gpt", "assistant"], "value")))
    found += [(F.nullif(q, F.lit("")), F.nullif(a, F.lit(""))) for q, a in flat]
    return F.coalesce(*[
        F.when(q.isNotNull() & a.isNotNull(), F.struct(tx.strip(q).alias("question"), tx.strip(a).alias("answer")))
        for q, a in found])


def utterances(rows: DataFrame, *arrays: str) -> DataFrame:
    """Non-empty utterances of the first given dialogue array."""
    return rows.select(F.explode(F.coalesce(*[F.col(a) for a in arrays])).alias("utterance")).where("utterance <> ''")


def qa_documents(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "conv_id", F.substring("question", 1, rules.TITLE_CHARS).alias("title"),
        F.concat(F.lit("Q: "), "question", F.lit("\n\nA: "), "answer").alias("text"),
        F.when(answer_is_welsh(F.col("answer")), "cy").alias("lang"))


def append_new(fresh: DataFrame, stored: DataFrame, key: str = "question") -> DataFrame:
    """Rows whose key is not stored yet; repeats inside the new batch are kept."""
    return fresh.join(stored.select(key).distinct(), key, "left_anti")


def join_aliases(answers: Column) -> Column:
    """Trimmed non-empty answers joined with a slash."""
    return F.array_join(F.filter(F.transform(answers, tx.strip), lambda a: a != ""), " / ")


# ---------------------------------------------------------------- filters
def answer_is_welsh(text: Column) -> Column:
    """One diacritic or two distinct function words."""
    shared = F.array_intersect(tx.letter_tokens(text), tx.words(rules.ANSWER_WORDS))
    return rx.matches(text, rules.CIRCUMFLEX) | (F.size(shared) >= 2)


def relevant(text: Column, pattern: str) -> Column:
    return rx.matches(text, pattern, unicode_words=True)


def in_band(text: Column, low: int, high: int) -> Column:
    return F.char_length(text).between(low, high)


def bounded_sample(rows: DataFrame, order: str, n: int, keep: Column) -> DataFrame:
    """The first n rows scanned, then the filter; never the other way round."""
    return rows.orderBy(order).limit(n).where(keep)


# -------------------------------------------------------------- documents
def passage_records(raw: DataFrame, text_keys: list[str], title_keys: list[str], position: str) -> DataFrame:
    """(title, text) with fallbacks between key names; empty texts drop out."""
    def given(keys):
        return F.coalesce(*[F.nullif(F.col(k), F.lit("")) for k in keys])

    title = F.coalesce(given(title_keys), F.concat(F.lit("corpus_"), F.col(position).cast("string")))
    return raw.select(title.alias("title"), tx.strip(given(text_keys)).alias("text")).where("text <> ''")


def chunk_documents(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, chunk, lang): overlapping chunks, language tagged per chunk."""
    out = docs.select(key, F.posexplode(chunks(F.col(text))).alias("pos", "chunk"))
    return out.withColumn("lang", lg.quick_or_english(F.col("chunk")))


def fact_documents(facts: DataFrame) -> DataFrame:
    """One passage per fact, not chunked."""
    text = tx.strip(F.coalesce(F.nullif("answer_en", F.lit("")), F.col("answer_cy")))
    return facts.select(F.col("id").alias("title"), text.alias("text"), F.lit("facts").alias("source"),
                        lg.quick_or_english(text).alias("lang")).where("text <> ''")


def response_documents(responses: DataFrame) -> DataFrame:
    """One passage per intent response; the legacy list shape has its language detected."""
    buckets = F.map_from_entries(F.array(
        F.struct(F.lit("en").alias("k"), F.coalesce("responses_en", F.array()).alias("v")),
        F.struct(F.lit("cy").alias("k"), F.coalesce("responses_cy", F.array()).alias("v")),
        F.struct(F.lit("").alias("k"), F.coalesce("responses_list", F.array()).alias("v")),
    ))
    rows = responses.select("tag", F.explode(buckets).alias("_lang", "_items")).select(
        "tag", "_lang", F.explode("_items").alias("_text"))
    text = tx.strip(F.col("_text"))
    lang = F.when(F.col("_lang") != "", F.col("_lang")).otherwise(lg.quick_or_english(text))
    return rows.select(F.col("tag").alias("title"), text.alias("text"), lang.alias("lang")).where("text <> ''")


# ------------------------------------------------------------- embeddings
def content_hash(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 16)


def embedding_text(topics: Column, content: Column) -> Column:
    return tx.strip(F.concat_ws("\n", F.array_join(topics, " "), F.coalesce(content, F.lit(""))))


def refresh_plan(corpus: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """(key, hash, action): reuse unchanged vectors, recompute stale or new ones."""
    met = corpus.join(cache.select(key, F.col("hash").alias("_cached")), key, "left")
    action = F.when(F.col("_cached").isNull(), "new").when(F.col("_cached") != F.col("hash"), "stale").otherwise("reuse")
    return met.withColumn("action", action).drop("_cached")


def hashing_vectoriser(dim: int = 64) -> Callable[[Column], Column]:
    """Default pluggable vectoriser: signed feature hashing, unit length."""

    @F.pandas_udf("array<float>")
    def vectorise(texts: pd.Series) -> pd.Series:
        def one(text):
            v = np.zeros(dim)
            for token in (text or "").lower().split():
                h = zlib.crc32(token.encode())
                v[h % dim] += 1.0 if h & 0x80000000 else -1.0
            norm = np.linalg.norm(v)
            return (v / norm if norm else v).astype(np.float32)

        return texts.map(one)

    return vectorise


# ------------------------------------------------------------------ sinks
def append_passages(spark: SparkSession, docs: DataFrame, path: str) -> None:
    """Append passages whose content key is not stored, partitioned by language.

    Keys are content hashes, so a re-run adds nothing.
    """
    keyed = docs.withColumn("key", F.sha1(F.concat_ws("\x1f", "title", "text"))).dropDuplicates(["key"])
    if not is_built(spark, path):
        keyed.write.mode("overwrite").partitionBy("lang").parquet(path)
        return
    stored = spark.read.parquet(path).select("key")
    keyed.join(stored, "key", "left_anti").write.mode("append").partitionBy("lang").parquet(path)


def is_built(spark: SparkSession, path: str) -> bool:
    """Whether a store already holds rows (build-if-empty)."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hadoop_path)) and not spark.read.parquet(path).isEmpty()
