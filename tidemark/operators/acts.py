"""Dialogue acts of short utterances, mined phrasings and exemplar passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import regex as rx
from tidemark.functions import text as tx

# Example prompts and replies per act; the wording is a parameter of ``exemplars``.
TEMPLATES = [
    ("clarify", "what?", "beth?", "Sorry, let me put that another way. Which part was unclear?"),
    ("acknowledge", "ok", "iawn", "Great. Is there anything else you would like to know?"),
    ("ask_more", "tell me more", "mwy plis", "Happy to. Which part should I expand on?"),
    ("yes_no", "yes", "ie", "Good. Could you tell me which topic you mean?"),
]


def classify(utterance: Column) -> Column:
    """Act of an utterance of at most 60 characters and six words; the whole text must match."""
    text = tx.strip(utterance)
    short = (text != "") & (F.char_length(text) <= 60) & (tx.word_count(text) <= 6)
    families = [(name, "^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")$") for name, patterns in rules.DIALOGUE_ACTS]
    return F.when(short, rx.first_label(text, families))


def mined_phrases(rows: DataFrame, text: str, spark: SparkSession) -> DataFrame:
    """(category, phrase): distinct mined phrasings united with the seeds."""
    mined = rows.select(classify(F.col(text)).alias("category"), F.lower(tx.strip(F.col(text))).alias("phrase"))
    seeds = spark.createDataFrame([(c, p) for c, ps in rules.SEED_PHRASES for p in ps], "category string, phrase string")
    return mined.where("category IS NOT NULL").union(seeds).distinct()


def exemplars(phrases: DataFrame, shown: int | None = None) -> DataFrame:
    """(category, title, content): one passage per act, with its phrasings in sorted order.

    With ``shown``, only the first so many phrasings of an act are gathered.
    """
    from tidemark.operators.ordered import top_k

    first = phrases if shown is None else top_k(phrases, ["category"], [F.col("phrase")], shown)
    quoted = F.transform(F.sort_array(F.collect_list("phrase")), lambda p: F.concat(F.lit('"'), p, F.lit('"')))
    related = first.groupBy("category").agg(F.array_join(quoted, ", ").alias("_related"))
    table = F.lit(None)
    for category, en, cy, reply in TEMPLATES:
        body = F.concat(F.lit(f'Reply to "{en}" ("{cy}"): {reply} Also phrased as: '), F.col("_related"), F.lit("."))
        table = F.when(F.col("category") == category, body).otherwise(table)
    return related.select("category", F.concat(F.lit("How to reply: "), "category").alias("title"), table.alias("content"))
