"""Naive Bayes over intents: a term dictionary from merged patterns and log-probabilities as a table.

A pattern counts each of its stemmed terms once. With c(tag) = patterns of the tag + 1 and n(term, tag) = its patterns with
the term, a text with the known terms T scores ``ln(c / all) + sum over T of ln((n + 1) / c)``; terms outside the dictionary
are passed over. Only tags that share a term with a text are joined to it. A tag without one scores by c and the number of
terms alone, so the best of those is the largest tag for a text without known terms and can win for no other text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.stem import stem_table, stemmed
from tidemark.operators.ordered import top_k
from tidemark.session import cut

MAX_BROADCAST_TERMS = 1_000_000


@dataclass(frozen=True)
class Bayes:
    """(term, tag, n, c) and (tag, c) with the number of patterns + 1."""

    terms: DataFrame
    tags: DataFrame
    examples: int
    size: int


def _terms(df: DataFrame, text: Column, *keys: str) -> DataFrame:
    """(keys, term): the distinct stemmed English terms of each row."""
    counted = tx.counted_terms(df.withColumn("lang", F.lit("en")), tx.preprocess(text), *keys, "lang")
    table = stem_table(counted)
    return stemmed(counted, table, *keys).select(*keys, "term")


def train(patterns: DataFrame) -> Bayes:
    """From (tag, pattern); patterns without a term are passed over."""
    rows = cut(patterns.select("tag", F.monotonically_increasing_id().alias("_row"), "pattern"))
    terms = cut(_terms(rows, F.col("pattern"), "tag", "_row"))
    tags = terms.groupBy("tag").agg((F.count_distinct("_row") + 1).alias("c"))
    tags = cut(tags)
    per_term = cut(terms.groupBy("term", "tag").agg(F.count(F.lit(1)).alias("n")).join(tags, "tag").select("term", "tag", "n", "c"))
    return Bayes(per_term, tags, 1 + (tags.agg(F.sum(F.col("c") - 1)).first()[0] or 0), per_term.count())


def classify(model: Bayes, queries: DataFrame, query_id: str, text: str = "text") -> DataFrame:
    """(query, tag, score): the likeliest tag of every text, ties by name."""
    asked = queries.select(query_id, F.col(text).alias("_text"))
    known = model.terms.select("term").distinct()
    side = F.broadcast if model.size <= MAX_BROADCAST_TERMS else (lambda df: df)
    mine = cut(_terms(asked, F.col("_text"), query_id).join(side(known), "term"))
    m = mine.groupBy(query_id).agg(F.count(F.lit(1)).alias("m"))
    shared = mine.join(side(model.terms), "term").groupBy(query_id, "tag", "c").agg(F.sum(F.log(F.col("n") + 1)).alias("gain"))
    scored = shared.join(m, query_id).select(
        query_id, "tag", F.round(F.log(F.col("c") / model.examples) + F.col("gain") - F.col("m") * F.log("c"), 6).alias("score"))
    best = top_k(scored, [query_id], [F.desc("score"), F.col("tag")], 1).drop("rnk")
    largest = model.tags.orderBy(F.desc("c"), "tag").first()
    if largest is None:
        return best
    prior = F.round(F.log(F.lit(largest["c"]) / model.examples), 6)
    rest = asked.select(query_id).join(best, query_id, "left_anti")
    return best.unionByName(rest.select(query_id, F.lit(largest["tag"]).alias("tag"), prior.alias("score")))
