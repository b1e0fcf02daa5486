"""Extractive answers: the best sentences of the retrieved passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import regex as rx
from tidemark.functions import text as tx
from tidemark.operators import turns as tn
from tidemark.operators.ordered import top_k

PASSAGES, SENTENCES, SENTENCE_CHARS = 5, 4, 250


def type_bonus(kind: Column, sentence: Column) -> Column:
    """Bonus of a sentence for the kind of information the question asks for."""
    out = F.lit(0)
    for name, pattern, bonus in rules.ANSWER_BONUS:
        out = out + F.when((kind == name) & rx.matches(sentence, pattern), bonus).otherwise(0)
    return out


def qualifier_bonus(asked: Column, low: Column) -> Column:
    """Reward sentences about the asked student group, penalise those about another one."""
    def has(q):
        return F.array_contains(asked, q)

    def seen(pattern):
        return rx.matches(low, pattern)

    out = F.aggregate(asked, F.lit(0), lambda acc, q: acc + F.when(F.contains(low, q), 4).otherwise(0))
    foreign, home = F.contains(low, F.lit("international")), seen(r"\b(uk|home|domestic)\b")
    pg, ug = seen(r"\bpostgraduate\b|\bmaster"), seen(r"\bundergraduate\b")
    return (
        out + F.when(has("international") & home & ~foreign, -4).otherwise(0)
        + F.when(has("home") & foreign & ~home, -4).otherwise(0)
        + F.when(has("postgraduate") & ug & ~pg, -2).otherwise(0)
        + F.when(has("undergraduate") & pg & ~ug, -2).otherwise(0)
    )


def compose(hits: DataFrame, query_id: str = "item_id", footer: str = "") -> DataFrame:
    """(query, answer, n_sentences) from (query, rnk, score, query_text, text) hits.

    Sentences of the top passages are scored, equal sentences kept once (first
    passage wins), and at most four per query are gathered.
    """
    q = F.col("query_text")
    clean = F.regexp_replace(F.lower(q), r"[^\w\s]", " ")
    terms = F.filter(F.split(clean, r"\s+"), lambda t: (F.char_length(t) > 2) & ~t.isin(*rules.EN_STOP))
    # sentence scoring is heavy per row, so the few hits are spread out first
    spread = hits.where(F.col("rnk") <= PASSAGES).repartition(hits.sparkSession.sparkContext.defaultParallelism, query_id, "rnk")
    base = spread.select(
        query_id, "rnk", "score", terms.alias("_terms"), tn.question_type(q).alias("_kind"), tn.qualifiers(q).alias("_quals"),
        F.posexplode(F.split(tx.squeeze(F.col("text")), r"(?<=[.!?])\s+")).alias("_pos", "_s"))
    low = F.lower("_s")
    overlap = F.aggregate("_terms", F.lit(0), lambda acc, t: acc + F.when(
        F.contains(low, t), F.when(F.char_length(t) <= 3, 2).otherwise(1)).otherwise(0))
    relevance = overlap + type_bonus(F.col("_kind"), F.col("_s")) + qualifier_bonus(F.col("_quals"), low)
    key = F.trim(F.regexp_replace(tx.squeeze(low), r"[^\w\s]", ""))
    scored = base.select(query_id, "rnk", "_pos", key.alias("_key"), relevance.alias("_rel"), F.col("score").alias("_p"),
                         F.trim("_s").alias("_s")).where(F.char_length("_key") >= 20)
    once = scored.groupBy(query_id, "_key").agg(F.min(F.struct("rnk", "_pos", "_rel", "_p", "_s")).alias("_b")).select(query_id, "_b.*")
    order = [F.desc("_rel"), F.desc("_p"), F.col("rnk"), F.col("_pos")]
    best = top_k(once, [query_id], order, SENTENCES, "_place")
    short = F.when(F.char_length("_s") > SENTENCE_CHARS, F.concat(F.substring("_s", 1, SENTENCE_CHARS - 3), F.lit("…"))).otherwise(F.col("_s"))
    chosen = best.groupBy(query_id).agg(F.sort_array(F.collect_list(F.struct("_place", short.alias("s")))).alias("_c"))
    one, two, three = (F.get("_c", F.lit(i))["s"] for i in range(3))
    body = F.array_compact(F.array(one, F.when(two != one, two)))
    third = F.when(~F.exists(body, lambda b: F.contains(b, F.substring(three, 1, 30))), three)
    lines = F.concat(body, F.array_compact(F.array(third)))
    return chosen.select(query_id, F.concat(F.array_join(lines, " "), F.lit(footer)).alias("answer"),
                         F.size(lines).alias("n_sentences"))
