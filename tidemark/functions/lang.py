"""Language identification expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import regex as rx
from tidemark.functions import text as tx
from tidemark.functions.bits import bit_table, may_hold
from tidemark.session import cut


def looks_welsh(text: Column) -> Column:
    return F.coalesce(rx.matches(text, rules.ORTHOGRAPHY, unicode_words=True), F.lit(False))


def quick_language(text: Column, tokens: Column | None = None) -> Column:
    """Decided by blank text, letters, orthography or a function word; null when undecided."""
    tokens = tx.letter_tokens(text) if tokens is None else tokens
    return (
        F.when(text.isNull() | (tx.strip(text) == ""), "en")
        .when(looks_welsh(text), "cy")
        .when(F.arrays_overlap(tokens, tx.words(rules.FUNCTION_WORDS)), "cy")
        .when(F.size(tokens) == 0, "en")
    )


def quick_or_english(text: Column) -> Column:
    """The detector without a vocabulary table."""
    return F.coalesce(quick_language(text), F.lit("en"))


def detect_language(df: DataFrame, key: str, text: str, vocabulary: DataFrame, english_side: DataFrame,
                    extra_stop: tuple[str, ...] = (), **carry: Column) -> DataFrame:
    """(key, carried columns, lang): the full ladder with a vocabulary table of any size.

    One pass over the texts decides the quick cases and tests every token of the others against a bit table of the
    vocabulary. Only rows with enough possible words are exploded and met with the vocabulary itself.
    """
    stop = [*rules.ENGLISH_STOP, *extra_stop]
    usable = cut(vocabulary.select("term").distinct().join(english_side.select("term"), "term", "left_anti"))
    table = bit_table(usable, "term")
    base = df.select(key, *[c.alias(n) for n, c in carry.items()], F.col(text).alias("_text"), tx.letter_tokens(F.col(text)).alias("_tokens"))
    quick = base.select(key, *carry, "_tokens", F.size("_tokens").alias("_n"), quick_language(F.col("_text"), F.col("_tokens")).alias("_quick"))
    maybe = F.filter("_tokens", lambda t: may_hold(table, t) & ~t.isin(*stop))
    quick = quick.select(key, *carry, "_quick", "_n", F.when(F.col("_quick").isNull(), maybe).alias("_maybe"))

    def welsh(hits: Column) -> Column:
        return F.when(F.col("_n") < 4, hits >= 2).otherwise(hits / F.col("_n") >= 0.5)

    open_ = F.col("_maybe").isNotNull() & welsh(F.size("_maybe"))
    seen = cut(quick.select(key, *carry, "_quick", "_n", F.when(open_, F.col("_maybe")).alias("_maybe")))
    hits = seen.select(key, F.explode("_maybe").alias("term")).join(usable, "term").groupBy(key).agg(F.count(F.lit(1)).alias("_hits"))
    met = seen.join(hits, key, "left")
    return met.select(key, *carry, F.coalesce("_quick", F.when(welsh(F.coalesce("_hits", F.lit(0))), "cy").otherwise("en")).alias("lang"))


def scored_language(df: DataFrame, text: str, out: str, running: Column | None = None,
                    strong: tuple[str, ...] = tuple(rules.SCORED_STRONG),
                    welsh: tuple[str, ...] = tuple(rules.SCORED_WELSH),
                    english: tuple[str, ...] = tuple(rules.SCORED_ENGLISH)) -> DataFrame:
    """Count-based detector with a running-language tie-break."""
    col = F.col(text)
    known = {*strong, *english, *welsh}
    w = df.select("*", tx.scored_words(col).alias("_w"))

    def count(test):
        return F.size(F.filter("_w", test))

    counted = w.select(
        "*",
        count(lambda t: t.isin(*strong)).alias("_strong"),
        count(lambda t: t.isin(*[e for e in english if e not in strong])).alias("_hints"),
        count(lambda t: t.isin(*[x for x in welsh if x not in strong and x not in english])).alias("_other"),
        count(lambda t: ~t.isin(*known) & (F.char_length(t) >= 4) & t.rlike(rules.ENGLISH_SUFFIX)).alias("_morph"),
        F.size("_w").alias("_n"),
    ).select("*", (F.col("_strong") + F.col("_other")).alias("_welsh"), (F.col("_hints") + F.col("_morph")).alias("_english"))
    s, c, e = F.col("_strong"), F.col("_welsh"), F.col("_english")
    run = F.lit(None).cast("string") if running is None else running
    lang = (
        F.when(s >= 2, "cy")
        .when((s >= 1) & (s >= e), "cy")
        .when(rx.matches(col, rules.DIACRITIC_WIDE) & (e <= 1), "cy")
        .when((c >= 3) & (c > e), "cy")
        .when((c >= 2) & (e == 0), "cy")
        .when((F.col("_n") <= 5) & (c >= 1) & (e == 0), "cy")
        .when((e >= 2) & (c == 0), "en")
        .when(e > c, "en")
        .when((run == "cy") & (c >= 1), "cy")
        .when((run == "en") & (e >= 1), "en")
        .when((c >= 1) & (c >= e), "cy")
        .otherwise("en")
    )
    return counted.withColumn(out, lang).drop(
        "_w", "_strong", "_hints", "_other", "_morph", "_n", "_welsh", "_english")


def reply_score_welsh(text: Column) -> Column:
    """Weighted function words, digraph words and diacritics against English words."""
    low = F.lower(text)

    def n(pattern):
        return F.regexp_count(low, F.lit(rx.compile_rule(pattern)))

    score = n(rules.REPLY_FUNCTION) * 2 + n(rules.REPLY_DIGRAPH) + F.when(
        rx.matches(low, rules.DIACRITIC_WIDE), 3).otherwise(0)
    return (F.char_length(text) >= 20) & (score >= 6) & (score >= n(rules.REPLY_ENGLISH))


def reply_is_welsh(text: Column) -> Column:
    """A diacritic, a Welsh greeting lead, or two listed tokens (contractions opened)."""
    tokens = tx.letter_tokens(text)
    parts = F.flatten(F.transform(F.filter(tokens, lambda t: F.contains(t, F.lit("'"))), lambda t: F.split(t, "'")))
    hits = F.size(F.filter(F.concat(tokens, parts), lambda t: t.isin(*rules.REPLY_TOKENS)))
    lead = F.regexp_replace(F.lower(F.split_part(tx.squeeze(text), F.lit(" "), F.lit(1))), r"[!?,.;:]+$", "")
    return rx.matches(text, rules.CIRCUMFLEX) | lead.isin(*rules.REPLY_LEADS) | (hits >= 2)


def reply_is_english(text: Column) -> Column:
    return ~reply_is_welsh(text) & text.rlike("[a-zA-Z]")
