"""Tokenisers and small text expressions, all JVM-side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules


def words(values: Sequence[str]) -> Column:
    """A fixed word list as one literal array (folded to a constant by the optimiser)."""
    return F.array(*[F.lit(v) for v in dict.fromkeys(values)])


def index_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits used by the sparse index."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-zâêîôûŵŷ0-9]+"), F.lit(0))


def letter_tokens(text: Column) -> Column:
    """Lower-cased runs of letters and apostrophes used by language rules."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-zâêîôûŵŷ']+"), F.lit(0))


_LETTER, _OTHER = "[a-zâêîôûŵŷ']", "[^a-zâêîôûŵŷ']"


def first_tokens(low: Column, n: int) -> Column:
    """The first n letter tokens of a lower-cased text, one space between them; empty without any."""
    lead = F.regexp_extract(low, rf"^{_OTHER}*({_LETTER}+(?:{_OTHER}+{_LETTER}+){{0,{n - 1}}})", 1)
    return F.regexp_replace(lead, f"{_OTHER}+", " ") if n > 1 else lead


def last_token(low: Column) -> Column:
    """The last letter token of a lower-cased text, empty without any; the rest of the text is not tokenised."""
    return F.regexp_extract(low, rf"(?s)^(?:.*{_OTHER})?({_LETTER}+)", 1)


def _runs(text: Column, kept: str) -> Column:
    """Lower-cased runs of the given characters; found directly, which costs a quarter of splitting at all others."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{kept}]+"), F.lit(0))


def latin_tokens(text: Column) -> Column:
    """Lower-cased tokens split on anything outside Latin letters and digits."""
    return _runs(text, "a-zÀ-ÿŵŷ0-9")


def content_tokens(text: Column, min_chars: int, stop: Sequence[str]) -> Column:
    found = F.split(F.lower(text), "[^a-zÀ-ÿŵŷ0-9]+")
    return F.filter(found, lambda t: (t != "") & (F.char_length(t) >= min_chars) & ~t.isin(*stop))


def word_runs(text: Column) -> Column:
    """Lower-cased word tokens keeping apostrophes, punctuation blanked."""
    return _runs(text, r"\wÀ-ɏ'")


def scored_words(text: Column) -> Column:
    return _runs(text, "a-zÀ-ɏ'")


def computed(df: DataFrame, *carry: str, **columns: Column) -> DataFrame:
    """Carried and new columns; the new ones are worked out once a row, however often later filters name them.

    A filter on a plain column is pushed below it and repeats its work; one on a generator's output is not.
    """
    made = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_c")
    return df.select(*carry, made).select(*carry, *[F.col(f"_c.{n}").alias(n) for n in columns])


def keywords(text: Column, limit: int) -> Column:
    """First content words in order, currency and address punctuation kept."""
    kept = F.filter(
        _runs(text, r"\w£$€@.:/\-"),
        lambda w: (F.char_length(w) > 2) & ~w.isin(*rules.KEYWORD_STOP),
    )
    return F.slice(kept, 1, limit)


def preprocess(text: Column, stop: Sequence[str] = tuple(rules.EN_STOP)) -> Column:
    """Tokens of length two or more outside a stoplist (``stem`` stems counted terms)."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\wÀ-ɏ]{2,}"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*stop))


def preprocess_by(text: Column, lang: Column) -> Column:
    """``preprocess`` with the stoplist of the language: Welsh for ``cy``, else English."""
    return F.when(lang == "cy", preprocess(text, rules.CY_STOP)).otherwise(preprocess(text))


def word_count(text: Column) -> Column:
    """Number of blank-separated words; zero for blank text."""
    trimmed = squeeze(text)
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))


def squeeze(text: Column) -> Column:
    """Collapse runs of white space and trim."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip(text: Column) -> Column:
    """Trim every kind of white space at both ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\f\r"))


def present(text: Column) -> Column:
    """Blank strings count as missing."""
    return F.nullif(strip(text), F.lit(""))


def first_present(*texts: Column) -> Column:
    return F.coalesce(*[present(t) for t in texts])


def counted_terms(df: DataFrame, tokens: Column, *carry: str) -> DataFrame:
    """(carried columns, dl, place, term, tf) by sorting each token list and measuring run lengths.

    Row-local, so postings need no shuffle and no per-document grouping.  The
    sorted list and the run starts are columns of their own: a lambda would
    recompute an inlined expression for every element.
    """
    ordered = df.select(*carry, F.sort_array(tokens).alias("_s"))
    starts = F.filter(
        F.when(F.size("_s") > 0, F.sequence(F.lit(1), F.size("_s"))).otherwise(F.array().cast("array<int>")),
        lambda i: (i == 1) | (F.get("_s", i - 1) != F.get("_s", i - 2)),
    )
    runs = ordered.select(*carry, "_s", starts.alias("_at"))
    counted = F.transform(
        "_at",
        lambda i, pos: F.struct(
            F.get("_s", i - 1).alias("term"),
            (F.coalesce(F.get("_at", pos + 1), F.size("_s") + 1) - i).cast("long").alias("tf"),
        ),
    )
    # the outer form keeps the optimiser from copying the list work into a filter
    return (
        runs.select(*carry, F.size("_s").alias("dl"), F.posexplode_outer(counted).alias("place", "_t"))
        .where("_t IS NOT NULL")
        .select(*carry, "dl", "place", F.col("_t.term").alias("term"), F.col("_t.tf").alias("tf"))
    )
