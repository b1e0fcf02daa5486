"""English suffix stripping (the classic five-step algorithm) as a vectorised function."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.slices import slices


# Fixed values: (suffix, replacement) pairs of the derivational steps.
_STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
          ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
          ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
          ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
_STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
_STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate",
          "iti", "ous", "ive", "ize"]
#: The same as replacements and as one tuple, which a word is held against in a single call.
_RULES = [(dict(table), tuple(s for s, _ in table)) for table in (_STEP2, _STEP3)]
_ENDS4 = tuple(_STEP4)


def _shape(word: str) -> str:
    """v for vowels, c for consonants; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _m(stem: str) -> int:
    return len(re.findall("v+c+", _shape(stem)))


def _short(stem: str) -> bool:
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, suffixes: tuple[str, ...]) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len) if word.endswith(suffixes) else None


@lru_cache(maxsize=65_536)
def stem(word: str) -> str:
    if len(word) < 3 or not word.isascii():
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _m(word[:-3]) > 0 else word
    else:
        cut = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s) and "v" in _shape(word[: -len(s)])), None)
        if cut is not None:
            if cut.endswith(("at", "bl", "iz")):
                word = cut + "e"
            elif len(cut) > 1 and cut[-1] == cut[-2] and _shape(cut)[-1] == "c" and cut[-1] not in "lsz":
                word = cut[:-1]
            else:
                word = cut + "e" if _m(cut) == 1 and _short(cut) else cut
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    for changed, ends in _RULES:
        suffix = _longest(word, ends)
        if suffix and _m(word[: -len(suffix)]) > 0:
            word = word[: -len(suffix)] + changed[suffix]
    suffix = _longest(word, _ENDS4)
    if suffix:
        base = word[: -len(suffix)]
        if _m(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
            word = base
    if word.endswith("e"):
        base = word[:-1]
        if _m(base) > 1 or (_m(base) == 1 and not _short(base)):
            word = base
    if word.endswith("ll") and _m(word) > 1:
        word = word[:-1]
    return word


#: Every ending that a step of ``stem`` takes, at the end of an ASCII word of three letters or more.
_TAKEN = "^[[:ascii:]]{2,}(?:[sye]|ed|ing|ll|" + "|".join(sorted({e for _, ends in _RULES for e in ends} | set(_ENDS4))) + ")$"


def stemmed_words(words: pa.Array) -> pa.Array:
    """The stem of every word; only words with an ending that a step takes become Python objects."""
    words = words.cast(pa.string())
    able = pc.match_substring_regex(words, _TAKEN)
    return pc.replace_with_mask(words, able.fill_null(False), pa.array([stem(w) for w in words.filter(able).to_pylist()], pa.string()))


@F.pandas_udf(T.StringType())
def _one(terms: pd.Series) -> pd.Series:
    return terms.map(stem)


def stem_table(terms: DataFrame) -> DataFrame:
    """(term, stem) of the distinct terms that stemming changes: each word of a vocabulary is stemmed once."""
    return terms.select("term").distinct().select("term", _one("term").alias("stem")).where("stem <> term")


def stemmed(counted: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """Counted terms (keys, lang, term, tf) with English terms replaced by their stems and equal ones added up."""
    joined = counted.join(table, ["term"], "left")
    term = F.when(F.col("lang") == "en", F.coalesce("stem", "term")).otherwise(F.col("term")).alias("term")
    return joined.groupBy(*keys, term).agg(F.sum("tf").alias("tf"))


def stemmed_lists(tokens: pa.ListArray) -> pa.ListArray:
    """Lists with each word replaced by its stem; a word is stemmed once, and no list becomes Python objects."""
    coded = tokens.flatten().dictionary_encode()
    words = stemmed_words(coded.dictionary)
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(tokens), 0).cast(pa.int32()))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pa.ListArray.from_arrays(offsets, words.take(coded.indices), mask=pc.is_null(tokens))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stems(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield from map(stemmed_lists, slices(batch, 512))


def stems(tokens: Column) -> Column:
    return _stems(tokens)
