"""DuckDB expressions for the language detectors."""

from __future__ import annotations

from tidemark import rules
from tidemark.oracles.dialect import lst, rx

LETTERS = "'[a-zâêîôûŵŷ'']+'"


def letters(col: str) -> str:
    return f"regexp_extract_all(lower({col}), {LETTERS})"


def looks_welsh(col: str) -> str:
    return f"({rx(col, rules.CIRCUMFLEX)} OR {rx(col, rules.ORTHOGRAPHY, True)})"


def quick(col: str) -> str:
    return (f"CASE WHEN {col} IS NULL OR regexp_full_match({col}, '\\s*') THEN 'en' WHEN {looks_welsh(col)} THEN 'cy' "
            f"WHEN len(list_intersect({letters(col)}, {lst(rules.FUNCTION_WORDS)})) > 0 THEN 'cy' "
            f"WHEN len({letters(col)}) = 0 THEN 'en' END")


def quick_or_english(col: str) -> str:
    return f"coalesce({quick(col)}, 'en')"


def scored(source: str, text: str, running: str = "NULL") -> str:
    """A SELECT adding scored_lang to ``source``."""
    strong, welsh, english = lst(rules.SCORED_STRONG), lst(rules.SCORED_WELSH), lst(rules.SCORED_ENGLISH)
    words = rf"list_filter(regexp_split_to_array(regexp_replace(lower({text}), '[^a-zÀ-ɏ\s'']', ' ', 'g'), '\s+'), lambda t: t <> '')"
    return f"""SELECT * EXCLUDE (w, s, h, o, m, n, c, e), CASE
  WHEN s >= 2 THEN 'cy' WHEN s >= 1 AND s >= e THEN 'cy'
  WHEN {rx(text, rules.DIACRITIC_WIDE)} AND e <= 1 THEN 'cy'
  WHEN c >= 3 AND c > e THEN 'cy' WHEN c >= 2 AND e = 0 THEN 'cy' WHEN n <= 5 AND c >= 1 AND e = 0 THEN 'cy'
  WHEN e >= 2 AND c = 0 THEN 'en' WHEN e > c THEN 'en'
  WHEN {running} = 'cy' AND c >= 1 THEN 'cy' WHEN {running} = 'en' AND e >= 1 THEN 'en'
  WHEN c >= 1 AND c >= e THEN 'cy' ELSE 'en' END AS scored_lang
FROM (SELECT *, s + o AS c, h + m AS e FROM (SELECT *, len(w) AS n,
  len(list_filter(w, lambda t: list_contains({strong}, t))) AS s,
  len(list_filter(w, lambda t: list_contains({english}, t) AND NOT list_contains({strong}, t))) AS h,
  len(list_filter(w, lambda t: list_contains({welsh}, t) AND NOT list_contains({strong}, t) AND NOT list_contains({english}, t))) AS o,
  len(list_filter(w, lambda t: length(t) >= 4 AND regexp_matches(t, '{rules.ENGLISH_SUFFIX}') AND NOT list_contains({strong}, t)
    AND NOT list_contains({english}, t) AND NOT list_contains({welsh}, t))) AS m
  FROM (SELECT *, {words} AS w FROM ({source}))))"""


def reply_score(col: str) -> str:
    def n(p):
        return f"len(regexp_extract_all(lower({col}), '{p.replace(chr(39), chr(39) * 2)}'))"

    score = f"({n(rules.REPLY_FUNCTION)} * 2 + {n(rules.REPLY_DIGRAPH)} + CASE WHEN {rx(col, rules.DIACRITIC_WIDE)} THEN 3 ELSE 0 END)"
    return f"(length({col}) >= 20 AND {score} >= 6 AND {score} >= {n(rules.REPLY_ENGLISH)})"


def reply_welsh(col: str) -> str:
    t, toks = letters(col), lst(rules.REPLY_TOKENS)
    parts = f"flatten(list_transform(list_filter({t}, lambda x: contains(x, '''')), lambda x: string_split(x, '''')))"
    lead = rf"regexp_replace(lower(string_split(trim(regexp_replace({col}, '\s+', ' ', 'g')), ' ')[1]), '[!?,.;:]+$', '')"
    return (f"({rx(col, rules.CIRCUMFLEX)} OR list_contains({lst(rules.REPLY_LEADS)}, {lead}) OR "
            f"len(list_filter({t}, lambda x: list_contains({toks}, x))) + "
            f"len(list_filter({parts}, lambda x: list_contains({toks}, x))) >= 2)")
