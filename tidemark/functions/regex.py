"""Portable rule patterns compiled to the JVM regex dialect.

Rules are written with ``\\b``; whether a word character means ASCII or Unicode
differs between engines, so the boundary is spelled out with look-arounds and
the caller says which of the two meanings a rule was written for.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ASCII = r"[A-Za-z0-9_]"
_UNICODE = r"[\p{L}\p{N}_]"


#: Characters beside its own two forms that an ASCII letter may match where case is ignored.
_FOLDED = "\u0130\u0131\u017f\u212a"


def _words(pattern: str) -> list[str]:
    """The words of a rule that is a list of words between boundaries, each with a plain letter or digit first; else none."""
    body = re.fullmatch(r"\\b\((?:\?:)?([^()\[\]]*)\)\\b|\\b([A-Za-z0-9][A-Za-z0-9 ]*)\\b", pattern)
    words = (body[1] if body[1] is not None else body[2]).split("|") if body else []
    return words if all(re.match(r"[A-Za-z0-9](?![?*+{])", w) for w in words) else []


def _lead(words: list[str], ignore_case: bool) -> str:
    """Cheap tests that hold wherever such words can start; the character before one is no letter, which rules out most places at once."""
    first = {c for w in words for c in ((w[0].lower(), w[0].upper()) if ignore_case else w[0])}
    return f"(?=[{''.join(sorted(first))}{_FOLDED if ignore_case else ''}])(?<![a-zA-Z0-9])" if words else ""


def compile_rule(pattern: str, unicode_words: bool = False, ignore_case: bool = True) -> str:
    word = _UNICODE if unicode_words else _ASCII
    boundary = f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))"
    return _lead(_words(pattern), ignore_case) + ("(?iu)" if ignore_case else "") + pattern.replace(r"\b", boundary)


def may_match(text: Column, patterns: Iterable[str]) -> tuple[list[str], Column | None]:
    """The patterns that are word lists, and whether any of their words starts in the text; false says that none of them matches.

    One pass in place of one for each pattern; words are grouped by their first character.
    """
    listed = [p for p in patterns if _words(p)]
    if len(listed) < 2 and sum(len(_words(p)) for p in listed) < 8:
        return [], None
    by_first: dict[str, list[str]] = {}
    for word in dict.fromkeys(w for p in listed for w in _words(p)):
        by_first.setdefault(word[0].lower(), []).append(word[1:])
    words = [w for p in listed for w in _words(p)]
    grouped = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_first.items()))
    return listed, text.rlike(f"{_lead(words, True)}(?iu)(?:{grouped})")


def matches(text: Column, pattern: str, unicode_words: bool = False, ignore_case: bool = True) -> Column:
    return text.rlike(compile_rule(pattern, unicode_words, ignore_case))


def matches_any(text: Column, patterns: Iterable[str], unicode_words: bool = False) -> Column:
    return matches(text, "|".join(f"(?:{p})" for p in patterns), unicode_words)


def find(text: Column, pattern: str, group: int = 0, unicode_words: bool = False, ignore_case: bool = True) -> Column:
    """First match of a group, null when there is none."""
    hit = F.regexp_extract(text, compile_rule(pattern, unicode_words, ignore_case), group)
    return F.nullif(hit, F.lit(""))


def replace(text: Column, pattern: str, value: str, unicode_words: bool = False) -> Column:
    return F.regexp_replace(text, compile_rule(pattern, unicode_words), value)


def rewrite(text: Column, compiled: str, value) -> Column:
    """Every match of a compiled rule replaced by ``value(match, its number from 0)``, match by match from the left."""
    gaps, hits = F.split(text, compiled, -1), F.regexp_extract_all(text, F.lit(compiled), F.lit(0))
    return F.array_join(F.zip_with(gaps, F.transform(hits, value), lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")


def first_label(text: Column, rules: Iterable[tuple[str, str]], unicode_words: bool = False) -> Column:
    """Label of the first (label, pattern) rule that matches; one regex per distinct label run."""
    merged: list[tuple[str, list[str]]] = []
    for label, pattern in rules:
        if merged and merged[-1][0] == label:
            merged[-1][1].append(pattern)
        else:
            merged.append((label, [pattern]))
    out = None
    for label, patterns in merged:
        test = matches_any(text, patterns, unicode_words)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out


def all_labels(text: Column, rules: Iterable[tuple[str, str]], unicode_words: bool = False) -> Column:
    """Array of every label whose pattern matches, in table order."""
    found = F.array(*[F.when(matches(text, p, unicode_words), F.lit(label)) for label, p in rules])
    return F.array_compact(found)


def flip(rules: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """(pattern, label) tables as (label, pattern)."""
    return [(label, pattern) for pattern, label in rules]
