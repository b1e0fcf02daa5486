"""English suffix stripping in SQL: one CTE for each step over a table of words, by shapes of 0 (consonant) and 1 (vowel)."""

from __future__ import annotations

# Fixed values: (suffix, replacement) of the two derivational steps, and the suffixes of the last one.
_DERIVED = ("ational=ate tional=tion enci=ence anci=ance izer=ize abli=able alli=al entli=ent eli=e ousli=ous ization=ize ation=ate "
            "ator=ate alism=al iveness=ive fulness=ful ousness=ous aliti=al iviti=ive biliti=ble")
_SHORTENED = "icate=ic ative= alize=al iciti=ic ical=ic ful= ness="
_DROPPED = "al= ance= ence= er= ic= able= ible= ant= ement= ment= ent= ion= ou= ism= ate= iti= ous= ive= ize="


def _shape(word: str) -> str:
    out = f"regexp_replace(regexp_replace(regexp_replace({word}, '[aeiou]', '1', 'g'), '[^1y]', '0', 'g'), '^y', '0')"
    for _ in range(3):  # y is a vowel after a consonant
        out = f"replace(replace({out}, '1y', '10'), '0y', '01')"
    return out


def _measure(word: str) -> str:
    return f"len(regexp_extract_all({_shape(word)}, '1+0+'))"


def _voiced(word: str) -> str:
    return f"contains({_shape(word)}, '1')"


def _short(word: str) -> str:
    return f"(ends_with({_shape(word)}, '010') AND right({word}, 1) NOT IN ('w', 'x', 'y'))"


def _cut(word: str, n: int) -> str:
    return f"left({word}, length({word}) - {n})"


def _suffix_step(source: str, name: str, pairs: str, least: int, extra: str = "true") -> str:
    """The longest suffix of the list, replaced where what stands before it has the measure."""
    table = sorted((p.split("=") for p in pairs.split()), key=lambda p: -len(p[0]))
    suffix = " ".join(f"WHEN ends_with(w, '{s}') THEN '{s}'" for s, _ in table)
    new = " ".join(f"WHEN '{s}' THEN '{r}'" for s, r in table)
    return (f"{name} AS (SELECT term, CASE WHEN s IS NOT NULL AND {_measure('b')} > {least} AND ({extra}) THEN b || CASE s {new} END ELSE w END AS w "
            f"FROM (SELECT *, left(w, length(w) - length(s)) AS b FROM (SELECT *, CASE {suffix} END AS s FROM {source})))")


def stems(terms: str) -> str:
    """CTEs ending in ``stems(term, stem)`` for ``terms``, a SELECT of ``term``."""
    stripped = f"""CASE WHEN right(b, 2) IN ('at', 'bl', 'iz') THEN b || 'e'
  WHEN length(b) > 1 AND right(b, 1) = substr(b, -2, 1) AND right({_shape('b')}, 1) = '0' AND right(b, 1) NOT IN ('l', 's', 'z') THEN {_cut('b', 1)}
  WHEN {_measure('b')} = 1 AND {_short('b')} THEN b || 'e' ELSE b END"""
    return f"""st0 AS (SELECT DISTINCT term, term AS w FROM ({terms}) WHERE length(term) >= 3 AND regexp_full_match(term, '[\\x00-\\x7F]*')),
st1 AS (SELECT term, CASE WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN {_cut('w', 2)} WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN {_cut('w', 1)} ELSE w END AS w FROM st0),
st2 AS (SELECT *, CASE WHEN ends_with(w, 'eed') THEN NULL WHEN ends_with(w, 'ed') AND {_voiced(_cut('w', 2))} THEN {_cut('w', 2)}
  WHEN ends_with(w, 'ing') AND {_voiced(_cut('w', 3))} THEN {_cut('w', 3)} END AS b FROM st1),
st3 AS (SELECT term, CASE WHEN ends_with(w, 'eed') THEN CASE WHEN {_measure(_cut('w', 3))} > 0 THEN {_cut('w', 1)} ELSE w END WHEN b IS NOT NULL THEN {stripped} ELSE w END AS w FROM st2),
st4 AS (SELECT term, CASE WHEN ends_with(w, 'y') AND {_voiced(_cut('w', 1))} THEN {_cut('w', 1)} || 'i' ELSE w END AS w FROM st3),
{_suffix_step('st4', 'st5', _DERIVED, 0)},
{_suffix_step('st5', 'st6', _SHORTENED, 0)},
{_suffix_step('st6', 'st7', _DROPPED, 1, "s <> 'ion' OR right(b, 1) IN ('s', 't')")},
st8 AS (SELECT term, CASE WHEN ends_with(w, 'e') AND ({_measure(_cut('w', 1))} > 1 OR ({_measure(_cut('w', 1))} = 1 AND NOT {_short(_cut('w', 1))})) THEN {_cut('w', 1)} ELSE w END AS w FROM st7),
stems AS (SELECT term, CASE WHEN ends_with(w, 'll') AND {_measure('w')} > 1 THEN {_cut('w', 1)} ELSE w END AS stem FROM st8)"""
