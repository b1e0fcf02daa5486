"""Helpers that write DuckDB SQL text for the correctness oracle."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from tidemark.plans import inputs


def q(value: object) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def lst(values: Iterable[object]) -> str:
    return "[" + ", ".join(q(v) for v in dict.fromkeys(values)) + "]"


def in_list(values: Iterable[object]) -> str:
    return "(" + ", ".join(q(v) for v in dict.fromkeys(values)) + ")"


def plain(col: str) -> str:
    """Non-ASCII letters become a digit, so that an ASCII word boundary acts as a Unicode one."""
    return rf"regexp_replace({col}, '[^\P{{L}}a-zA-Z]', '0', 'g')"


def rx(col: str, pattern: str, unicode_words: bool = False, ignore_case: bool = True) -> str:
    flag = "(?i)" if ignore_case else ""
    return f"regexp_matches({plain(col) if unicode_words else col}, {q(flag + pattern)})"


def rx_any(col: str, patterns: Sequence[str], unicode_words: bool = False) -> str:
    return rx(col, "|".join(f"(?:{p})" for p in patterns), unicode_words)


def find(col: str, pattern: str, group: int = 0, unicode_words: bool = False, ignore_case: bool = True) -> str:
    flag = "(?i)" if ignore_case else ""
    src = plain(col) if unicode_words else col
    return f"nullif(regexp_extract({src}, {q(flag + pattern)}, {group}), '')"


def label_case(col: str, rules: Iterable[tuple[str, str]], unicode_words: bool = False, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {rx(col, p, unicode_words)} THEN {q(label)}" for label, p in rules)
    return f"CASE {whens} ELSE {default} END"


def label_list(col: str, rules: Iterable[tuple[str, str]], unicode_words: bool = False) -> str:
    items = ", ".join(f"CASE WHEN {rx(col, p, unicode_words)} THEN {q(label)} END" for label, p in rules)
    return f"list_filter([{items}], lambda v: v IS NOT NULL)"


def rows(values: Iterable[tuple]) -> str:
    return ", ".join("(" + ", ".join(q(v) for v in row) + ")" for row in values)


TURNS = f"""turns AS (
  SELECT conv_id, turn, role, text FROM (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT * FROM (VALUES {rows(inputs.EXAMPLE_TURNS)}) v(conv_id, turn, role, text))
  WHERE role IN ('user', 'assistant'))"""
PASSAGES = f"""passages AS (
  SELECT doc_id, text, lang, source, n_chars FROM documents
  UNION ALL SELECT * FROM (VALUES {rows(inputs.EXAMPLE_DOCS)}) v(doc_id, text, lang, source, n_chars))"""
TAGGED = """tagged AS (SELECT doc_id, text, source,
  CASE lang WHEN 'fr' THEN 'cy' WHEN 'de' THEN NULL ELSE 'en' END AS lang FROM documents)"""
QUESTIONS = """questions AS (SELECT item_id, text,
  CASE item_id % 3 WHEN 0 THEN 'cy' WHEN 1 THEN 'en' END AS query_lang FROM benchmark)"""
FEEDBACK = """feedback AS (
  SELECT event_id, ts, user_id, event_id % 9 - 1 AS raw_satisfaction, 1 + event_id % 5 AS satisfaction,
    CASE event_type WHEN 'purchase' THEN true WHEN 'error' THEN false END AS helpful,
    CASE WHEN k % 10 = 0 THEN false WHEN k % 3 <> 0 THEN true END AS correct_language,
    CASE WHEN k % 4 = 0 THEN event_type || ' said "' || k || '"' END AS comments
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))"""
LEXICON_RECORDS = r"""records AS (
  SELECT doc_id * 4294967296 + pos AS seq, doc_id, source AS subject,
    array_to_string(t[1:(pos % 3) + 1], ' ') AS cy, t[-1] AS en
  FROM (SELECT doc_id, source, pos - 1 AS pos, regexp_extract_all(lower(line), '[a-zâêîôûŵŷ'']+') AS t
    FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
      generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents))
  WHERE len(t) > 0)"""
_TAG = f"{lst(inputs.INTENT_TAGS)}"
PATTERNS = f"""patterns AS (
  SELECT item_id * 4294967296 + pos AS seq, ({_TAG})[(item_id + pos) % {len(inputs.INTENT_TAGS)} + 1] AS tag, pattern
  FROM (SELECT item_id, unnest(string_split(text, '. ')) AS pattern,
    generate_subscripts(string_split(text, '. '), 1) - 1 AS pos FROM benchmark)
  WHERE trim(pattern) <> '')"""
RESPONSES = f"""responses AS (
  SELECT conv_id * 4294967296 + turn AS seq, ({_TAG})[conv_id % {len(inputs.INTENT_TAGS)} + 1] AS tag,
    conv_id % 3 AS shape, text FROM conversations WHERE role = 'assistant')"""


def strip(col: str) -> str:
    return rf"regexp_replace({col}, '^\s+|\s+$', '', 'g')"


def squeeze(col: str) -> str:
    return rf"trim(regexp_replace({col}, '\s+', ' ', 'g'))"


PAIRS = f"""pairs AS (
  SELECT conv_id, {strip("min_by(text, turn) FILTER (WHERE role = 'user')")} AS question,
    {strip("min_by(text, turn) FILTER (WHERE role = 'assistant')")} AS answer
  FROM conversations GROUP BY conv_id
  HAVING count(*) FILTER (WHERE role = 'user') > 0 AND count(*) FILTER (WHERE role = 'assistant') > 0)"""


def keywords(col: str, limit: int) -> str:
    from tidemark import rules
    clean = rf"regexp_replace(lower({col}), '[^\w\s£$€@.:/\-]', ' ', 'g')"
    return (rf"list_filter(regexp_split_to_array({clean}, '\s+'), "
            f"lambda w: length(w) > 2 AND NOT list_contains({lst(rules.KEYWORD_STOP)}, w))[1:{limit}]")


def latin_tokens(col: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({col}), '[^a-zÀ-ÿŵŷ0-9]+'), lambda t: t <> '')"


def content_tokens(col: str, min_chars: int, stop: Sequence[str]) -> str:
    return (f"list_filter({latin_tokens(col)}, "
            f"lambda t: length(t) >= {min_chars} AND NOT list_contains({lst(stop)}, t))")


def preprocess(col: str, stop: Sequence[str]) -> str:
    clean = rf"regexp_replace(lower({col}), '[^\wÀ-ɏ\s]', ' ', 'g')"
    return (rf"list_filter(regexp_split_to_array({clean}, '\s+'), "
            f"lambda t: length(t) > 1 AND NOT list_contains({lst(stop)}, t))")


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c for c in ctes) + "\n" + body.strip()
