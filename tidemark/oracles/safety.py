"""DuckDB text for the safety queries."""

from __future__ import annotations

from tidemark import rules
from tidemark.oracles import lang
from tidemark.oracles.dialect import PASSAGES, TURNS, content_tokens, label_case, q, rx, squeeze, with_
from tidemark.oracles.language import ASKED

_NI = q("(?i)" + rules.PII_NI)
_EMAIL = q("(?i)" + rules.PII_EMAIL)
_MASKED = f"regexp_replace(regexp_replace(text, {_NI}, '[NI-NUMBER]', 'g'), {_EMAIL}, '[EMAIL]', 'g')"
_P = "CASE " + " ".join(f"WHEN {rx('text', p)} THEN {i}" for i, p in enumerate(rules.PASSAGE_INJECTION, 1)) + " END"
_PM = "CASE " + " ".join(
    f"WHEN {rx('text', p)} THEN substring(regexp_extract(text, {q('(?i)' + p)}), 1, 80)" for p in rules.PASSAGE_INJECTION) + " END"
_MSG = label_case("text", [(p[:60], p) for p in rules.MESSAGE_INJECTION], True)
_MSG_CY = label_case("text", [(p[:60], p) for p in rules.MESSAGE_INJECTION_CY], True)
_A, _B = content_tokens("text", 4, rules.GROUNDING_STOP), content_tokens("coalesce(asked, '')", 4, rules.GROUNDING_STOP)
ORACLES = {
    "pii_email_ni": with_(PASSAGES, body=f"SELECT doc_id, md5({_MASKED}) AS masked_md5, length({_MASKED}) AS n_chars FROM passages"),
    "injection_scan": with_(PASSAGES, TURNS, body=f"""
SELECT 'passage' AS kind, doc_id AS id, 0::BIGINT AS part, ({_P})::VARCHAR AS pattern, {_PM} AS match FROM passages
UNION ALL SELECT 'message', conv_id, turn, coalesce({_MSG}, CASE WHEN {lang.quick_or_english('text')} = 'cy' THEN {_MSG_CY} END), NULL
FROM turns WHERE role = 'user'"""),
    "sanitise_split": with_(PASSAGES, body=f"""
SELECT doc_id, CASE WHEN p IS NULL THEN 'clean' ELSE 'dropped' END AS status, p::BIGINT AS pattern, {_PM} AS match FROM (SELECT *, {_P} AS p FROM passages)"""),
    "grounding": with_(TURNS, ASKED, body=f"""
SELECT conv_id, turn, supported, total, passage_terms, round(r, 6) AS ratio, total >= 10 AND r < 0.15 AS weak
FROM (SELECT *, CASE WHEN total = 0 THEN 0 ELSE supported / total END AS r FROM (
  SELECT conv_id, turn, len(list_filter(a, lambda t: list_contains(b, t))) AS supported, len(a) AS total, len(b) AS passage_terms
  FROM (SELECT conv_id, turn, {_A} AS a, list_distinct({_B}) AS b FROM asked WHERE role = 'assistant')))"""),
    "repetition_flag": f"""
WITH c AS (SELECT doc_id, length(text) AS n, {squeeze('lower(text)')} AS c FROM documents),
t AS (SELECT doc_id, n, list_filter(string_split(c, ' '), lambda x: x <> '') AS t,
  list_filter(list_transform(regexp_extract_all(c, '[^.!?…\\n]+[.!?…]?'), lambda s: string_split(trim(s), ' ')), lambda s: len(s) >= 5) AS s FROM c),
w AS (SELECT doc_id, count(DISTINCT g) < count(g) AS win FROM (
  SELECT doc_id, CASE WHEN lead(term, 5) OVER o IS NOT NULL THEN concat_ws(' ', term, lead(term, 1) OVER o, lead(term, 2) OVER o,
    lead(term, 3) OVER o, lead(term, 4) OVER o, lead(term, 5) OVER o) END AS g
  FROM (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM t WHERE len(t) >= 12)
  WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) GROUP BY doc_id),
f AS (SELECT doc_id, n, s, n >= 100 AND coalesce(win, false) AS win FROM t LEFT JOIN w USING (doc_id)),
sent AS (SELECT doc_id, b, j, len(b) AS n, len(list_distinct(b)) AS nd FROM (
  SELECT doc_id, unnest(s) AS b, generate_subscripts(s, 1) AS j FROM f WHERE n >= 100 AND NOT win)),
tok AS (SELECT doc_id, j, term, any_value(n) AS n, any_value(nd) AS nd, count(*) AS c FROM (SELECT doc_id, j, n, nd, unnest(b) AS term FROM sent) GROUP BY 1, 2, 3),
near AS (SELECT DISTINCT doc_id FROM (SELECT x.doc_id, x.j, y.j AS k, sum(y.c) / greatest(any_value(x.nd), any_value(y.n)) AS share
  FROM tok x JOIN tok y ON x.doc_id = y.doc_id AND x.term = y.term AND x.j < y.j AND y.n >= 0.8 * x.nd GROUP BY 1, 2, 3) WHERE share >= 0.8)
SELECT doc_id, win OR doc_id IN (SELECT doc_id FROM near) AS repeated FROM f""",
}
