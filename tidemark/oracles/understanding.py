"""DuckDB text for intents, topics, facts and routing."""

from __future__ import annotations

from tidemark import rules
from tidemark.oracles import lang
from tidemark.oracles import language as ol
from tidemark.oracles.corpus import FACTS, TOPICS
from tidemark.oracles.dialect import PATTERNS, QUESTIONS, TAGGED, TURNS, in_list, latin_tokens, preprocess, strip, with_
from tidemark.oracles.search import DENSE, TFIDF, VEC, by_lang, tfidf

ASKING = f"""{ol.BOOST},
asking AS (SELECT conv_id, turn, conv_id || ':' || turn AS turn_id, text, cm, fm,
  array_to_string(list(text) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), ' ') AS query
  FROM subjects WHERE role = 'user')"""
INTENTS = tfidf(f"SELECT seq, scored_lang AS lang, {by_lang('pattern', 'scored_lang')} AS t FROM ({lang.scored('SELECT * FROM patterns', 'pattern')})",
                f"SELECT turn_id, scored_lang AS lang, {by_lang('query', 'scored_lang')} AS t FROM ({lang.scored('SELECT turn_id, query FROM asking', 'query')})",
                "it", "seq", "turn_id", stemming=True) + f""",
intents AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY score DESC, tag) AS rnk FROM (
  SELECT turn_id, tag, round(max(score), 6) AS score FROM it JOIN patterns USING (seq) GROUP BY 1, 2) WHERE score > {rules.TFIDF_FLOOR}) WHERE rnk <= 5)"""
BEST = f"""boosted AS (SELECT turn_id, tag, round(score * CASE WHEN list_contains(flatten(list_filter([{ol._ENT_TAGS}], lambda v: v IS NOT NULL)), tag)
    THEN {rules.BOOST_ENTITY} ELSE 1.0 END::DOUBLE * {ol.BOOST_CASE}, 6) AS score FROM intents JOIN asking USING (turn_id)),
best AS (SELECT turn_id, tag, score, score < {rules.INTENT_CLARIFY} AS clarify FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY score DESC, tag) AS r
  FROM boosted) WHERE r = 1 AND score >= {rules.INTENT_FLOOR})"""


def topic_best(queries: str, qid: str) -> str:
    return tfidf(f"SELECT doc_id, {latin_tokens(chr(40) + 'phrases || chr(32) || title' + chr(41))} AS t FROM topics",
                 f"SELECT {qid}, {latin_tokens('text')} AS t FROM {queries}", "tt", "doc_id", qid) + f""",
topic_best AS (SELECT {qid}, doc_id, score, id, hint, reply_en FROM (SELECT *, row_number() OVER (PARTITION BY {qid} ORDER BY score DESC, doc_id) AS r
  FROM (SELECT {qid}, doc_id, id, hint, reply_en, round(score * (1 + priority * 0.02), 6) AS score FROM tt JOIN topics USING (doc_id)))
  WHERE r = 1 AND score >= {rules.TOPIC_FLOOR})"""


def _content(col: str) -> str:
    return f"list_filter({latin_tokens(col)}, lambda t: t NOT IN {in_list(rules.FACT_STOP)})"


_NAMES = [n for n, _ in rules.QUALIFIERS]
_QBITS = " + ".join(f"CASE WHEN list_contains(qualifiers, '{n}') THEN {1 << i} ELSE 0 END" for i, n in enumerate(_NAMES))
_QMASK = ol.mask("lower(text)", [p for _, p in rules.QUALIFIERS])
_DOC = "(array_to_string(list_concat(list_concat([question], keywords), keywords), ' '))"


def fact_best(queries: str, qid: str) -> str:
    return tfidf(f"SELECT conv_id, {_content(_DOC)} AS t FROM facts", f"SELECT {qid}, {_content('text')} AS t FROM {queries}",
                 "ft", "conv_id", qid) + f""",
fm_ AS (SELECT {qid}, conv_id AS fact_no, score, asked, len(qualifiers) AS nq, bit_count(asked & ({_QBITS})) AS m FROM ft JOIN facts USING (conv_id)
  JOIN (SELECT {qid}, {_QMASK} AS asked FROM {queries}) USING ({qid})),
fr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {qid} ORDER BY s DESC, fact_no) AS r FROM (SELECT {qid}, fact_no, round(score * CASE
    WHEN asked = 0 THEN CASE WHEN nq > 0 THEN 0.3 ELSE 1 END WHEN m > 0 AND m = nq THEN 1 + m * 3.0 WHEN m > 0 THEN 1 + m * 1.2
    WHEN nq = 0 THEN 0.55 ELSE 0.4 END, 6) AS s FROM fm_)) WHERE r <= 2 AND s > 0),
fact_best AS (SELECT {qid}, max(s) FILTER (WHERE r = 1) AS best, coalesce(max(s) FILTER (WHERE r = 2), 0) AS second,
  max(fact_no) FILTER (WHERE r = 1) AS fact_no FROM fr GROUP BY 1)"""


def passes(min_score: float, ratio: float) -> str:
    return f"(best >= {min_score} AND NOT (second > 0 AND best < second * {ratio}))" if ratio else f"(best >= {min_score})"


FACT_Q = """fact_q AS (SELECT item_id, text || CASE item_id % 4 WHEN 1 THEN ' for international students' WHEN 2 THEN ' as an international undergraduate'
  WHEN 3 THEN ' for a phd' ELSE '' END AS text FROM benchmark)"""
VENT = "vent AS (" + ol.ORACLES["casual_vent"].split("WHERE role IN ('user', 'assistant'))", 1)[1].strip() + ")"
ORACLES = {
    "intent_tfidf": with_(TURNS, PATTERNS, ASKING, INTENTS, body="SELECT turn_id, tag, score, rnk FROM intents"),
    "intent_fallback": with_(TURNS, PATTERNS, ASKING, INTENTS, BEST, body="SELECT turn_id, tag, score, clarify FROM best"),
    "topic_classify": with_(TOPICS, QUESTIONS, topic_best("questions", "item_id"), body="""
SELECT item_id, id, score, md5(CASE WHEN coalesce(hint, '') <> '' THEN text || chr(10) || '[topic: ' || id || ' — ' || hint || ']' ELSE text END) AS hinted_md5
FROM topic_best JOIN questions USING (item_id)"""),
    "fact_lookup": with_(FACTS, FACT_Q, fact_best("fact_q", "item_id"), body=f"""
SELECT item_id, fact_no, best, second, {passes(rules.FACT_FLOOR, 0)} AS found, {passes(3.0, 1.15)} AS fast_path FROM fact_best"""),
    "offtopic_gate": with_(TFIDF, VEC, DENSE, FACTS, FACT_Q, fact_best("fact_q", "item_id"), body=f"""
SELECT item_id, NOT (fact OR d >= 0.55 OR l >= 0.3) AND NOT (l >= 0.05) AND d < 0.35 AND l < 0.1 AS off_topic FROM (
  SELECT item_id, coalesce(t.score / 1000, 0) AS l, coalesce(e.score, 0) AS d, coalesce({passes(20.0, 1.15)}, false) AS fact FROM questions
  LEFT JOIN (SELECT * FROM tfidf_top WHERE rnk = 1) t USING (item_id) LEFT JOIN (SELECT * FROM dense WHERE rnk = 2) e USING (item_id)
  LEFT JOIN fact_best USING (item_id))"""),
    "route_turns": with_(TURNS, PATTERNS, ASKING, VENT, TOPICS, FACTS, f"""
base AS (SELECT a.*, casual_vent, {ol.crisis('text')} AS crisis, {ol.smalltalk('text')} AS small, a.turn > 0 AND {ol.follow_up('text')} AS follow,
  {strip('text')} = '' AS empty FROM asking a JOIN vent USING (conv_id, turn)),
openq AS (SELECT * FROM base WHERE NOT empty AND NOT crisis AND small IS NULL AND NOT casual_vent),
short AS (SELECT * FROM openq WHERE NOT follow AND {ol.words('text')} <= 5)""", topic_best("short", "turn_id"), fact_best("openq", "turn_id"),
                         INTENTS.replace("FROM asking)", "FROM openq)"), BEST, body=f"""
SELECT conv_id, turn, CASE {{}} ELSE 'fallback' END AS tag, round(CASE {{}} ELSE 0.0 END, 6) AS confidence, CASE {{}} ELSE 'fallback' END AS source
FROM base LEFT JOIN (SELECT turn_id, id AS topic, score AS tscore FROM topic_best WHERE reply_en IS NOT NULL AND score >= 3) USING (turn_id)
LEFT JOIN (SELECT turn_id, best, second, f.id AS fact FROM fact_best b JOIN facts f ON f.conv_id = b.fact_no) USING (turn_id)
LEFT JOIN (SELECT turn_id, tag AS intent, score AS iscore, clarify FROM best) USING (turn_id)"""),
}
_TIERS = [
    ("empty", "'empty'", "0.0", "'empty'"), ("crisis", "'wellbeing_crisis'", "1.0", "'safety'"),
    ("small IS NOT NULL", "small", "1.0", "'smalltalk'"), ("casual_vent", "'casual_vent'", "0.9", "'casual_handler'"),
    ("topic IS NOT NULL", "'nlu:' || topic", "least(1.0, tscore)", "'topic'"),
    (f"NOT follow AND {passes(3.0, 1.15)}", "'fact:' || fact", "0.92", "'facts'"),
    (passes(rules.FACT_FLOOR, 1.15), "'fact:' || fact", "0.92", "'facts'"),
    ("NOT clarify AND iscore >= 0.35", "intent", "least(0.7, 0.3 + iscore)", "'knowledge_base'"),
    ("NOT clarify", "intent", "least(0.5, 0.25 + iscore)", "'knowledge_base'"),
    ("clarify", "'clarification'", "0.25", "'knowledge_base+clarify'"),
]
_text = ORACLES["route_turns"]
for i in (1, 2, 3):
    _text = _text.replace("{}", " ".join(f"WHEN {t[0]} THEN {t[i]}" for t in _TIERS), 1)
ORACLES["route_turns"] = _text
