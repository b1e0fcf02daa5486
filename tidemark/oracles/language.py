"""DuckDB text for language identification and turn labels."""

from __future__ import annotations

from tidemark import rules
from tidemark.operators import turns as tn
from tidemark.oracles import lang
from tidemark.oracles.corpus import MERGED, TERMS, VOCAB
from tidemark.oracles.dialect import (PASSAGES, QUESTIONS, TURNS, find, in_list, keywords, label_case, label_list, lst, q, rows, rx,
                                      rx_any, squeeze, strip, with_)
from tidemark.plans import inputs

_W = "PARTITION BY conv_id ORDER BY turn"


def words(col: str) -> str:
    return f"CASE WHEN {squeeze(col)} = '' THEN 0 ELSE len(string_split({squeeze(col)}, ' ')) END"


def mask(col: str, patterns, unicode_words: bool = False) -> str:
    return " + ".join(f"CASE WHEN {rx(col, p, unicode_words)} THEN {1 << i}::BIGINT ELSE 0 END" for i, p in enumerate(patterns))


def first_bit(col: str, labels) -> str:
    return "CASE " + " ".join(f"WHEN {col} & {1 << i} <> 0 THEN {q(lb)}" for i, lb in enumerate(labels)) + " END"


def bit_list(col: str, labels) -> str:
    items = ", ".join(f"CASE WHEN {col} & {1 << i} <> 0 THEN {q(lb)} END" for i, lb in enumerate(labels))
    return f"list_filter([{items}], lambda v: v IS NOT NULL)"


def first_term(col: str, terms) -> str:
    return "CASE " + " ".join(f"WHEN {rx(col, p)} THEN {q(t)}" for t, p in zip(terms, tn.term_patterns(terms))) + " END"


def anchor(col: str) -> str:
    return (f"coalesce({first_term(col, tn.ANCHOR_TERMS)}, {find(col, rules.TITLE_PHRASE, 1, ignore_case=False)}, "
            f"({keywords(col, 12)})[-1])")


def intro_name(col: str) -> str:
    tests = []
    for p in rules.NAME_INTROS:
        n = find(col, p, 1)
        tests.append(f"CASE WHEN regexp_matches({n}, '^[A-Z][a-z]') AND lower({n}) NOT IN {in_list(rules.BAD_NAMES)} THEN {n} END")
    return "coalesce(" + ", ".join(tests) + ")"


def follow_up(col: str) -> str:
    s = strip(col)
    return f"({s} <> '' AND ({words(s)} <= 6 OR {rx_any(s, rules.FOLLOWUPS)}))"


def smalltalk(col: str) -> str:
    return label_case(col, rules.SMALLTALK)


def crisis(col: str) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), {q(p)})" for p in rules.CRISIS) + ")"


def count_words(col: str, values) -> str:
    runs = rf"regexp_split_to_array(regexp_replace(lower({col}), '[^\wÀ-ɏ\s'']', ' ', 'g'), '\s+')"
    return f"len(list_filter({runs}, lambda t: list_contains({lst(values)}, t)))"


_WIDE = list(dict.fromkeys(lb for lb, _ in rules.EMOTIONS_WIDE))
_WIDE_P = ["|".join(p for lb, p in rules.EMOTIONS_WIDE if lb == label) for label in _WIDE]
STATE = f"""state AS (SELECT conv_id, turn,
    first_value(n IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS name,
    bit_or(c) OVER w AS cm, bit_or(t) OVER w AS tm,
    first_value(level IGNORE NULLS) OVER w AS level, first_value(year IGNORE NULLS) OVER w AS year, first_value(campus IGNORE NULLS) OVER w AS campus,
    last_value(coalesce({first_bit('c', tn.COURSE_LABELS)}, {first_bit('t', tn.TOPIC_LABELS)}) IGNORE NULLS) OVER w AS anchor
  FROM (SELECT conv_id, turn, {find('text', rules.NAME, 1, True, False)} AS n, {mask('text', [p for p, _ in rules.COURSES], True)} AS c,
    {mask('text', [p for p, _ in rules.TOPICS], True)} AS t, lower({find('text', rules.LEVEL, 0, True)}) AS level,
    lower({find('text', rules.YEAR, 0, True)}) AS year, lower({find('text', rules.CAMPUS, 0, True)}) AS campus
    FROM turns WHERE role = 'user')
  WINDOW w AS ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
student AS (SELECT conv_id, turn, name, {first_bit('cm', tn.COURSE_LABELS)} AS course, level, year, campus,
  {bit_list('tm', tn.TOPIC_LABELS)} AS topics, anchor FROM state)"""
_SLOTS = ", ".join(f"CASE WHEN {s} IS NOT NULL THEN '{s}: ' || {s} END" for s in ("name", "course", "level", "year", "campus"))
ASKED = f"""asked AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS)
  OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked FROM turns)"""
_ENT = ", ".join(f"CASE WHEN {rx('lower(text)', p)} THEN regexp_extract(lower(text), {q(p)}) || ':{t}:{n}' END" for p, t, n in rules.ENTITIES)
_ENT_TAGS = ", ".join(f"CASE WHEN {rx('lower(text)', p)} THEN {lst(tn.boosted_tags(n))} END" for p, _, n in rules.ENTITIES if tn.boosted_tags(n))
_STACK = ", ".join(f"min(CASE WHEN {rx('text', p)} THEN turn END) OVER w AS t{i}" for i, (p, _) in enumerate(rules.TOPICS_RECENT))
_RAISED = "[" + ", ".join(f"CASE WHEN t{i} IS NOT NULL THEN {{'at': t{i}, 'i': {i}, 'lb': {q(lb)}}} END" for i, lb in enumerate(tn.RECENT_LABELS)) + "]"
BOOST = f"""subjects AS (SELECT conv_id, turn, role, text,
    coalesce(bit_or(c) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS cm,
    coalesce(bit_or(f) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 0) AS fm
  FROM (SELECT *, {mask('lower(text)', [p for p, _ in rules.COURSE_BOOSTS], True)} AS c, {mask('lower(text)', [p for _, p in rules.FAMILY_BOOSTS], True)} AS f FROM turns))"""
_SAME = " OR ".join(f"(cm & {1 << i} <> 0 AND ({' OR '.join(f'contains(lower(tag), {q(x)})' for x in fr)}))" for i, fr in enumerate(tn.COURSE_FRAGMENTS))
_FAM = " OR ".join(f"(fm & {1 << i} <> 0 AND contains(lower(tag), {q(x)}))" for i, x in enumerate(tn.FAMILIES))
BOOST_CASE = (f"CASE WHEN {_SAME} THEN {rules.BOOST_COURSE} WHEN cm <> 0 AND starts_with(lower(tag), 'courses_') THEN {rules.BOOST_OTHER_COURSE} "
              f"WHEN {_FAM} THEN {rules.BOOST_FAMILY} ELSE 1.0 END::DOUBLE")
_ANY_TERM = rx("text", r"\b(?:" + "|".join(tn.ANCHOR_TERMS) + r")\b")
USER = "FROM turns WHERE role = 'user'"
ORACLES = {
    "detect_language": with_(PASSAGES, MERGED, TERMS, VOCAB, f"""
usable AS (SELECT term FROM vocab WHERE term NOT IN (SELECT en FROM pairs_cy) AND term NOT IN {in_list(rules.ENGLISH_STOP)}),
base AS (SELECT doc_id, text, {lang.quick('text')} AS quick, {lang.letters('text')} AS t FROM passages),
hits AS (SELECT doc_id, count(*) AS h FROM (SELECT doc_id, unnest(t) AS term FROM base WHERE quick IS NULL) JOIN usable USING (term) GROUP BY 1)""",
                             body=f"""
SELECT doc_id, coalesce(quick, CASE WHEN CASE WHEN len(t) < 4 THEN coalesce(h, 0) >= 2 ELSE coalesce(h, 0) / len(t) >= 0.5 END THEN 'cy' ELSE 'en' END) AS lang,
  {lang.looks_welsh('text')} AS looks_welsh FROM base LEFT JOIN hits USING (doc_id)"""),
    "detect_language_scored": with_(TURNS, body=f"SELECT conv_id, turn, scored_lang AS lang FROM ({lang.scored('SELECT * FROM turns', 'text')})"),
    "running_lang": with_(TURNS, body=f"""
SELECT conv_id, turn, own_lang, scored_lang AS lang FROM ({lang.scored(
        f"SELECT *, lag(own_lang) OVER ({_W}) AS run FROM (SELECT * RENAME (scored_lang AS own_lang) FROM (" +
        lang.scored("SELECT * FROM turns WHERE role = 'user'", "text") + "))", "text", "run")})"""),
    "reply_language": with_(TURNS, body=f"""
SELECT conv_id, turn, {lang.reply_score('text')} AS looks_welsh, {lang.reply_welsh('text')} AS reply_welsh,
  NOT {lang.reply_welsh('text')} AND regexp_matches(text, '[a-zA-Z]') AS reply_english FROM turns WHERE role = 'assistant'"""),
    "language_drift": with_(TURNS, ASKED, body=f"""
SELECT conv_id, turn, target, actual, d AS drift, CASE WHEN d THEN CASE target WHEN 'cy' THEN {q(tn.RETRY['cy'])} ELSE {q(tn.RETRY['en'])} END ELSE text END AS reply
FROM (SELECT *, {strip('text')} <> '' AND actual <> target AS d FROM (SELECT *, {lang.quick_or_english('asked')} AS target,
  CASE WHEN {lang.reply_welsh('text')} THEN 'cy' ELSE 'en' END AS actual FROM asked WHERE role = 'assistant'))"""),
    "history_clean": with_(TURNS, body=f"""
SELECT conv_id, turn, coalesce(len(h), 0) AS n, md5(coalesce(array_to_string(h, chr(10)), '')) AS history_md5 FROM (
  SELECT conv_id, turn, list(role || ':' || substring(text, 1, 600)) OVER ({_W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS h FROM turns)"""),
    "history_same_lang": with_(TURNS, body="""
SELECT conv_id, turn, lang, n - 1 AS n_same, md5(coalesce(array_to_string(h, chr(10)), '')) AS history_md5 FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, lang ORDER BY turn) AS n,
    list(text) OVER (PARTITION BY conv_id, lang ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS h
  FROM (SELECT *, """ + lang.quick_or_english("text") + " AS lang FROM turns))"),
    "turn_validate": f"""
SELECT conv_id, turn, role IN ('user', 'assistant') AS role_ok, length(text) BETWEEN 1 AND 4000 AS message_ok,
  length(text) BETWEEN 1 AND 8000 AS translate_ok, length(text) > 1000 AS cut, role IN ('user', 'assistant') AND length(text) BETWEEN 1 AND 4000 AS valid
FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES {rows(inputs.EXAMPLE_TURNS)}) v(conv_id, turn, role, text))""",
    "emotion_turns": with_(TURNS, body=f"""
SELECT conv_id, turn, coalesce(own, list_filter(near, lambda x: x IS NOT NULL)[-1], 'neutral') AS emotion,
  coalesce({first_bit('m', _WIDE)}, 'neutral') AS register
FROM (SELECT *, list(CASE WHEN role = 'user' THEN own END) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS near,
    bit_or(wide) OVER (PARTITION BY conv_id, role ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m
  FROM (SELECT *, {label_case('text', rules.EMOTIONS, True)} AS own, {mask('text', _WIDE_P)} AS wide FROM turns)) WHERE role = 'user'"""),
    "student_state": with_(TURNS, STATE, body="""
SELECT conv_id, turn, name, course, level, year, campus, array_to_string(topics, ',') AS topic_stack, anchor FROM student"""),
    "student_context_line": with_(TURNS, STATE, body=f"""
SELECT conv_id, turn, CASE WHEN len(b) > 0 THEN 'STUDENT CONTEXT: ' || array_to_string(b, '; ') ELSE '' END AS line FROM (
  SELECT *, list_filter([{_SLOTS}, CASE WHEN len(topics) > 0 THEN 'recent topics: ' || array_to_string(topics[-3:], ', ') END], lambda v: v IS NOT NULL) AS b FROM student)"""),
    "topic_stack": with_(TURNS, body=f"""
SELECT conv_id, turn, array_to_string(list_transform(list_sort(list_filter({_RAISED}, lambda v: v IS NOT NULL))[-5:], lambda s: s.lb), ',') AS topics
FROM (SELECT conv_id, turn, {_STACK} {USER} WINDOW w AS ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""),
    "query_class": with_(TURNS, body=f"""
SELECT conv_id, turn, c AS class, CASE c {' '.join(f"WHEN '{n}' THEN {v}" for n, _, v in rules.QUERY_CLASSES)} ELSE 0.3 END::DOUBLE AS temperature
FROM (SELECT conv_id, turn, {label_case('lower(text)', [(n, p) for n, p, _ in rules.QUERY_CLASSES], default="'other'")} AS c {USER})"""),
    "question_type": with_(TURNS, body=f"SELECT conv_id, turn, {label_case('lower(trim(text))', rules.QUESTION_TYPES, default=chr(39) + 'GENERAL' + chr(39))} AS type {USER}"),
    "query_qualifiers": with_(TURNS, body=f"SELECT conv_id, turn, array_to_string({label_list('lower(text)', rules.QUALIFIERS)}, ',') AS qualifiers {USER}"),
    "smalltalk_crisis": with_(TURNS, body=f"SELECT conv_id, turn, {smalltalk('text')} AS smalltalk, {crisis('text')} AS crisis {USER}"),
    "followup_flag": with_(TURNS, body=f"SELECT conv_id, turn, {follow_up('text')} AS follow_up {USER}"),
    "subject_anchor": with_(TURNS, body=f"SELECT conv_id, turn, {anchor('text')} AS anchor {USER}"),
    "entity_mentions": with_(TURNS, body=f"SELECT conv_id, turn, array_to_string(list_filter([{_ENT}], lambda v: v IS NOT NULL), ';') AS entities {USER}"),
    "entity_boost": with_(TURNS, body=f"""
SELECT conv_id, turn, array_to_string(list_sort(list_distinct(flatten(list_filter([{_ENT_TAGS}], lambda v: v IS NOT NULL)))), ',') AS tags {USER}"""),
    "lexicon_sentiment": with_(TURNS, body=f"""
SELECT conv_id, turn, greatest(0, least(4, 2 - {count_words('text', rules.NEGATIVE_WORDS)} + {count_words('text', rules.POSITIVE_WORDS)})) AS sentiment {USER}"""),
    "keywords": with_(TURNS, body=f"SELECT conv_id, turn, array_to_string({keywords('text', 6)}, ' ') AS keywords, len(list_distinct({keywords('text', 6)})) AS n_distinct FROM turns"),
    "casual_vent": with_(TURNS, body=f"""
SELECT conv_id, turn, has_topic, prior AS prior_topic, NOT has_topic AND NOT prior AND ({rx('s', rules.CASUAL)} OR ({words('s')} <= 3 AND NOT contains(s, '?'))) AS casual_vent
FROM (SELECT *, {rx('text', rules.HAS_TOPIC)} AS has_topic, coalesce(list_contains(list_filter(h, lambda v: v IS NOT NULL)[-3:], true), false) AS prior, {strip('text')} AS s
  FROM (SELECT *, list(CASE WHEN role = 'user' THEN term END) OVER ({_W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS h FROM (SELECT *, {_ANY_TERM} AS term FROM turns)))
WHERE role = 'user'"""),
    "reply_clarify_flag": with_(TURNS, ASKED, body=f"""
SELECT conv_id, turn, coalesce({rx_any('text', rules.CLARIFY_REPLY)} AND {words('asked')} >= 4, false) AS bounced FROM asked WHERE role = 'assistant'"""),
    "greeting_prefix": with_(TURNS, body=f"""
SELECT conv_id, turn, name, CASE WHEN name IS NOT NULL AND NOT contains(text, name) THEN CASE {lang.quick_or_english('prev')} WHEN 'cy' THEN 'Helô ' ELSE 'Hi ' END
  || name || ' — ' || lower(text[1]) || text[2:] ELSE text END AS reply
FROM (SELECT *, CASE WHEN prev_role = 'user' THEN {intro_name('prev')} END AS name FROM
  (SELECT *, lag(text) OVER ({_W}) AS prev, lag(role) OVER ({_W}) AS prev_role FROM turns)) WHERE role = 'assistant'"""),
    "intent_history_boost": with_(TURNS, BOOST, body=f"""
SELECT conv_id, turn, tag, {BOOST_CASE} AS boost FROM (SELECT *, unnest({lst([*inputs.INTENT_TAGS, 'courses_business'])}) AS tag FROM subjects WHERE role = 'user')"""),
    "reply_reshape": with_(TURNS, ASKED, body=f"""
SELECT conv_id, turn, md5(text) AS response_md5, '' AS alt_response, coalesce({smalltalk('asked')}, 'backend') AS tag, {lang.quick_or_english('text')} AS lang,
  1 AS confidence, len(string_split(text, chr(10))) AS n_sources, substring(string_split(text, chr(10))[1], 1, 20) AS first_title,
  length(string_split(text, chr(10))[1]) AS first_chars FROM asked WHERE role = 'assistant'"""),
    "query_augment": with_(QUESTIONS, MERGED, f"""
tk AS (SELECT item_id, term, min(pos) AS pos FROM (SELECT item_id, unnest({lang.letters('text')}) AS term, generate_subscripts({lang.letters('text')}, 1) AS pos
  FROM questions WHERE query_lang = 'cy') GROUP BY 1, 2),
gl AS (SELECT item_id, string_agg(en, ' ' ORDER BY pos) AS g FROM tk JOIN pairs_cy ON cy = term GROUP BY 1)""", body="""
SELECT item_id, CASE WHEN g IS NOT NULL THEN text || '  [en: ' || g || ']' ELSE text END AS augmented FROM questions LEFT JOIN gl USING (item_id)"""),
    "pronoun_anchor": with_(TURNS, body=f"""
SELECT conv_id, turn, asks AS asks_back, CASE WHEN asks THEN coalesce(
    list_filter(list_transform(list_filter(h, lambda x: x.role = 'user')[-3:], lambda x: x.anchor), lambda v: length(v) > 2)[-1],
    list_filter(list_transform(list_filter(h, lambda x: x.role = 'assistant')[-2:], lambda x: x.anchor), lambda v: length(v) > 2)[-1]) END AS anchor
FROM (SELECT *, coalesce({follow_up('s')} AND len(h) > 0 AND ({rx('s', rules.PRONOUN)} OR ({words('s')} <= 6 AND {rx_any('s', rules.ELLIPTIC)})), false) AS asks
  FROM (SELECT *, {strip('text')} AS s, list({{'role': role, 'anchor': a}}) OVER ({_W} ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS h
    FROM (SELECT *, {anchor('text')} AS a FROM turns))) WHERE role = 'user'"""),
}
