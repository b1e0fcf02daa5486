"""DuckDB text for corpus building, lexicon and knowledge base."""

from __future__ import annotations

from tidemark import rules
from tidemark.operators.acts import TEMPLATES
from tidemark.oracles import lang
from tidemark.oracles.dialect import (LEXICON_RECORDS, PAIRS, PASSAGES, PATTERNS, RESPONSES, TURNS, in_list, keywords, lst, preprocess, q,
                                      rows, rx, squeeze, strip, with_)
from tidemark.oracles.stem import stems
from tidemark.plans import corpus as pc
from tidemark.plans import inputs

STUDY, GENERAL = (rx("text", p, True) for p in (rules.RELEVANT_STUDY, rules.RELEVANT_GENERAL))
_CLEAN = "nullif(lower({}), '')"


def _c(col: str) -> str:
    return _CLEAN.format(squeeze(col))


def _useful(cy: str, en: str) -> str:
    sides = " AND ".join(
        rf"length({s}) BETWEEN 2 AND 60 AND NOT regexp_matches({s}, '^[\d\s\-/]+$')" for s in (cy, en))
    words = rf"len(regexp_split_to_array({squeeze(en)}, ' '))"
    return f"{sides} AND NOT ({rx(en, rules.LEGISLATION, True)} AND {words} > 4)"


MERGED = f"""{LEXICON_RECORDS},
old AS (SELECT cy, min_by(en, seq) AS en FROM (SELECT seq, {_c('cy')} AS cy, {_c('en')} AS en FROM records WHERE doc_id % 4 = 0)
  WHERE cy IS NOT NULL AND en IS NOT NULL GROUP BY cy),
new AS (SELECT cy, max_by(en, seq) AS en FROM (SELECT seq, {_c('cy')} AS cy, {_c('en')} AS en FROM records
  WHERE doc_id % 4 <> 0 AND subject IN {in_list(pc.SUBJECTS)}) WHERE {_useful('cy', 'en')} GROUP BY cy),
pairs_cy AS (SELECT cy, en, 'existing' AS origin FROM old UNION ALL SELECT cy, en, 'new' FROM new WHERE cy NOT IN (SELECT cy FROM old))"""

_BOOT = f"""boot AS (SELECT substring(cy, 1, {rules.TITLE_CHARS}) AS title, cy || ' (Saesneg: ' || en || ')' AS text, 'cy' AS lang FROM pairs_cy
  WHERE lower(trim(cy)) NOT IN {in_list(rules.LEXICON_SKIP)}
    AND (len(string_split({squeeze('cy')}, ' ')) > 1 OR {rx("lower(cy || ' ' || en)", rules.LEXICON_TOPICS, True)}))"""

_ALPHA = "a-zâêîôûŵŷäëïöüàèìòùáéíóúãõñç''"
TERMS = rf"""lines AS (SELECT lower({strip('line')}) AS t FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)),
terms AS (SELECT DISTINCT term FROM (
  SELECT term FROM (SELECT unnest(regexp_split_to_array(regexp_replace(t, '[^\w{_ALPHA}\-]', ' ', 'g'), '[\s\-]+')) AS term FROM lines WHERE t <> '')
  WHERE length(term) BETWEEN 3 AND 25 AND regexp_matches(term, '^[{_ALPHA}]+$') AND NOT starts_with(term, '''')
    AND term NOT IN {in_list(rules.TERM_STOP)}
  UNION ALL SELECT t FROM lines WHERE len(regexp_split_to_array(t, '\s+')) BETWEEN 2 AND 3 AND NOT starts_with(t, '"') AND t <> ''))"""
VOCAB = f"""vocab AS (SELECT DISTINCT term FROM (
  SELECT term FROM terms WHERE NOT contains(term, ' ') AND length(term) <= 20
  UNION ALL SELECT lower(trim(cy)) FROM pairs_cy WHERE NOT contains(lower(trim(cy)), ' ') AND length(lower(trim(cy))) BETWEEN 2 AND 25)
  WHERE term NOT IN {in_list(rules.SCORED_ENGLISH)})"""
FACTS = f"""{PAIRS},
facts AS (SELECT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'fees-' ELSE 'fact-' END || conv_id AS id, question, answer AS answer_en,
  {keywords('answer', 3)} AS keywords, CASE conv_id % 5 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['international']
    WHEN 2 THEN ['international', 'undergraduate'] WHEN 3 THEN ['phd'] ELSE ['other'] END AS qualifiers,
  CASE WHEN conv_id % 3 <> 0 THEN answer END AS answer_cy FROM pairs)"""
TOPICS = f"""topics AS (SELECT doc_id, 'topic-' || doc_id AS id, array_to_string({lang.letters('text')}[1:2], ' ') AS title, text AS phrases,
  array_to_string({keywords('text', 4)}, ' ') AS hint, doc_id % 8 AS priority,
  CASE WHEN doc_id % 2 = 0 THEN 'About ' || array_to_string({lang.letters('text')}[1:2], ' ') END AS reply_en
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))"""
_FACT_TEXT = strip("coalesce(nullif(answer_en, ''), answer_cy)")
FACT_DOCS = f"fact_docs AS (SELECT id AS title, {_FACT_TEXT} AS text, 'facts' AS source, {lang.quick_or_english(_FACT_TEXT)} AS lang FROM facts WHERE {_FACT_TEXT} <> '')"
_RT = strip("text")
KNOW_DOCS = f"""know_docs AS (SELECT tag AS title, {_RT} AS text, CASE shape WHEN 1 THEN 'en' WHEN 2 THEN 'cy'
  ELSE {lang.quick_or_english(_RT)} END AS lang FROM responses WHERE {_RT} <> '')"""

_ACTS = " ".join(
    f"WHEN regexp_matches(s, {q('(?i)^(?:' + '|'.join(f'(?:{p})' for p in ps) + ')$')}) THEN {q(name)}"
    for name, ps in rules.DIALOGUE_ACTS)
MINED = f"""mined AS (SELECT DISTINCT category, phrase FROM (
  SELECT CASE WHEN s <> '' AND length(s) <= 60 AND len(string_split({squeeze('s')}, ' ')) <= 6 THEN CASE {_ACTS} END END AS category,
    lower(s) AS phrase FROM (SELECT {strip('text')} AS s FROM turns WHERE role = 'user')
  UNION ALL SELECT * FROM (VALUES {rows((c, p) for c, ps in rules.SEED_PHRASES for p in ps)}) v(category, phrase))
  WHERE category IS NOT NULL)"""
_TEMPL = " ".join(f"WHEN {q(c)} THEN {q(f'Reply to {chr(34)}{en}{chr(34)} ({chr(34)}{cy}{chr(34)}): {r} Also phrased as: ')}"
                  for c, en, cy, r in TEMPLATES)

_PAIR = f"array_to_string({lang.letters('{}')}, ' ')"
WHOLE = f"whole AS (SELECT seq, tag, {_PAIR.format('pattern')} AS pattern FROM patterns)"
_TAG = f"({lst(inputs.INTENT_TAGS)})[conv_id % {len(inputs.INTENT_TAGS)} + 1]"
TAGGED_TURNS = f"""tagged_turns AS (SELECT conv_id * 4294967296 + turn AS seq,
  CASE WHEN conv_id % 7 = 0 THEN 'unknown_tag' ELSE {_TAG} END AS tag, {_PAIR.format('text')} AS pattern FROM conversations WHERE role = 'user')"""
_OVERRIDE = "CASE k " + " ".join(f"WHEN {q(k)} THEN {q(t)}" for k, t in pc.KEEP_IN) + " END"


def _phrases(seeds: list[str], entities: list[str], templates: list[str]) -> str:
    """Seeds then first-spelling entity x template phrases, for one topic row."""
    made = "[" + ", ".join(f"trim(replace({q(t)}, '{{X}}', {e}))" for e in entities for t in templates) + "]"
    low = f"list_transform({made}, lambda p: lower(p))"
    seed = "[" + ", ".join(seeds) + "]"
    return (f"list_concat({seed}, list_filter({made}, lambda p, i: length(p) > 1 AND NOT list_contains("
            f"list_transform({seed}, lambda s: lower(s)), lower(p)) AND list_position({low}, lower(p)) = i))")


def _fill(template: str, names: dict[str, str]) -> str:
    out, rest = [], template
    while "{" in rest:
        a, b = rest.split("{", 1)
        name, rest = b.split("}", 1)
        if a:
            out.append(q(a))
        out.append(names[name])
    if rest:
        out.append(q(rest))
    return "(" + " || ".join(out) + ")"


def _family(source: str, names: dict[str, str], seq: int, id_: str, title: str, title_cy: str, seeds: list[str], seeds_cy: list[str],
            ents: list[str], ents_cy: list[str], hint: str, priority: int) -> str:
    def f(t):
        return _fill(t, names)

    en = _phrases([f(s) for s in seeds], [f(e) for e in ents], rules.TEMPLATES_EN)
    cy = _phrases([f(s) for s in seeds_cy], [f(e) for e in ents_cy], rules.TEMPLATES_CY)
    return (f"SELECT {seq} AS seq, {f(id_)} AS id, {f(title)} AS title, {f(title_cy)} AS title_cy, {f(hint)} AS hint, "
            f"{priority} AS priority, {en} AS en, {cy} AS cy FROM {source}")


_N = {"id": "id", "en": "en", "cy": "cy"}
_G = {**_N, "sid": "sid", "sen": "sen", "scy": "scy"}


def _grid(fixed: list[tuple[str, str, str]], source: str) -> str:
    return f"(SELECT * FROM {source}, (VALUES {rows(fixed)}) v(sid, sen, scy))"


TOPIC_GRID = f"""WITH part_t AS (SELECT p_partkey::VARCHAR AS id, p_name AS en, 'y ' || p_name AS cy FROM part),
supp_t AS (SELECT s_suppkey::VARCHAR AS id, s_name AS en, 'y ' || s_name AS cy FROM supplier),
seg_t AS (SELECT DISTINCT lower(c_mktsegment) AS id, lower(c_mktsegment) AS en, 'y ' || lower(c_mktsegment) AS cy FROM customer),
nat_t AS (SELECT 'subject-' || n_nationkey AS id, n_name AS en, 'y ' || n_name AS cy,
  upper(n_name[1]) || lower(n_name[2:]) AS cap FROM nation),
fam AS (
{_family('nat_t', {**_N, 'En': 'cap'}, 0, '{id}', '{En}', '{cy}', ['{en}', 'help with {en}'], ['cymorth {cy}'], ['{en}'], ['{cy}'], '{en} support', 7)}
UNION ALL {_family('part_t', _N, 1, 'subject-{id}', '{en} course', 'cwrs {cy}', ['study {en}', '{en} degree', '{en} BA', '{en} BSc'],
    ['astudio {cy}', 'gradd {cy}'], ['{en}', '{en} degree', '{en} course', 'BA {en}', 'BSc {en}'], ['{cy}', 'gradd {cy}'],
    '{en} undergraduate postgraduate course modules', 6)}
UNION ALL {_family('part_t', _N, 2, 'subject-{id}-careers', '{en} careers / employability', 'Gyrfaoedd {cy}',
    ['what jobs can I get with a {en} degree', '{en} graduate careers', 'is {en} a good degree for jobs'], ['gyrfaoedd {cy}', 'swyddi {cy}'],
    ['{en} careers', '{en} jobs', '{en} graduate'], ['gyrfaoedd {cy}'], '{en} graduate careers employability', 5)}
UNION ALL {_family('part_t', _N, 3, 'subject-{id}-entry', '{en} entry requirements', 'Gofynion mynediad {cy}',
    ['what grades for {en}', '{en} entry requirements', 'A-levels needed for {en}'], ['gofynion mynediad {cy}'],
    ['{en} entry requirements', '{en} A-level requirements'], ['gofynion {cy}'], '{en} entry requirements grades needed', 5)}
UNION ALL {_family(_grid(pc.SERVICES, 'supp_t'), _G, 4, 'campus-{id}-{sid}', '{en} {sen}', '{cy} {scy}',
    ['{en} {sen}', '{sen} at {en} campus', 'where is the {sen} in {en}', '{en} campus {sen} location'], ['{scy} {cy}'],
    ['{en} {sen}', '{sen} {en}'], ['{scy} {cy}'], '{en} campus {sen} location opening hours contact', 4)}
UNION ALL {_family(_grid(pc.CONCERNS, 'seg_t'), _G, 5, 'student-{id}-{sid}', '{en} — {sen}', '{cy} — {scy}',
    ['{sen} for {en}s', '{en} {sen}', 'as a {en}, {sen}'], ['{scy} ar gyfer {cy}'], ['{en} {sen}'], ['{cy} {scy}'],
    '{en} {sen} support eligibility process', 4)}),
last AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS r FROM fam)
SELECT id, title, title_cy, priority::BIGINT AS priority, hint, len(en) AS n_en, len(cy) AS n_cy,
  md5(array_to_string(en, '|')) AS en_md5, md5(array_to_string(cy, '|')) AS cy_md5 FROM last WHERE r = 1"""

_EMB = strip("source || chr(10) || text")
_STRIPPED = strip("x")
_TC = f"seq, {{}} AS cy, {{}} AS en"
MERGED_PATTERNS = """merged AS (SELECT DISTINCT tag, pattern FROM (SELECT tag, pattern FROM patterns WHERE seq % 2 = 0 UNION ALL SELECT tag, pattern FROM whole)),
added AS (SELECT tag, min_by(pattern, seq) AS pattern, lower(trim(pattern)) AS k FROM tagged_turns WHERE tag IN (SELECT tag FROM whole) GROUP BY tag, k),
merged_patterns AS (SELECT tag, 'merged' AS origin, pattern FROM merged
  UNION ALL SELECT tag, 'added', pattern FROM added a WHERE k <> '' AND NOT EXISTS (SELECT 1 FROM merged m WHERE m.tag = a.tag AND lower(trim(m.pattern)) = a.k))"""
ORACLES = {
    "bounded_sample": with_(PASSAGES, body=f"""
SELECT doc_id, {STUDY} AS relevant FROM (SELECT * FROM passages ORDER BY doc_id LIMIT {pc.SAMPLE}) WHERE length(text) BETWEEN 80 AND 1200"""),
    "keyword_filter": with_(PASSAGES, body=f"SELECT doc_id, {STUDY} AS study, {GENERAL} AS general FROM passages"),
    "length_band": with_(PASSAGES, body="SELECT doc_id, " + ", ".join(
        f"length(text) BETWEEN {lo} AND {hi} AS {n}" for n, lo, hi in rules.LENGTH_BANDS)
        + f", length(text) >= {rules.MIN_PAGE_CHARS} AS page, length(text) >= {rules.MIN_PASSAGE_CHARS} AS passage FROM passages"),
    "welsh_filter": with_(PASSAGES, body=f"""
SELECT doc_id, {rx('text', rules.CIRCUMFLEX)} OR len(list_intersect(list_distinct({lang.letters('text')}), {lst(rules.ANSWER_WORDS)})) >= 2 AS welsh
FROM passages"""),
    "filter_funnel": with_(PASSAGES, body=f"""
SELECT count(*) AS scanned, count(*) FILTER (WHERE r) AS relevant, count(*) FILTER (WHERE q) AS quality,
  count(*) FILTER (WHERE r AND q) AS matched, count(*) FILTER (WHERE NOT (r AND q)) AS skipped
FROM (SELECT {GENERAL} AS r, length(text) BETWEEN 80 AND 1200 AS q FROM passages)"""),
    "first_qa_pair": with_(PAIRS, body="SELECT conv_id, question, answer FROM pairs"),
    "qa_docs": with_(PAIRS, body=f"""
SELECT conv_id, substring(question, 1, {rules.TITLE_CHARS}) AS title, md5('Q: ' || question || chr(10) || chr(10) || 'A: ' || answer) AS text_md5,
  CASE WHEN {rx('answer', rules.CIRCUMFLEX)} OR len(list_intersect(list_distinct({lang.letters('answer')}), {lst(rules.ANSWER_WORDS)})) >= 2
    THEN 'cy' END AS lang FROM pairs"""),
    "qa_incremental": with_(PAIRS, body="""
SELECT conv_id, question FROM pairs WHERE conv_id % 3 <> 0 AND question NOT IN (SELECT question FROM pairs WHERE conv_id % 2 = 0)"""),
    "answer_aliases": f"""
SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIPPED}), lambda x: x <> ''), ' / ')) AS joined_md5
FROM documents""",
    "facts_docs": with_(FACTS, FACT_DOCS, body="SELECT title, source, lang, md5(text) AS text_md5 FROM fact_docs"),
    "knowledge_docs": with_(RESPONSES, KNOW_DOCS, body="SELECT title, lang, md5(text) AS text_md5 FROM know_docs"),
    "lexicon_merge": with_(MERGED, body="""
SELECT cy, p.en, origin, back FROM pairs_cy p LEFT JOIN (SELECT en, min(cy) AS back FROM pairs_cy GROUP BY en) r ON p.en = r.en"""),
    "lexicon_bootstrap": with_(MERGED, _BOOT, body="SELECT title, text, lang FROM boot"),
    "term_normalise": with_(LEXICON_RECORDS, body="""
SELECT seq, lower(trim(cy)) AS cy, lower(trim(CASE seq % 4 WHEN 1 THEN '' ELSE en END)) AS en FROM records
WHERE seq % 4 <> 1 AND lower(trim(cy)) <> lower(trim(en)) AND trim(cy) <> ''"""),
    "term_tokens": with_(TERMS, body="SELECT term FROM terms"),
    "vocab_build": with_(MERGED, TERMS, VOCAB, body="SELECT term FROM vocab"),
    "embed_refresh": f"""
SELECT doc_id, hash, CASE WHEN cached IS NULL THEN 'new' WHEN cached <> hash THEN 'stale' ELSE 'reuse' END AS action FROM (
  SELECT doc_id, sha1(t)[1:16] AS hash, CASE WHEN doc_id % 5 <> 0 THEN sha1(CASE WHEN doc_id % 7 = 0 THEN t || 'x' ELSE t END)[1:16] END AS cached
  FROM (SELECT doc_id, {_EMB} AS t FROM documents))""",
    "corpus_union": with_(FACTS, FACT_DOCS, RESPONSES, KNOW_DOCS, MERGED, _BOOT, body=f"""
SELECT source, title, lang, md5(text) AS text_md5 FROM (
  SELECT 'corpus' AS source, 'corpus_' || doc_id AS title, {lang.quick_or_english('t')} AS lang, t AS text FROM
    (SELECT doc_id, {strip('text')} AS t FROM documents) WHERE t <> ''
  UNION ALL SELECT 'facts', title, lang, text FROM fact_docs UNION ALL SELECT 'knowledge', title, lang, text FROM know_docs
  UNION ALL SELECT 'lexicon', title, lang, text FROM boot)"""),
    "dialogue_acts": with_(TURNS, MINED, body="SELECT category, phrase FROM mined"),
    "exemplar_chunks": with_(TURNS, MINED, body=f"""
SELECT category, 'How to reply: ' || category AS title, CASE category {_TEMPL} END || string_agg('"' || phrase || '"', ', ' ORDER BY phrase) || '.' AS content
FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY phrase) AS r FROM mined) WHERE r <= 20 GROUP BY category"""),
    "pattern_merge": with_(PATTERNS, WHOLE, TAGGED_TURNS, body=f"""
, {MERGED_PATTERNS} SELECT tag, origin, md5(pattern) AS pattern_md5 FROM merged_patterns"""),
    "nb_intent": with_(PATTERNS, WHOLE, TAGGED_TURNS, TURNS, body=f"""
, {MERGED_PATTERNS},
nb_p AS (SELECT row_number() OVER () AS r, tag, {preprocess('pattern', rules.EN_STOP)} AS t FROM merged_patterns),
nb_q AS (SELECT conv_id || ':' || turn AS turn_id, {preprocess('text', rules.EN_STOP)} AS t FROM turns WHERE role = 'user'),
{stems('SELECT unnest(t) AS term FROM nb_p UNION ALL SELECT unnest(t) FROM nb_q')},
pt AS (SELECT DISTINCT r, tag, coalesce(stem, term) AS term FROM (SELECT r, tag, unnest(t) AS term FROM nb_p) LEFT JOIN stems USING (term)),
qt AS (SELECT DISTINCT turn_id, coalesce(stem, term) AS term FROM (SELECT turn_id, unnest(t) AS term FROM nb_q) LEFT JOIN stems USING (term)),
cls AS (SELECT tag, count(DISTINCT r) + 1 AS c FROM pt GROUP BY tag),
total AS (SELECT count(DISTINCT r) + 1 AS n FROM pt),
n AS (SELECT term, tag, count(*) AS n FROM pt GROUP BY ALL),
known AS (SELECT qt.* FROM qt WHERE term IN (SELECT term FROM n)),
every AS (SELECT turn_id, cls.tag, c, ln(c / total.n) AS prior FROM nb_q, cls, total),
scored AS (SELECT e.turn_id, e.tag, round(any_value(prior) + coalesce(sum(ln((coalesce(n.n, 0) + 1) / c)) FILTER (WHERE k.term IS NOT NULL), 0), 6) AS score
  FROM every e LEFT JOIN known k ON k.turn_id = e.turn_id LEFT JOIN n ON n.term = k.term AND n.tag = e.tag GROUP BY e.turn_id, e.tag)
SELECT turn_id, tag, score FROM scored QUALIFY row_number() OVER (PARTITION BY turn_id ORDER BY score DESC, tag) = 1"""),
    "pattern_dedupe": with_(PATTERNS, WHOLE, TAGGED_TURNS, body=f"""
, allp AS (SELECT *, lower(trim(pattern)) AS k FROM (SELECT seq, tag, pattern FROM whole UNION ALL SELECT seq + 4611686018427387904, tag, pattern FROM tagged_turns)),
g AS (SELECT k, min_by(tag, seq) AS first, count(*) AS n, {_OVERRIDE} AS o, bool_or(tag = coalesce({_OVERRIDE}, '')) AS held FROM allp GROUP BY k)
SELECT seq, tag, pattern, n > 1 AND k <> '' AND coalesce(tag <> CASE WHEN o IS NULL THEN first WHEN held THEN o END, false) AS removed
FROM allp JOIN g USING (k)"""),
    "kb_audit": with_(PATTERNS, WHOLE, RESPONSES, FACTS, body=f"""
, pt AS (SELECT tag, count(*) AS p FROM whole GROUP BY 1),
rs AS (SELECT tag, count(*) FILTER (WHERE shape IN (0, 1)) AS en, count(*) FILTER (WHERE shape = 2) AS cy FROM responses GROUP BY 1),
pp AS (SELECT tag, coalesce(p, 0) AS p, coalesce(en, 0) AS en, coalesce(cy, 0) AS cy FROM pt FULL JOIN rs USING (tag)),
fk AS (SELECT lower(trim(pattern)) AS k, min_by(tag, seq) AS first FROM whole GROUP BY 1),
problems AS (
  SELECT 'R1' AS rule, tag, 'only ' || p || ' patterns' AS msg FROM pp WHERE p < 3
  UNION ALL SELECT 'R1', tag, 'only ' || en || ' English responses' FROM pp WHERE en < 2
  UNION ALL SELECT 'R1', tag, 'only ' || cy || ' Welsh responses' FROM pp WHERE cy < 2
  UNION ALL SELECT 'R2', tag, p || ' patterns' FROM pp WHERE p > 40
  UNION ALL SELECT 'R3', id, 'missing Welsh answer' FROM facts WHERE coalesce(answer_cy, '') = ''
  UNION ALL SELECT 'R3', id, 'no Welsh question' FROM facts WHERE NOT ({rx('question', rules.DIACRITIC_WIDE)} OR {rx('question', r'\b(sut|beth|ble|pryd|pam|faint|ydy|yw)\b')})
  UNION ALL SELECT 'R4', id, 'fees fact without qualifiers' FROM facts WHERE contains(id, 'fees-') AND len(qualifiers) = 0
  UNION ALL SELECT 'R4', id, 'unknown qualifier ' || x FROM (SELECT id, unnest(qualifiers) AS x FROM facts) WHERE contains(id, 'fees-') AND x NOT IN {in_list(rules.AUDIT_QUALIFIERS)}
  UNION ALL SELECT 'R5', tag, 'duplicate pattern of ' || first || ': ' || k FROM (SELECT tag, lower(trim(pattern)) AS k FROM whole) JOIN fk USING (k)
    WHERE k <> '' AND tag <> first)
SELECT rule, tag, msg, n_issues FROM (SELECT *, count(*) OVER (PARTITION BY rule) AS n_issues,
  row_number() OVER (PARTITION BY rule ORDER BY tag, msg) AS r FROM problems) WHERE r <= 30"""),
    "inventory_counts": with_(MERGED, TERMS, VOCAB, TOPICS, body="""
SELECT 'documents' AS metric, count(*) AS n FROM documents UNION ALL SELECT 'vocabulary', count(*) FROM vocab
UNION ALL SELECT 'pairs', count(*) FROM pairs_cy UNION ALL SELECT 'reverse_pairs', count(DISTINCT en) FROM pairs_cy
UNION ALL SELECT 'topics', count(*) FROM topics UNION ALL SELECT 'phrases', sum(len(string_split(phrases, chr(10))))::BIGINT FROM topics"""),
    "topic_grid": TOPIC_GRID,
    "response_pick": with_(TURNS, RESPONSES, body=f"""
, r AS (SELECT tag, CASE WHEN shape = 2 THEN 'cy' ELSE 'en' END AS lang, text, row_number() OVER (PARTITION BY tag, shape = 2 ORDER BY seq) - 1 AS i,
  count(*) OVER (PARTITION BY tag, shape = 2) AS n FROM responses),
a AS (SELECT conv_id, turn, ({lst(inputs.INTENT_TAGS)})[(conv_id + turn) % {len(inputs.INTENT_TAGS)} + 1] AS tag,
  CASE WHEN turn % 4 = 0 THEN 'cy' ELSE 'en' END AS lang, conv_id * 31 + turn AS draw FROM turns WHERE role = 'user' AND conv_id >= 0),
l AS (SELECT a.*, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.tag = a.tag AND r.lang = a.lang) THEN a.lang ELSE 'en' END AS use FROM a)
SELECT conv_id, turn, l.tag, md5(text) AS response_md5 FROM l LEFT JOIN r ON r.tag = l.tag AND r.lang = use AND draw % n = i"""),
}
