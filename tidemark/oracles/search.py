"""DuckDB text for the retrieval queries."""

from __future__ import annotations

from tidemark import rules
from tidemark.oracles.dialect import QUESTIONS, TAGGED, content_tokens, preprocess, q, strip, with_
from tidemark.oracles.stem import stems

_TOK = "regexp_extract_all(lower({}), '[a-zâêîôûŵŷ0-9]+')"
BM25 = f"""toks AS (SELECT doc_id, {_TOK.format('text')} AS t FROM documents),
docs AS (SELECT doc_id, t, len(t) AS dl FROM toks WHERE len(t) > 0),
stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM docs),
post AS (SELECT doc_id, any_value(dl) AS dl, term, count(*) AS tf FROM (SELECT doc_id, dl, unnest(t) AS term FROM docs) GROUP BY doc_id, term),
raw AS (SELECT term, count(*) AS df, ln((SELECT n FROM stats) - count(*) + 0.5) - ln(count(*) + 0.5) AS r FROM post GROUP BY term),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN {rules.BM25_EPSILON} * (SELECT avg(r) FROM raw) ELSE r END AS idf FROM raw),
qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({_TOK.format('text')}) AS term FROM benchmark) GROUP BY 1, 2),
bm25 AS (SELECT item_id, doc_id, round(sum(qtf * idf * tf * {rules.BM25_K1 + 1} /
    (tf + {rules.BM25_K1} * (1 - {rules.BM25_B} + {rules.BM25_B} * dl / (SELECT avgdl FROM stats)))), 6) AS score
  FROM qt JOIN idf USING (term) JOIN post USING (term) GROUP BY 1, 2)"""
_RANK = "row_number() OVER (PARTITION BY item_id ORDER BY score DESC, {})"


def bm25_top(k: int) -> str:
    return (f"bm25_top AS (SELECT * FROM (SELECT item_id, doc_id, score, {_RANK.format('doc_id')} AS rnk "
            f"FROM bm25 WHERE score > 0) WHERE rnk <= {k})")


def tfidf(docs_sql: str, queries_sql: str, name: str = "tfidf", idcol: str = "doc_id", qcol: str = "item_id", stemming: bool = False) -> str:
    """CTEs scoring (query, terms list) against (doc, terms list); stemmed where both sides have a lang."""
    lang, stem = (", lang", f"CASE WHEN lang = 'en' THEN coalesce(stem, term) ELSE term END AS term") if stemming else ("", "term")
    join = " LEFT JOIN stems USING (term)" if stemming else ""
    vocabulary = f",\n{stems(f'SELECT unnest(t) AS term FROM {name}_d UNION ALL SELECT unnest(t) FROM {name}_q')}" if stemming else ""
    return f"""{name}_d AS ({docs_sql}), {name}_q AS ({queries_sql}){vocabulary},
{name}_n AS (SELECT count(*) AS n FROM {name}_d),
{name}_p AS (SELECT {idcol}, term, count(*) AS tf FROM (SELECT {idcol}, {stem} FROM (SELECT {idcol}{lang}, unnest(t) AS term FROM {name}_d){join}) GROUP BY 1, 2),
{name}_f AS (SELECT term, count(*) AS df FROM {name}_p GROUP BY 1),
{name}_t AS (SELECT {qcol}, term, count(*) AS qtf FROM (SELECT {qcol}, {stem} FROM (SELECT {qcol}{lang}, unnest(t) AS term FROM {name}_q){join}) GROUP BY 1, 2),
{name} AS (SELECT {qcol}, {idcol}, sum(qtf * tf * (1 + ln((SELECT n FROM {name}_n) / (1 + df)))) AS score
  FROM {name}_t JOIN {name}_f USING (term) JOIN {name}_p USING (term) GROUP BY 1, 2)"""


def by_lang(col: str, lang: str) -> str:
    """Terms outside the stoplist of the language."""
    return f"CASE WHEN {lang} = 'cy' THEN {preprocess(col, rules.CY_STOP)} ELSE {preprocess(col, rules.EN_STOP)} END"


def _two(lang: str) -> str:
    return f"CASE WHEN {lang} = 'cy' THEN 'cy' ELSE 'en' END"


TFIDF = TAGGED + ",\n" + QUESTIONS + ",\n" + tfidf(
    f"SELECT doc_id, {_two('lang')} AS lang, {by_lang('source || chr(10) || text', 'lang')} AS t FROM tagged",
    f"SELECT item_id, {_two('query_lang')} AS lang, {by_lang('text', 'query_lang')} AS t FROM questions", stemming=True) + f""",
tfidf_top AS (SELECT * FROM (SELECT item_id, doc_id, score, {_RANK.format('doc_id')} AS rnk
  FROM (SELECT item_id, doc_id, round(score, 6) AS score FROM tfidf) WHERE score > {rules.TFIDF_FLOOR}) WHERE rnk <= 20)"""

_COS = "round(list_cosine_similarity(q.v, v.v), 6)"
VEC = """v AS (SELECT vec_id, embedding::DOUBLE[] AS v, t.lang FROM embeddings LEFT JOIN tagged t ON t.doc_id = vec_id),
qv AS (SELECT item_id, query_lang, embedding::DOUBLE[] AS v FROM questions JOIN embeddings ON vec_id = item_id),
cos AS (SELECT q.item_id, q.query_lang, v.vec_id, v.lang, round(list_cosine_similarity(q.v, v.v), 6) AS score FROM qv q, v)"""
DENSE = f"""dense AS (SELECT item_id, vec_id, score, {_RANK.format('vec_id')} AS rnk FROM cos WHERE score > 0)"""
_POOL = "CASE query_lang WHEN 'cy' THEN 10 ELSE 8 END"
_ALLOWED = ("CASE query_lang WHEN 'cy' THEN lang IS NOT DISTINCT FROM 'cy' "
            "WHEN 'en' THEN lang IS DISTINCT FROM 'cy' ELSE true END")
DENSE_LANG = f"""dense_lang AS (SELECT * FROM (SELECT item_id, query_lang, vec_id, score, {_RANK.format('vec_id')} AS rnk
  FROM cos WHERE {_ALLOWED}) WHERE rnk <= {_POOL})"""
KEYS = f"keys AS (SELECT doc_id, md5(text) AS key, text, lang FROM tagged)"


def topup(fill: str) -> str:
    """Filtered dense lists extended from the general ranking when under-filled."""
    return f"""{DENSE_LANG},
f AS (SELECT item_id, query_lang, key, doc_id, rnk FROM dense_lang JOIN keys ON doc_id = vec_id),
g AS (SELECT item_id, query_lang, key, doc_id, rnk FROM (SELECT item_id, query_lang, vec_id, lang, {_RANK.format('vec_id')} AS rnk
  FROM cos WHERE query_lang IS NOT NULL) c JOIN keys k ON k.doc_id = c.vec_id
  WHERE rnk <= {_POOL} AND (query_lang <> 'en' OR k.lang IS DISTINCT FROM 'cy')),
have AS (SELECT item_id, count(*) AS n FROM f GROUP BY 1),
extra AS (SELECT item_id, query_lang, key, doc_id, rnk FROM (
  SELECT g.*, row_number() OVER (PARTITION BY g.item_id, g.key ORDER BY g.rnk) AS dup FROM g LEFT JOIN have USING (item_id)
  WHERE coalesce(have.n, 0) < {fill} AND NOT EXISTS (SELECT 1 FROM f WHERE f.item_id = g.item_id AND f.key = g.key)) WHERE dup = 1),
filled AS (SELECT item_id, key, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY extra, rnk) AS rnk FROM (
  SELECT item_id, key, doc_id, rnk, 0 AS extra FROM f UNION ALL SELECT item_id, key, doc_id, rnk, 1 FROM extra))"""


def fused(a: str, b: str, an: str, bn: str, k: str) -> str:
    return f"""fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id
    ORDER BY score DESC, {an}_rank ASC NULLS LAST, {bn}_rank ASC NULLS LAST, key) AS rnk FROM (
  SELECT item_id, key, round(sum(1.0 / ({rules.RRF_K} + r)), 6) AS score,
    min(r) FILTER (WHERE s = 1) AS {an}_rank, min(r) FILTER (WHERE s = 2) AS {bn}_rank
  FROM (SELECT item_id, key, rnk AS r, 1 AS s FROM ({a}) UNION ALL SELECT item_id, key, rnk, 2 FROM ({b})) GROUP BY 1, 2))
  WHERE rnk <= {k})"""


def rerank_body(cands: str, k: int) -> str:
    """Rerank ``cands`` (item_id, doc_id, fused, input_rank)."""
    return f"""base AS (SELECT c.item_id, c.doc_id, c.fused, c.input_rank, count(*) OVER (PARTITION BY c.item_id) AS n,
    list_distinct({content_tokens('b.text', 3, rules.RERANK_STOP)}) AS asked,
    {content_tokens('d.text', 3, rules.RERANK_STOP)} AS have
  FROM ({cands}) c JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id)),
hits AS (SELECT *, list_intersect(list_distinct(have), asked) AS hit FROM base),
tdf AS (SELECT item_id, term, count(*) AS df FROM (SELECT item_id, unnest(hit) AS term FROM hits) GROUP BY 1, 2),
ov AS (SELECT h.item_id, h.doc_id, sum(ln(1 + h.n / (1 + tdf.df))) AS overlap
  FROM (SELECT item_id, doc_id, n, unnest(hit) AS term FROM hits) h JOIN tdf USING (item_id, term) GROUP BY 1, 2),
sc AS (SELECT item_id, doc_id, input_rank, CASE WHEN len(asked) > 0 THEN len(hit) / len(asked) ELSE 0 END AS cov, fused,
    coalesce(overlap, 0) AS overlap, len(have) AS l FROM hits LEFT JOIN ov USING (item_id, doc_id))
SELECT item_id, doc_id, rerank_score, coverage, rnk FROM (SELECT *, row_number() OVER (PARTITION BY item_id
    ORDER BY rerank_score DESC, input_rank) AS rnk FROM (
  SELECT item_id, doc_id, input_rank, round((1 + 2 * fused) * (1 + cov) * overlap / (1 + ln(1 + l)), 6) AS rerank_score,
    round(cov, 6) AS coverage FROM sc)) WHERE rnk <= {k}"""


_NORM = "sqrt(list_sum(list_transform(e, lambda x: x * x)))"
ORACLES = {
    "bm25_stats": with_(BM25, body="SELECT term, df, round(idf, 6) AS idf, round((SELECT avgdl FROM stats), 6) AS avgdl FROM idf"),
    "bm25_topk": with_(BM25, bm25_top(5), body="SELECT item_id, doc_id, score, rnk FROM bm25_top"),
    "bm25_topk_lang": with_(BM25, TAGGED, QUESTIONS, body=f"""
SELECT item_id, doc_id, score, rnk FROM (SELECT item_id, doc_id, query_lang, score, {_RANK.format('doc_id')} AS rnk
  FROM bm25 JOIN questions USING (item_id) JOIN tagged USING (doc_id) WHERE score > 0 AND {_ALLOWED}) WHERE rnk <= {_POOL}"""),
    "tfidf_topk": with_(TFIDF, body="SELECT item_id, doc_id, score, rnk FROM tfidf_top"),
    "dense_topk": with_(TAGGED, QUESTIONS, VEC, DENSE, body="SELECT item_id, vec_id, score, rnk FROM dense WHERE rnk <= 20"),
    "dense_topk_lang": with_(TAGGED, QUESTIONS, VEC, DENSE_LANG, body="SELECT item_id, vec_id, score, rnk FROM dense_lang"),
    "dense_topup": with_(TAGGED, QUESTIONS, VEC, KEYS, topup("12"), body="SELECT item_id, rnk, doc_id FROM filled"),
    "vector_normalise": f"""
SELECT vec_id, round(e[1] / {_NORM}, 6) AS first, round(list_sum(list_transform(e, lambda x: x / {_NORM})), 5) AS total,
  round(2 - 2 * list_cosine_similarity(e, list_reverse(e)), 5) AS distance_to_reverse
FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)""",
    "vector_load": with_(TAGGED, body="""
SELECT vec_id, coalesce(lang, 'en') AS lang, len(embedding) AS dim FROM embeddings LEFT JOIN tagged ON doc_id = vec_id
WHERE len(embedding) > 0"""),
    "rrf_fuse": with_(BM25, bm25_top(8), TAGGED, QUESTIONS, VEC, DENSE, KEYS,
                      fused("SELECT item_id, key, rnk FROM dense JOIN keys ON doc_id = vec_id WHERE rnk <= 8",
                            "SELECT item_id, key, rnk FROM bm25_top JOIN keys USING (doc_id)", "dense", "sparse", "4"),
                      body="SELECT item_id, rnk, md5(key) AS key, score, dense_rank, sparse_rank FROM fused"),
    "hybrid_search": with_(
        BM25, TAGGED, QUESTIONS, VEC, KEYS, topup("CASE g.query_lang WHEN 'cy' THEN 5 ELSE 4 END"),
        f"""sparse AS (SELECT item_id, key, rnk FROM (SELECT item_id, doc_id, query_lang, score, {_RANK.format('doc_id')} AS rnk
  FROM bm25 JOIN questions USING (item_id) JOIN tagged USING (doc_id) WHERE score > 0 AND {_ALLOWED})
  JOIN keys USING (doc_id) WHERE rnk <= {_POOL})""",
        fused("SELECT item_id, key, rnk FROM filled", "SELECT item_id, key, rnk FROM sparse", "dense", "sparse", "5"),
        body="""SELECT item_id, rnk, md5(key) AS key, score FROM fused JOIN questions USING (item_id)
WHERE trim(text) <> '' AND rnk <= CASE query_lang WHEN 'cy' THEN 5 WHEN 'en' THEN 4 ELSE 2 END"""),
    "rerank": with_(BM25, bm25_top(10), rerank_body(
        f"SELECT item_id, doc_id, round(1.0 / ({rules.RRF_K} + rnk), 6) AS fused, rnk AS input_rank FROM bm25_top", 5), body=""),
    "hybrid_rerank": with_(TFIDF, VEC, DENSE,
                           fused("SELECT item_id, doc_id AS key, rnk FROM tfidf_top",
                                 "SELECT item_id, vec_id AS key, rnk FROM dense WHERE rnk <= 20", "lexical", "dense", "10"),
                           rerank_body("SELECT item_id, key AS doc_id, score AS fused, rnk AS input_rank FROM fused "
                                       "WHERE key IN (SELECT doc_id FROM documents)", 5), body=""),
    "context_block": with_(BM25, bm25_top(4), f"""
p AS (SELECT item_id, rnk, substring(text, 1, 500) AS short, {strip('text')} AS s FROM bm25_top JOIN documents USING (doc_id)),
r AS (SELECT *, sum(length(short)) OVER (PARTITION BY item_id ORDER BY rnk) AS run FROM p)""", body=f"""
SELECT item_id, md5(coalesce(string_agg(short, chr(10) || chr(10) ORDER BY rnk) FILTER (WHERE rnk <= 2 AND run <= 1200), '')) AS short_block,
  md5(coalesce(string_agg(CASE WHEN length(s) > 300 THEN rtrim(substring(s, 1, 300)) || '…' ELSE s END, chr(10) || chr(10) ORDER BY rnk)
    FILTER (WHERE s <> ''), '')) AS long_block FROM r GROUP BY 1"""),
    "relevance_gate": with_(BM25, bm25_top(5), body=r"""
SELECT item_id, doc_id, len(list_filter(list_filter(regexp_split_to_array(lower(b.text), '\s+'), lambda w: length(w) > 3),
    lambda w: contains(lower(d.text), w))) > 0 AS relevant
FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY rnk) AS first FROM bm25_top) h
JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id) WHERE first = 1"""),
}
