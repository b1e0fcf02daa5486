"""DuckDB text of the operators that SQL can express. Written from the definitions, not from the Spark plans."""

from __future__ import annotations

from tidemark.llm import quality

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

DECONTAMINATION = r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS s, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
td AS (SELECT r, doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM t),
tb AS (SELECT s, item_id, len(w) AS n, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM b WHERE len(w) >= 8),
gd AS (SELECT r, i, tok || ' ' || lead(tok, 1) OVER p || ' ' || lead(tok, 2) OVER p || ' ' || lead(tok, 3) OVER p AS g FROM td WINDOW p AS (PARTITION BY r ORDER BY i)),
gb AS (SELECT s, i, tok || ' ' || lead(tok, 1) OVER p || ' ' || lead(tok, 2) OVER p || ' ' || lead(tok, 3) OVER p AS g FROM tb WINDOW p AS (PARTITION BY s ORDER BY i)),
diag AS (SELECT DISTINCT r, s, gd.i - gb.i AS shift FROM gd JOIN gb USING (g)),
al AS (SELECT diag.r, diag.s, shift, tb.i, tb.n, tb.item_id, td.doc_id, CASE WHEN td.tok = tb.tok THEN 1 ELSE 0 END AS same
       FROM diag JOIN tb USING (s) LEFT JOIN td ON td.r = diag.r AND td.i = tb.i + shift),
win AS (SELECT r, s, n, item_id, sum(same) OVER (PARTITION BY r, s, shift ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS agree FROM al),
best AS (SELECT r, s, n, item_id, max(agree) AS agreeing FROM win GROUP BY ALL)
SELECT doc_id, best.item_id, CAST(max(agreeing) AS INTEGER) AS agreeing FROM best JOIN t USING (r)
WHERE agreeing >= CASE WHEN n < 13 THEN n ELSE 11 END GROUP BY doc_id, best.item_id
"""

LINE_DEDUP = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS site, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, site, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
n AS (SELECT *, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm FROM l),
wide AS (SELECT norm FROM n WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT site) >= 8),
ranked AS (SELECT n.*, wide.norm IS NOT NULL AS hit, row_number() OVER (PARTITION BY n.norm ORDER BY doc_id, pos) AS k FROM n LEFT JOIN wide USING (norm)),
agg AS (SELECT r, count(*) FILTER (norm <> '') AS n_lines, count(*) FILTER (hit AND k > 1) AS n_removed,
        string_agg(line, chr(10) ORDER BY pos) FILTER (NOT (hit AND k > 1)) AS kept FROM ranked GROUP BY r)
SELECT doc_id, n_lines, n_removed, CASE WHEN n_removed = 0 THEN text ELSE coalesce(kept, '') END AS text FROM d JOIN agg USING (r)
"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.replace('text', "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM d),
n AS (SELECT doc_id, len(sh) AS n FROM s),
u AS (SELECT doc_id, unnest(sh) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS v, doc_id AS x FROM n UNION SELECT reach.v, sym.b FROM reach JOIN sym ON reach.x = sym.a)
SELECT n.doc_id, n.n AS n_shingles, m.component_id FROM n JOIN (SELECT v, min(x) AS component_id FROM reach GROUP BY v) m ON m.v = n.doc_id
"""


COLLOCATIONS = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS r,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
nn AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) + 2 - k), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM w, range(1, 5) AS x(k) WHERE len(w) >= k),
f AS (SELECT lang, k, g, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM f WHERE k >= 2),
cuts AS (SELECT c.*, cut, array_to_string(w[1:cut], ' ') AS lp, array_to_string(w[cut + 1:], ' ') AS rp FROM c, range(1, 4) AS x(cut) WHERE cut < k),
s AS (SELECT cuts.*, l.f AS l, r.f AS r, (CAST(2000000 AS HUGEINT) * a) // (l.f + r.f) AS score
      FROM cuts JOIN f l ON l.lang = cuts.lang AND l.g = lp JOIN f r ON r.lang = cuts.lang AND r.g = rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
sub AS (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS i FROM c, range(2, 4) AS x(m) WHERE m < k),
longer AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS g, max(a) AS top FROM sub GROUP BY ALL),
kept AS (SELECT b.* FROM b LEFT JOIN longer USING (lang, g) WHERE top IS NULL OR 100 * CAST(top AS HUGEINT) < 80 * CAST(a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept)
SELECT lang, rank, g AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN nn USING (lang) WHERE rank <= 2000
"""


def _quality() -> str:
    ratio = {k: f"({top} / greatest({below}, 1))" for k, (top, below, _) in quality.RATIOS.items()}
    # the least value whose rank reaches the share, as the digests return it
    spot = {q: f"quantile_disc({{x}}, {q})" for q in (0.25, 0.5, 0.75)}
    cuts, bad = [], []
    for k, (top, _, least) in quality.RATIOS.items():
        q1, q2, q3 = (spot[q].format(x=k) for q in (0.25, 0.5, 0.75))
        cuts.append(f"{q2} + {quality.SPREAD} * greatest({q3} - {q2}, {least}) AS {k}_high")
        bad.append(f"({ratio[k]} > coalesce(o.{k}_high, l.{k}_high, g.{k}_high) AND {top} >= {quality.LEAST_CASES})")
        if k in quality.TWO_SIDED:
            cuts.append(f"{q2} - {quality.SPREAD} * greatest({q2} - {q1}, {least}) AS {k}_low")
            bad.append(f"{ratio[k]} < coalesce(o.{k}_low, l.{k}_low, g.{k}_low)")
    cuts_sql = ", ".join(cuts)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text, {_WORDS} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g5 AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM d WHERE len(w) >= 5),
h5 AS (SELECT r, i, array_to_string(w[i:i + 4], ' ') AS g FROM g5),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM h5) WHERE k > 1),
cover AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM twice, range(0, 5) AS x(o) GROUP BY r),
m AS (SELECT d.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_stutter, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN cover USING (r)),
q AS (SELECT lang, source, {", ".join(f"{v} AS {k}" for k, v in ratio.items())} FROM m WHERE n_words > 0),
o AS (SELECT lang, source, {cuts_sql} FROM q GROUP BY lang, source HAVING count(*) >= {quality.GROUP_ROWS}),
l AS (SELECT lang, {cuts_sql} FROM q GROUP BY lang HAVING count(*) >= {quality.GROUP_ROWS}),
g AS (SELECT {cuts_sql} FROM q),
j AS (SELECT m.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {" OR ".join(bad)} AS bad
  FROM m CROSS JOIN g LEFT JOIN o ON m.lang IS NOT DISTINCT FROM o.lang AND m.source IS NOT DISTINCT FROM o.source LEFT JOIN l ON m.lang IS NOT DISTINCT FROM l.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(bad, false) AS kept FROM j
"""


ORACLES = {"op2_spaced_seeds": DECONTAMINATION, "op3_line_dedup": LINE_DEDUP, "op4_signature_trees": JACCARD, "op5_quality_rules": _quality(),
           "op12_collocations": COLLOCATIONS}
