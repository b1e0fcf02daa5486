"""DuckDB text for the web queries."""

from __future__ import annotations

from tidemark import rules
from tidemark.oracles.dialect import q, rx_any, squeeze
from tidemark.plans.web import DOMAINS

_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]+)?"


def part(col: str, i: int) -> str:
    return f"regexp_extract({col}, {q(_URL)}, {i})"


def norm(col: str) -> str:
    path = f"regexp_replace(regexp_replace({part(col, 3)}, ';[^/]*$', ''), '/+$', '')"
    return (f"CASE WHEN regexp_matches({col}, {q(_URL)}) THEN lower({part(col, 1)}) || '://' || lower({part(col, 2)}) || "
            f"CASE WHEN {path} = '' THEN '/' ELSE {path} END || {part(col, 4)} ELSE {col} END")


def allowed(col: str) -> str:
    names = "|".join(d.replace(".", r"\.") for d in DOMAINS)
    return rf"regexp_matches(lower({part(col, 2)}), '(^|\.)({names})$')"


def skip(col: str) -> str:
    return rx_any(col, rules.URL_SKIP)


def lang(tag: str, paths: list[str]) -> str:
    has = " OR ".join(f"contains({part('url', 3)}, '{p}')" for p in paths)
    declared = r"""regexp_extract(html, '(?i)<html[^>]*\slang="([^"]*)"', 1)"""
    return f"CASE WHEN {has} OR starts_with({declared}, '{tag}') THEN '{tag}' ELSE 'en' END"


_TEXT = "html"
for _tag in [*rules.SKIPPED_TAGS, "title"]:
    _TEXT = rf"regexp_replace({_TEXT}, '(?is)<{_tag}(?:\s[^>]*)?>.*?</{_tag}>', ' ', 'g')"
_TEXT = rf"regexp_replace({_TEXT}, '(?s)<!--.*?-->', ' ', 'g')"
_TEXT = squeeze(f"regexp_replace({_TEXT}, '<[^>]*>', ' ', 'g')")
_BASE = f"{part('src', 1)} || '://' || {part('src', 2)}"
_FOLDER = f"regexp_replace({part('src', 3)}, '[^/]*$', '')"
LINKS = f"""links AS (SELECT page_id, src, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h
  WHEN starts_with(h, '//') THEN {part('src', 1)} || ':' || h WHEN starts_with(h, '/') THEN {_BASE} || h
  WHEN starts_with(h, '#') THEN {_BASE} || {part('src', 3)} || {part('src', 4)} || h
  WHEN starts_with(h, '?') THEN {_BASE} || {part('src', 3)} || h
  ELSE {_BASE} || CASE WHEN {_FOLDER} = '' THEN '/' ELSE {_FOLDER} END || h END AS dst
  FROM (SELECT page_id, url AS src, trim(unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1))) AS h FROM pages) WHERE h <> '')"""
ORACLES = {
    "page_lang": f"SELECT page_id, {lang('cy', ['/cy/', '/cymraeg/'])} AS cy_page, {lang('fr', ['/fr/'])} AS fr_page FROM pages",
    "url_normalise": f"SELECT page_id, {norm('url')} AS norm FROM pages",
    "url_frontier": f"""WITH {LINKS}
SELECT norm, count(*) AS n_links, bool_and(s) AS skipped, bool_or(a) AS allowed, norm IN (SELECT {norm('url')} FROM pages) AS visited
FROM (SELECT {norm('dst')} AS norm, {skip('dst')} AS s, {allowed('dst')} AS a FROM links) GROUP BY norm""",
    "crawl_report": f"""
SELECT status, count(*) AS n FROM (SELECT CASE WHEN {skip('url')} OR NOT {allowed('url')} THEN 'skipped' WHEN coalesce(html, '') = '' THEN 'failed'
  WHEN length({_TEXT}) < {rules.MIN_PAGE_CHARS} THEN 'skipped' ELSE 'ok' END AS status FROM pages) GROUP BY 1
UNION ALL SELECT 'urls_seen', count(DISTINCT {norm('url')}) FROM pages""",
    "crawl_levels": f"""WITH RECURSIVE {LINKS},
usable AS (SELECT DISTINCT {norm('src')} AS norm, {norm('dst')} AS nxt FROM links WHERE NOT {skip('dst')} AND {allowed('dst')}),
walk(norm, level) AS (SELECT DISTINCT {norm('url')}, 0 FROM pages
  UNION SELECT nxt, level + 1 FROM walk JOIN usable USING (norm) WHERE level < 40)
SELECT norm, min(level) AS level FROM walk GROUP BY norm""",
}
