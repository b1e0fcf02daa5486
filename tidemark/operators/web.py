"""Web pages: text and link extraction, URL rules, crawl levels over a closed link graph."""

from __future__ import annotations

import re
from collections.abc import Iterator
from contextlib import suppress
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import regex as rx
from tidemark.functions import text as tx
from tidemark.functions.slices import slices
from tidemark.session import cut

PAGE_FIELDS = "page_id bigint, url string, title string, lang string, text string, links array<string>"


_RAW = re.compile(r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>")
_COMMENT = re.compile(r"(?s)<!--.*?(?:-->|$)")
_TITLE = re.compile(r"(?is)<title\b[^>]*>(.*?)</title\s*>")
_LANGUAGE = re.compile(r"(?i)<html\b[^>]*\slang\s*=\s*[\"']?([a-z-]+)")
_LINK = re.compile(r"(?i)<a\s[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_TAG = re.compile(r"<[/!?a-zA-Z][^>]*>")
_HIDDEN = "|".join(rules.SKIPPED_TAGS)
_INNERMOST = re.compile(rf"(?is)<({_HIDDEN})\b[^>]*>(?:(?!<(?:{_HIDDEN})\b).)*?</\1\s*>")


def _read_page(url: str, html: str) -> tuple[str, str, str, list[str]]:
    """(title, lang, text, links): what is never shown is cut out, the rest is split at its tags."""
    shown = _COMMENT.sub(" ", _RAW.sub(" ", html))
    links = []
    for target in (unescape("".join(x)).strip() for x in _LINK.findall(shown)):
        if target:
            with suppress(ValueError):
                links.append(urljoin(url, target))
    title, lang = _TITLE.search(shown), _LANGUAGE.search(shown)
    shown = _TITLE.sub(" ", shown)
    while (inner := _INNERMOST.sub(" ", shown)) != shown:
        shown = inner
    pieces = (re.sub(r"[ \t]+", " ", unescape(x)).strip() for x in _TAG.split(shown))
    return (unescape(title[1]).strip() if title else "", "cy" if lang and lang[1].lower().startswith("cy") else "en",
            " ".join(x for x in pieces if x), links)


_PAGES = pa.schema([("page_id", pa.int64()), *((c, pa.string()) for c in ("url", "title", "lang", "text")), ("links", pa.list_(pa.string()))])


def _read_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            out = []
            for page_id, url, html in zip(*(c.to_pylist() for c in part.columns)):
                title, lang, text, links = _read_page(url, html or "")
                out.append((page_id, url, title or url, lang, text, links))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _PAGES)], schema=_PAGES)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, lang, text, links) read a few pages at a time; Welsh paths override the language."""
    parsed = pages.select(F.col("page_id").cast("bigint"), "url", "html").mapInArrow(_read_pages, PAGE_FIELDS)
    return parsed.withColumn("lang", F.when(path_has(F.col("url"), ["/cy/", "/cymraeg/"]), "cy").otherwise(F.col("lang")))


def page_documents(extracted: DataFrame) -> DataFrame:
    """Passages of pages with enough text, very long texts cut for the store."""
    long_enough = F.char_length("text") >= rules.MIN_PAGE_CHARS
    return extracted.where(long_enough).select(
        "page_id", "url", "title", "lang", F.substring("text", 1, rules.PAGE_TEXT_CHARS).alias("text"))


def visible_text(html: Column) -> Column:
    """JVM-side approximation of the visible text (no nesting of a hidden tag in itself)."""
    out = html
    for tag in [*rules.SKIPPED_TAGS, "title"]:
        out = F.regexp_replace(out, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}>", " ")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", " ")
    return tx.squeeze(F.regexp_replace(out, r"<[^>]*>", " "))


# ---------------------------------------------------------------------- URLs
_URL = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]+)?"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _URL, i)


def host(url: Column) -> Column:
    return F.lower(_part(url, 2))


def normalise_url(url: Column) -> Column:
    """No fragment or path parameters, lower-case host, no trailing slashes, query kept."""
    path = F.regexp_replace(F.regexp_replace(_part(url, 3), r";[^/]*$", ""), "/+$", "")
    whole = F.concat(F.lower(_part(url, 1)), F.lit("://"), host(url), F.when(path == "", "/").otherwise(path), _part(url, 4))
    return F.when(url.rlike(_URL), whole).otherwise(url)


def skip_url(url: Column) -> Column:
    return rx.matches_any(url, rules.URL_SKIP)


def in_domains(url: Column, domains: list[str]) -> Column:
    """Host equal to, or a sub-domain of, an allowed domain."""
    names = "|".join(re.escape(d) for d in domains)
    return host(url).rlike(rf"(^|\.)({names})$")


def path_has(url: Column, parts: list[str]) -> Column:
    path = _part(url, 3)
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(path, F.lit(p))
    return out


def page_language(html: Column, url: Column, tag: str = "cy", paths: list[str] = ("/cy/", "/cymraeg/")) -> Column:
    """``tag`` when the document language starts with it or the path says so, else en."""
    declared = F.regexp_extract(html, r'(?i)<html[^>]*\slang="([^"]*)"', 1)
    return F.when(path_has(url, list(paths)) | F.startswith(declared, F.lit(tag)), tag).otherwise("en")


def hrefs(html: Column) -> Column:
    """Link targets in page order, quoted either way or bare; comments hold none."""
    shown = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|$)", " ")
    found = F.regexp_extract_all(shown, F.lit(r"""(?i)<a\s[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""), F.lit(1))
    return F.transform(found, lambda x: F.regexp_replace(x, r"""^["']|["']$""", ""))


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments taken out."""
    last = F.element_at(F.split(path, "/"), -1)

    def step(acc: Column, part: Column) -> Column:
        return F.when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(part == ".", acc).otherwise(F.concat(acc, F.array(part)))

    kept = F.aggregate(F.slice(F.split(path, "/"), 2, 1 << 30), F.array().cast("array<string>"), step)
    folder = F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), folder)).otherwise(path)


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link: absolute, scheme-, root-, query- or fragment-relative, else same folder; dot segments resolved."""
    root = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    path, query = _part(base, 3), _part(base, 4)
    folder = F.regexp_replace(path, "[^/]*$", "")
    own, rest = F.regexp_extract(href, r"^([^?#]*)(.*)$", 1), F.regexp_extract(href, r"^([^?#]*)(.*)$", 2)
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(_part(base, 1), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, _without_dots(own), rest))
        .when(F.startswith(href, F.lit("#")), F.concat(root, path, query, href))
        .when(F.startswith(href, F.lit("?")), F.concat(root, path, href))
        .otherwise(F.concat(root, _without_dots(F.concat(F.when(folder == "", "/").otherwise(folder), own)), rest))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, src, dst): resolved links of every page."""
    out = pages.select("page_id", F.col("url").alias("src"), F.explode(hrefs(F.col("html"))).alias("_href"))
    trimmed = F.trim("_href")
    return out.where(trimmed != "").select("page_id", "src", resolve(F.col("src"), trimmed).alias("dst"))


def frontier(links: DataFrame, visited: DataFrame, domains: list[str]) -> DataFrame:
    """(norm, n_links, skipped, allowed, visited) of every distinct link target."""
    seen = visited.select(normalise_url(F.col("url")).alias("norm")).distinct().withColumn("_seen", F.lit(True))
    targets = links.groupBy("dst").agg(F.count("*").alias("n"))
    flagged = targets.select(
        normalise_url(F.col("dst")).alias("norm"), "n", skip_url(F.col("dst")).alias("s"), in_domains(F.col("dst"), domains).alias("a"))
    per = flagged.groupBy("norm").agg(
        F.sum("n").alias("n_links"), F.min("s").alias("skipped"), F.max("a").alias("allowed"))
    return per.join(seen, "norm", "left").withColumn("visited", F.coalesce("_seen", F.lit(False))).drop("_seen")


def crawl_levels(edges: DataFrame, seeds: DataFrame, domains: list[str]) -> DataFrame:
    """(norm, level): breadth-first levels until one is empty; only allowed, unskipped, unseen links enter the next level.

    Each level is checkpointed on the shared folder, so the plan stays flat and a
    lost executor does not replay the whole crawl.
    """
    usable = edges.where(~skip_url(F.col("dst")) & in_domains(F.col("dst"), domains)).select(
        normalise_url(F.col("src")).alias("norm"), normalise_url(F.col("dst")).alias("next")).distinct()
    usable = cut(usable)
    level = seeds.select(normalise_url(F.col("url")).alias("norm")).distinct()
    visited = cut(level.withColumn("level", F.lit(0)))
    current = visited
    depth = 0
    while True:
        depth += 1
        fresh = current.select("norm").join(usable, "norm").select(F.col("next").alias("norm")).distinct().join(
            visited.select("norm"), "norm", "left_anti")
        current = cut(fresh.withColumn("level", F.lit(depth)))
        if current.isEmpty():
            break
        visited = visited.unionByName(current)
    return visited


def crawl_report(pages: DataFrame, domains: list[str]) -> DataFrame:
    """(status, n): ok, skipped (rule, domain or short text) and failed (no page) counts."""
    url = F.col("url")
    status = (
        F.when(skip_url(url) | ~in_domains(url, domains), "skipped")
        .when(F.coalesce("html", F.lit("")) == "", "failed")
        .when(F.char_length(visible_text(F.col("html"))) < rules.MIN_PAGE_CHARS, "skipped")
        .otherwise("ok")
    )
    counts = pages.groupBy(status.alias("status")).agg(F.count("*").alias("n"))
    seen = pages.select(normalise_url(url).alias("u")).agg(F.count_distinct("u").alias("n"))
    return counts.unionByName(seen.select(F.lit("urls_seen").alias("status"), "n"))
