"""Registered queries: page extraction and crawl operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import web
from tidemark.plans import inputs as src

DOMAINS = ["example.com", "example.org"]


def _pages(spark, d):
    return src.spread(src.table(spark, d, "pages"), "page_id")


def page_extract(spark, d):
    out = web.extract_pages(_pages(spark, d))
    return out.select("page_id", "title", "lang", F.char_length("text").alias("n_chars"), F.md5("text").alias("text_md5"),
                      F.size("links").alias("n_links"))


def page_lang(spark, d):
    html, url = F.col("html"), F.col("url")
    return _pages(spark, d).select("page_id", web.page_language(html, url).alias("cy_page"),
                                   web.page_language(html, url, "fr", ["/fr/"]).alias("fr_page"))


def url_normalise(spark, d):
    return _pages(spark, d).select("page_id", web.normalise_url(F.col("url")).alias("norm"))


def url_frontier(spark, d):
    pages = _pages(spark, d)
    return web.frontier(web.page_links(pages), pages, DOMAINS)


def crawl_report(spark, d):
    return web.crawl_report(_pages(spark, d), DOMAINS)


def crawl_levels(spark, d):
    pages = _pages(spark, d)
    return web.crawl_levels(web.page_links(pages), pages, DOMAINS)


QUERIES = {f.__name__: f for f in (page_extract, page_lang, url_normalise, url_frontier, crawl_report, crawl_levels)}
