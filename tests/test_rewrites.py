"""Behaviour of the match-by-match rewrites, link rules, crawl depth and the CSV export."""

from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tidemark.operators import feedback, safety, web
from tidemark.session import scratch_path


def test_cards_are_masked_where_they_stand(spark):
    df = spark.createDataFrame([("4111111111111111. b 4111111111111111999999",), ("no 4111 1111 1111 1112",), (None,)], "t string")
    got = [r[0] for r in df.select(safety.mask_cards(F.col("t"))).collect()]
    assert got == ["[CARD-NUMBER]. b 4111111111111111999999", "no 4111 1111 1111 1112", None]


def test_placeholders_are_numbered_by_place(spark):
    df = spark.createDataFrame([("12345 then a@b.org, 1234567 and 12345 http://x.y/z c@d.org",)], "t string")
    r = safety.protect(df, "t").withColumn("back", safety.restore(F.col("masked"), F.col("kept"))).first()
    assert r["masked"] == "__PHONE3__ then __EMAIL0__, __PHONE4__ and __PHONE5__ __URL2__ __EMAIL1__"
    assert r["back"] == r["t"]


def _packed(text: str, limit: int) -> list[str]:
    out, held = [], ""
    for s in (x.strip() for x in __import__("re").findall(r"[^.!?…\n]+[.!?…]?", text)):
        if not s:
            continue
        if len(s) <= limit:
            if held and len(held) + 1 + len(s) > limit:
                out, held = [*out, held], s
            else:
                held = f"{held} {s}".strip()
            continue
        out, held = [*out, held] if held else out, ""
        while len(s) > limit:
            at = s.rfind(" ", 0, limit + 1)
            at = at if at >= 100 else limit
            out.append(s[:at].strip())
            s = s[at:].strip()
        held = s
    return [*out, held] if held else out


@pytest.mark.parametrize("text", ["", "One. Two! Three?\nFour", "x" * 500, "word " * 200 + ". Next one. " + "ab " * 60, ("Some words stand here. " * 40).strip()])
def test_packing_against_a_plain_loop(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(safety.pack_sentences(F.col("t"), 150)).first()[0]
    assert got == _packed(text, 150)


def test_links_and_dot_segments(spark):
    html = """<a href='x y.html'>1</a><!-- <a href="no">2</a> --><A class="k" href = "../q.html?a=../b#c">3</A><a href=./d/../e>4</a><a href="//h.org/z">5</a>"""
    base = "http://Site.org/a/b/c.html"
    row = spark.createDataFrame([(html, base)], "h string, b string").select(web.hrefs(F.col("h")).alias("l"), "b")
    got = [r[0] for r in row.select(F.explode("l").alias("l"), "b").select(web.resolve(F.col("b"), F.col("l"))).collect()]
    assert got == [urljoin(base, x) for x in ("x y.html", "../q.html?a=../b#c", "./d/../e", "//h.org/z")]
    page = web.extract_pages(spark.createDataFrame([(1, base, html)], "page_id long, url string, html string")).first()
    assert page["links"] == got


def test_crawl_follows_long_chains(spark):
    edges = spark.createDataFrame([(f"http://a.org/{i}", f"http://a.org/{i + 1}") for i in range(14)], "src string, dst string")
    got = {r.norm: r.level for r in web.crawl_levels(edges, spark.createDataFrame([("http://a.org/0",)], "url string"), ["a.org"]).collect()}
    assert got["http://a.org/14"] == 14


def test_csv_reads_back(spark):
    rows = spark.sql("SELECT 1 AS event_id, timestamp'2024-01-02' AS ts, 5 AS satisfaction, true AS helpful, CAST(NULL AS boolean) AS correct_language, 'said \"hi\", twice' AS comments")
    path = scratch_path(spark, "csv")
    feedback.write_csv(rows, path)
    back = spark.read.option("header", True).option("escape", '"').csv(path).first()
    assert back["comments"] == 'said "hi", twice' and back["helpful"] == "Yes"


def test_dense_tiles_agree_with_one_product(spark, monkeypatch):
    import numpy as np

    from tidemark.operators import retrieval

    rng = np.random.default_rng(4)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(300)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(9)], "item_id long, query array<double>")
    whole = retrieval.dense_top(vectors, queries, 7).toPandas()
    monkeypatch.setattr(retrieval, "TILE", 500)
    tiled = retrieval.dense_top(vectors, queries, 7).toPandas()
    order = ["item_id", "score", "vec_id"]
    assert whole.sort_values(order).to_numpy().tolist() == tiled.sort_values(order).to_numpy().tolist() and len(whole) == 63
