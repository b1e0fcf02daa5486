"""Stems in the tf-idf indexes and Naive Bayes over intents."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.stem import stem, stem_table
from tidemark.operators import bayes
from tidemark.operators import retrieval as rt
from tidemark.operators import store as st
from tidemark.operators import understanding as un
from tidemark.oracles.stem import stems

WORDS = ("applying apply applied applications caresses ponies relational conditional flying hopping falling agreed plastered motoring conflated "
         "sized syzygy toys happy adjustment controllers roll universities hopefulness electricity probate rate ceasing ŵyn cŵn").split()


def test_table_and_sql_agree(spark):
    terms = spark.createDataFrame([(w,) for w in WORDS * 2], "term string")
    got = {r.term: r.stem for r in stem_table(terms).collect()}
    con = duckdb.connect()
    con.register("voc", pd.DataFrame({"term": WORDS}))
    sql = dict(con.execute("WITH " + stems("SELECT term FROM voc") + " SELECT term, stem FROM stems").fetchall())
    assert got == {w: stem(w) for w in WORDS if stem(w) != w} == {w: s for w, s in sql.items() if s != w}
    assert got["applying"] == got["applied"] == stem("apply") and "ŵyn" not in got


def test_applying_meets_apply_but_not_in_welsh(spark):
    docs = spark.createDataFrame([(1, "how to apply", "en"), (2, "how to apply", "cy"), (3, "other things", "en")], "doc_id bigint, text string, lang string")
    asked = spark.createDataFrame([(1, "applying", "en"), (2, "applying", "cy")], "item_id bigint, text string, lang string")
    terms = tx.preprocess_by(F.col("text"), F.col("lang"))
    store = st.build_sparse(docs, terms, bm25=False, stems=True)
    lists, _ = st.sparse_lists(store, rt.query_terms(asked, "item_id", terms, stems=True), 5)
    assert [(r.item_id, r.doc_id) for r in lists.collect()] == [(1, 1)]
    plain = rt.tfidf_scores(docs, asked, terms, terms, "doc_id", "item_id", stems=True)
    assert [(r.item_id, r.doc_id) for r in plain.collect()] == [(1, 1)]
    patterns = spark.createDataFrame([(0, "admissions", "how do i apply"), (1, "fees", "what are the fees")], "seq bigint, tag string, pattern string")
    turns = spark.createDataFrame([("a:0", "I was applying yesterday")], "turn_id string, query string")
    assert [r.tag for r in un.top_intents(turns, patterns).collect()] == ["admissions"]


def _brute(patterns, text):
    def terms(t):
        return {stem(w) for w in t.lower().split() if len(w) > 1}

    docs, n = defaultdict(list), Counter()
    for tag, p in patterns:
        if terms(p):
            docs[tag].append(terms(p))
    for tag, sets in docs.items():
        for s in sets:
            n.update((tag, t) for t in s)
    known = {t for _, t in n}
    c = {tag: len(s) + 1 for tag, s in docs.items()}
    total = 1 + sum(len(s) for s in docs.values())
    score = {tag: round(math.log(c[tag] / total) + sum(math.log((n[tag, t] + 1) / c[tag]) for t in terms(text) & known), 6) for tag in docs}
    return min(score.items(), key=lambda x: (-x[1], x[0]))


def test_bayes_against_brute_force(spark):
    patterns = [("fees", "tuition costs"), ("fees", "paying tuition"), ("library", "library opening"), ("library", "borrowing books library"),
                ("library", "printing"), ("wifi", "wifi password"), ("wifi", "paying printing")]
    texts = ["paid tuition", "paying books", "nothing known", "", "library wifi printing books opening", "printing", "wifi wifi paying printing tuition"]
    model = bayes.train(spark.createDataFrame(patterns + [("empty", "a")], "tag string, pattern string"))
    got = bayes.classify(model, spark.createDataFrame(list(enumerate(texts)), "q int, text string"), "q")
    assert {r.q: (r.tag, r.score) for r in got.collect()} == {i: _brute(patterns, t) for i, t in enumerate(texts)}


def test_bayes_without_patterns(spark):
    model = bayes.train(spark.createDataFrame([], "tag string, pattern string"))
    assert bayes.classify(model, spark.createDataFrame([(1, "x y")], "q int, text string"), "q").count() == 0
