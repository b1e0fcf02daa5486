"""Two-phase stores against scoring of all documents: equal lists, fewer blocks read, partitions pruned."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import retrieval as rt
from tidemark.operators import store as st


@pytest.fixture
def corpus(spark):
    rng = random.Random(4)
    common, rows = [f"c{i}" for i in range(30)], []
    for i in range(400):
        rare = [f"r{rng.randrange(3000)}" for _ in range(rng.randrange(12))]
        rows.append((i, " ".join(rng.choices(common, k=rng.randrange(1, 60)) + rare), rng.choice(["cy", "en", None, "7"])))
    rows += [(1000, "", "en"), (1001, None, "en"), (1002, rows[5][1], "cy")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(5)
    asked = [(i, rows[i * 7][1]) for i in range(30)] + [(90, "none of these"), (91, ""), (92, "c1 c1 c2")]
    return docs, spark.createDataFrame(asked, "item_id bigint, text string")


def _rows(df):
    return sorted((r.item_id, r.doc_id, round(r.score, 4), r.rnk) for r in df.collect())


@pytest.mark.parametrize("lang", [None, "cy"])
def test_sparse_lists_equal_full_scoring(spark, corpus, monkeypatch, lang):
    monkeypatch.setattr(st, "BLOCK_DOCS", 20)
    docs, asked = corpus
    tokens = tx.index_tokens(F.col("text"))
    store = st.build_sparse(docs, tokens)
    keep = None if lang is None else F.col("lang").eqNullSafe(lang)
    got, read = st.sparse_lists(store, rt.query_terms(asked, "item_id", tokens), 5, keep=keep)
    want = rt.ranked(rt.bm25_scores(docs, asked, carry=("lang",), keep=keep), 5)
    assert _rows(got) == _rows(want)
    blocks = store.blocks.where(keep if keep is not None else F.lit(True)).count()
    best, few = st.sparse_lists(store, rt.query_terms(asked, "item_id", tokens), 1, keep=keep)
    assert _rows(best) == [r for r in _rows(want) if r[3] == 1]
    assert few.count() < 0.7 * blocks * asked.count() and few.count() < read.count()
    if lang:
        plan = store.blocks.where(keep)._jdf.queryExecution().toString()
        assert "PartitionFilters: [(lang" in plan


def test_tfidf_weights(spark, corpus):
    docs, asked = corpus
    tokens = tx.preprocess(F.col("text"))
    store = st.build_sparse(docs, tokens, bm25=False)
    got, _ = st.sparse_lists(store, rt.query_terms(asked, "item_id", tokens), 7, floor=0.5)
    want = rt.ranked(rt.tfidf_scores(docs, asked, tokens, tokens, "doc_id", "item_id"), 7, floor=0.5)
    assert _rows(got) == _rows(want)


def test_empty_tables(spark, corpus):
    docs, asked = corpus
    tokens = tx.index_tokens(F.col("text"))
    none = st.build_sparse(docs.limit(0), tokens)
    assert st.sparse_lists(none, rt.query_terms(asked, "item_id", tokens), 5)[0].count() == 0
    some = st.build_sparse(docs, tokens)
    assert st.sparse_lists(some, rt.query_terms(asked.limit(0), "item_id", tokens), 5)[0].count() == 0
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, lang string")
    q = spark.createDataFrame([(1, [1.0, 2.0])], "item_id bigint, query array<double>")
    assert st.dense_lists(st.build_dense(empty), q, 3)[0].count() == 0


@pytest.mark.parametrize("clustered", [True, False])
def test_dense_lists_in_one_pass(spark, monkeypatch, clustered):
    monkeypatch.setattr(st, "BLOCK_VECTORS", 25)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8))
    if clustered:
        x = x * 0.05 + rng.normal(size=(20, 8))[rng.integers(0, 20, 600)]
    x[3] = 0
    langs = [["cy", "en", None][i % 3] for i in range(600)]
    vec = spark.createDataFrame([(i, v.tolist(), t) for i, (v, t) in enumerate(zip(x, langs, strict=True))] + [(900, None, "en"), (901, [], "cy")],
                                "vec_id bigint, embedding array<double>, lang string")
    asked = [(i, x[i * 9].tolist(), ["cy", "en", None][i % 3]) for i in range(30)] + [(50, [0.0] * 8, "cy"), (51, None, "cy")]
    q = spark.createDataFrame(asked, "item_id bigint, query array<double>, query_lang string")
    keep = {"mine": F.col("query_lang").isNull() | F.col("lang").eqNullSafe(F.col("query_lang")), "general": F.col("query_lang").isNotNull()}
    got, read = st.dense_lists(st.build_dense(vec), q, F.when(F.col("query_lang") == "cy", 6).otherwise(4), keep, 6)
    lists = {}
    for r in got.collect():
        lists.setdefault((r.item_id, r.list), []).append((r.rnk, r.vec_id, r.score))
    u = np.divide(x, np.linalg.norm(x, axis=1, keepdims=True), out=np.zeros_like(x), where=np.linalg.norm(x, axis=1, keepdims=True) > 0)
    for i, v, t in asked:
        if v is None:
            assert (i, "mine") not in lists
            continue
        v = np.array(v) / (np.linalg.norm(v) or 1)
        for name in ("mine", "general"):
            able = [j for j in range(600) if (t is None or langs[j] == t) or name == "general"] if name == "mine" or t else []
            want = sorted(((-round(float(u[j] @ v), 6) + 0.0, j) for j in able))[: 6 if t == "cy" else 4]
            mine = sorted(lists.get((i, name), []))
            assert [r for r, _, _ in mine] == list(range(1, len(want) + 1))
            assert [round(s, 5) for _, _, s in mine] == [round(-s, 5) for s, _ in want]
    if clustered:
        every = read.select("lang", "block").distinct().count() * read.select("item_id", "list").distinct().count()
        assert read.count() < 0.6 * every


def test_a_text_is_tokenised_once_for_a_store(spark, monkeypatch):
    """A filter on the tokens is not pushed below the step that makes them."""
    plans = []
    monkeypatch.setattr(st, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    docs = spark.createDataFrame([(1, "one two", "en"), (2, "", "en"), (3, None, "cy")], "doc_id long, text string, lang string")
    built = st.build_sparse(docs, F.split(F.regexp_replace("text", "once", ""), " "), bm25=False)
    assert plans[0].count("once") == 1 and built.n == 3
    assert sorted(built.weights.toPandas()["term"]) == ["", "one", "two"]


def test_packed_lists_hold_every_posting():
    import pyarrow as pa

    group = pa.table({"lang": ["en", "en"], "block": [0, 0], "doc": [7, 9], "tokens": [["b", "a", "b"], ["b"]]})
    row = st._pack(group).to_pylist()[0]
    assert row == {"lang": "en", "block": 0, "docs": [7, 9], "lengths": [3, 1], "terms": ["a", "b"], "starts": [0, 1, 3], "places": [0, 0, 1], "tfs": [1, 2, 1]}
