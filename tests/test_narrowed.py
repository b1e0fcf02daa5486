"""Stores read and shipped no more than a query table needs: impacts, query vectors, texts of hits, Arrow batches."""

from __future__ import annotations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark import session
from tidemark.functions import stem as sm
from tidemark.functions import text as tx
from tidemark.operators import retrieval as rt
from tidemark.operators import store as st
from tidemark.plans import search as ps


@pytest.fixture
def sides(spark):
    rows = [(i, " ".join(f"w{(i * j) % 17}" for j in range(1, 4 + i % 9)), ["cy", "en"][i % 2]) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    asked = spark.createDataFrame([(1, "w1 w2 w2"), (2, "w3 w16 w5"), (3, "none")], "item_id bigint, text string")
    tokens = tx.index_tokens(F.col("text"))
    return docs, asked, tokens, rt.query_terms(asked, "item_id", tokens)


def _rows(df):
    return sorted((r.item_id, r.doc_id, round(r.score, 4), r.rnk) for r in df.collect())


@pytest.mark.parametrize("bm25", [True, False])
@pytest.mark.parametrize("most", [0, 1_000_000])
def test_shipped_and_travelling_vectors_give_equal_lists(spark, sides, monkeypatch, bm25, most):
    monkeypatch.setattr(st, "BLOCK_DOCS", 10)
    monkeypatch.setattr(st, "MAX_TERMS", most)
    docs, asked, tokens, terms = sides
    store = st.build_sparse(docs, tokens, bm25=bm25)
    few = st.narrowed(store, terms)
    words = {r.term for r in terms.collect()}
    assert {r.term for r in few.tops.select("term").distinct().collect()} == words - {"none"}
    frames = []
    monkeypatch.setattr(st, "cut", lambda df: frames.append(df) or session.cut(df))
    got = st.sparse_lists(few, terms, 5)[0]
    scores = rt.bm25_scores(docs, asked) if bm25 else rt.tfidf_scores(docs, asked, tokens, tokens, "doc_id", "item_id")
    assert _rows(got) == _rows(rt.ranked(scores, 5))
    # a block is asked by the ids of queries, not by copies of their vectors
    kinds = {dict(f.dtypes)["asked"] for f in frames if "asked" in f.columns}
    assert kinds == ({"array<bigint>"} if most else {"array<struct<query:bigint,v:array<struct<term:string,w:double>>>>"})


def test_impacts_are_packed_with_their_block(spark, sides):
    group = pa.table({"lang": ["en", "en"], "block": [0, 0], "doc": [7, 9], "tokens": [["b", "a", "b"], ["b"]]})
    row = st._packer(None, False)(group).to_pylist()[0]
    assert (row["terms"], row["tops"], row["dfs"]) == (["a", "b"], [1.0, 2.0], [1, 2])
    docs, _, tokens, _ = sides
    store = st.build_sparse(docs, tokens)
    assert {f.rsplit("/", 3)[1].split("-")[0] for f in store.tops.inputFiles()} == {"postings"}


def test_only_words_with_a_taken_ending_become_objects(monkeypatch):
    words = ["sky", "ties", "running", "agreed", "all", "caffés", "ab\ns", "as", "", "bo", None, "zumok", "relational", "7s", "hopeful"]
    want, seen = [w if w is None else sm.stem(w) for w in words], []
    whole = sm.stem
    monkeypatch.setattr(sm, "stem", lambda w: seen.append(w) or whole(w))
    assert sm.stemmed_words(pa.array(words)).to_pylist() == want
    assert not {"caffés", "zumok", "", "as", "bo"} & set(seen) and "relational" in seen


def test_blocks_reach_python_in_small_batches(spark, sides, monkeypatch):
    docs, _, tokens, terms = sides
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(key), []
    monkeypatch.setattr(st, "cut", lambda df: seen.append(("asked" in df.columns, spark.conf.get(key))) or session.cut(df))
    monkeypatch.setattr(st, "BATCH", "1k")
    many = st.build_sparse(docs, tokens)
    seen.clear()
    st.sparse_lists(many, terms, 5)
    assert {size for asked, size in seen if asked} == {"1k"} and spark.conf.get(key) == before

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    long = spark.range(64, numPartitions=1).select(F.repeat(F.lit("x"), 1000).alias("t"))
    with session.arrow_batches(spark, "4k"):
        assert max(r.n for r in long.mapInArrow(count, "n long").collect()) < 16


def test_nearest_centres_a_few_vectors_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(st, "BLOCK_VECTORS", 4)
    rows = [(i, [float(i % 3 == 0), float(i % 3 == 1), float(i % 3 == 2)], "en") for i in range(30)]
    vec = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, lang string").coalesce(1)
    got = st.dense_lists(st.build_dense(vec), spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "item_id bigint, query array<double>"), 3)[0]
    assert [(r.vec_id, r.score) for r in got.orderBy("rnk").collect()] == [(0, 1.0), (3, 1.0), (6, 1.0)]


def _candidates(spark):
    rows = [(1, 10, 0.5, 1, "apple pear", "apple apple plum"), (1, 11, 0.4, 2, "apple pear", "pear cherry"), (2, 10, 0.5, 1, "plum", "apple apple plum")]
    return spark.createDataFrame(rows, "item_id bigint, doc_id bigint, score double, rnk int, query_text string, text string")


def test_rerank_names_the_tokens_of_a_text_once(spark):
    given = _candidates(spark)
    made = given.withColumn("tokens", rt.rerank_tokens(F.col("text"))).drop("text")
    plain = rt.rerank(given, 2)
    assert sorted(map(str, plain.collect())) == sorted(map(str, rt.rerank(made, 2, tokens=F.col("tokens")).collect()))
    assert plain._jdf.queryExecution().optimizedPlan().toString().count("split(lower(text") == 1


def test_keys_are_made_of_hits_only(spark, tmp_path):
    docs = [(i, f"text {i % 4}", ["en", "fr", "de"][i % 3], "s", 6) for i in range(12)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    hits = [spark.createDataFrame([(i,) for i in ids], "x bigint") for ids in ((1, 5, 99), (5, 2))]
    keys = {r.doc_id: r.key for r in ps._keys(spark, str(tmp_path), *hits).collect()}
    assert set(keys) == {1, 2, 5} and keys[1] == keys[5] != keys[2]
