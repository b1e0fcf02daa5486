"""Block scans and bounded similarities give the results of the plain forms, without a row per pair."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.functions.fuzzy import TokenSets, token_set_ratio
from tidemark.operators import retrieval as rt
from tidemark.operators import scan
from tidemark.operators.ordered import top_k


def _texts(n, seed, lead):
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice(["the", "of", *"abcdefghijk"]) for _ in range(r.randint(0, 9))), lead[i % len(lead)]) for i in range(n)]
    return [*rows, (n, None, lead[0]), (n + 1, "the the the", lead[0]), (n + 2, "the the the", lead[-1])]


@pytest.mark.parametrize("group", [None, "tag"])
def test_scan_equals_pairs_over_many_blocks(spark, monkeypatch, group):
    for name, value in {"QUERY_BLOCK": 16, "DOC_BLOCK": 16, "TILE": 64}.items():
        monkeypatch.setattr(scan, name, value)
    docs = spark.createDataFrame(_texts(70, 1, ["x", "y", "z"]), "doc_id long, text string, tag string")
    asked = spark.createDataFrame(_texts(50, 2, ["q"]), "item_id long, text string, tag string").drop("tag")
    tokens, name = tx.latin_tokens(F.col("text")), group or "doc_id"
    plain = rt.tfidf_scores(docs, asked, tokens, tokens, "doc_id", "item_id", ("tag",))
    best = rt.tfidf_best(docs, asked, tokens, tokens, "doc_id", "item_id", 2, ("tag",), group=group)

    def two(df):
        df = df.groupBy("item_id", name).agg(F.round(F.max("score"), 6).alias("score"))
        return {tuple(r) for r in top_k(df, ["item_id"], [F.desc("score"), F.col(name)], 2).collect()}

    assert two(best) == two(plain)
    bm = rt.ranked(rt.bm25_best(docs, asked, 3), 3)
    assert {tuple(r) for r in bm.collect()} == {tuple(r) for r in rt.ranked(rt.bm25_scores(docs, asked), 3).select(bm.columns).collect()}


def test_no_join_makes_a_row_per_pair(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in range(300)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, "same words") for i in range(200)], "item_id long, text string")
    tokens = tx.latin_tokens(F.col("text"))
    best = rt.tfidf_best(docs, asked, tokens, tokens, "doc_id", "item_id", 1)
    assert "Join" not in best._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.item_id, r.doc_id) for r in best.collect()} == {(i, 0) for i in range(200)}


def test_bound_is_never_below_the_ratio():
    r = random.Random(3)
    words = ["a", "ab", "ba", "abc", "é", "cab", "bb", "日本", "cc"]
    sets = [frozenset(r.choice(words) for _ in range(r.randint(0, 5))) for _ in range(60)]
    table = TokenSets(sets)
    for mine in [*sets, frozenset(), frozenset(["zz"])]:
        for bound, theirs in zip(table.bounds(mine), sets):
            assert bound >= token_set_ratio(mine, theirs)


def test_bounded_fuzzy_search_finds_the_same_best(spark):
    from tidemark.operators import understanding as un

    r = random.Random(5)
    words = ["fees", "nursing", "hall", "library", "open", "when", "course"]

    def text(n):
        return " ".join(r.choice(words) for _ in range(n))

    asked = spark.createDataFrame([(f"q{i}", text(i % 6), i % 3, i % 2) for i in range(60)], "turn_id string, text string, courses long, families long")
    known = spark.createDataFrame([(i, r.choice(["courses_nursing", "courses_computing", "fees_tuition", "library"]), text(1 + i % 5)) for i in range(40)],
                                  "seq long, tag string, pattern string")
    every = un.fuzzy_intents(asked, known).join(asked.drop("text"), "turn_id")
    boosted = F.round(F.col("score") * un.tn.history_boost(F.col("tag"), F.col("courses"), F.col("families")), 6)
    want = top_k(every.withColumn("score", boosted), ["turn_id"], [F.desc("score"), F.col("tag")], 1).where("score >= 45")
    assert {tuple(x) for x in un.classify_fuzzy(asked, known, 45.0).collect()} == {tuple(x) for x in want.select("turn_id", "tag", "score").collect()}
    plain = {(a.turn_id, k.tag): 0.0 for a in asked.collect() for k in known.collect()}
    for a in asked.collect():
        for k in known.collect():
            plain[a.turn_id, k.tag] = max(plain[a.turn_id, k.tag], token_set_ratio(frozenset(a.text.split()), frozenset(k.pattern.split())))
    assert {(x.turn_id, x.tag): x.score for x in un.fuzzy_intents(asked, known).collect()} == {k: v for k, v in plain.items() if v > 0}


def test_documents_are_not_copied_for_blocks_of_queries(spark):
    r = random.Random(7)
    docs = spark.createDataFrame([(i, " ".join(f"w{r.randint(0, 4000)}" for _ in range(300))) for i in range(600)], "doc_id long, text string")

    def shuffled(n):
        asked = spark.createDataFrame([(i, f"w{i % 4000} w{i % 7}") for i in range(n)], "item_id long, text string")
        store = spark.sparkContext._jsc.sc().statusStore()

        def written():
            return sum(e.totalShuffleWrite() for e in _all(store.executorList(False)))

        before = written()
        rt.bm25_best(docs, asked, 2).count()
        return written() - before

    def _all(seq):
        return [seq.apply(i) for i in range(seq.size())]

    few, many = shuffled(64), shuffled(6400)
    assert many < 4 * few, (few, many)


def test_best_matches_over_chunks_parts_and_long_ties(spark, monkeypatch):
    for name, value in {"QUERY_BLOCK": 70, "DOC_BLOCK": 40, "TILE": 100, "QUERY_TERMS": 300, "BLOCK_TOKENS": 200, "PARTS": 3}.items():
        monkeypatch.setattr(scan, name, value)
    docs = spark.createDataFrame(_texts(300, 8, ["x"]) + [(400 + i, "a b a b", "x") for i in range(50)], "doc_id long, text string, tag string")
    asked = spark.createDataFrame(_texts(200, 9, ["q"]), "item_id long, text string, tag string")
    tokens = tx.latin_tokens(F.col("text"))
    for k in (1, 4):
        want = rt.ranked(rt.tfidf_scores(docs, asked, tokens, tokens, "doc_id", "item_id"), k)
        got = rt.ranked(rt.tfidf_best(docs, asked, tokens, tokens, "doc_id", "item_id", k), k)
        assert {tuple(x) for x in got.select(want.columns).collect()} == {tuple(x) for x in want.collect()}


def test_empty_sides(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a"), (2, "zz"), (3, None)], "item_id long, text string")
    tokens = tx.latin_tokens(F.col("text"))
    assert rt.bm25_best(none, asked, 2).collect() == []
    assert rt.tfidf_best(docs, asked.limit(0), tokens, tokens, "doc_id", "item_id", 2).collect() == []
    assert [(r.item_id, r.doc_id) for r in rt.tfidf_best(docs, asked, tokens, tokens, "doc_id", "item_id", 2).collect()] == [(1, 1)]
