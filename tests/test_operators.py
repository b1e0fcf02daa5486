"""Histories in blocks, block pairing, retrieval, chunks, lexicon, web, sources."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark import rules
from tidemark.functions import stem
from tidemark.functions.chunk import split_text
from tidemark.functions.fuzzy import common_subsequence, token_set_ratio
from tidemark.operators import blocks, corpus, knowledge, lexicon, ordered, retrieval, web
from tidemark.operators import turns as tn
from tidemark.sources import records

TURN = "conv_id bigint, turn bigint, role string, text string"
SAYINGS = ["I'm stressed", "ok", "computing in Swansea", "the fee is high", "library please", "im Rhian", "what about it?", "thanks"]


def _turns(spark, n=120):
    rng = random.Random(7)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(SAYINGS)) for c in range(3) for t in range(n)]
    return spark.createDataFrame(rows, TURN)


def test_blocked_histories_equal_plain(spark, monkeypatch):
    df = _turns(spark)
    jobs = {
        "emotions": tn.emotions, "state": tn.student_state, "topics": lambda d, b: tn.recent_topics(d, blocked=b),
        "history": tn.clean_history, "same": tn.same_language_history, "running": tn.running_language,
        "vents": tn.casual_vents, "rewrite": tn.rewrite_follow_ups, "anchors": tn.pronoun_anchors,
    }
    plain = {k: sorted(map(str, f(df, False).collect())) for k, f in jobs.items()}
    for fn in (ordered.running, ordered.with_previous):
        fn.__defaults__ = tuple(7 if v == ordered.BLOCK else v for v in fn.__defaults__)
    try:
        for k, f in jobs.items():
            assert sorted(map(str, f(df, True).collect())) == plain[k], k
    finally:
        for fn in (ordered.running, ordered.with_previous):
            fn.__defaults__ = tuple(ordered.BLOCK if v == 7 else v for v in fn.__defaults__)


def test_row_numbers_are_total(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = ordered.row_numbers(df, [F.col("v")], "n").collect()
    assert all(r.n == r.v + 1 for r in got) and len(got) == 1000


def test_dense_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    v, q = rng.normal(size=(60, 8)).astype("float32"), rng.normal(size=(9, 8)).astype("float32")
    vec = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>")
    ask = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "item_id bigint, query array<float>")
    sims = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)).astype(float) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(float).T, 4)
    want = {(i, r + 1): round(float(np.sort(sims[i])[::-1][r]), 4) for i in range(9) for r in range(5) if np.sort(sims[i])[::-1][r] > 0}
    small = {(r.item_id, r.rnk): round(r.score, 4) for r in retrieval.dense_top(vec, ask, 5).collect()}
    defaults = blocks.pair_blocks.__defaults__
    blocks.pair_blocks.__defaults__ = (4, 16, False)
    try:
        split = {(r.item_id, r.rnk): round(r.score, 4) for r in retrieval.dense_top(vec, ask, 5).collect()}
    finally:
        blocks.pair_blocks.__defaults__ = defaults
    assert small == split
    assert all(abs(small[k] - want[k]) < 2e-4 for k in want) and set(small) == set(want)


def test_fusion_example(spark):
    dense = spark.createDataFrame([(1, "A", 1), (1, "B", 2), (1, "C", 3)], "item_id int, key string, rnk int")
    sparse = spark.createDataFrame([(1, "B", 1), (1, "D", 2), (1, "A", 3)], "item_id int, key string, rnk int")
    got = {r.key: (r.rnk, r.score) for r in retrieval.fuse({"dense": dense, "sparse": sparse}, 4).collect()}
    assert got["B"] == (1, round(1 / 62 + 1 / 61, 6)) and got["A"] == (2, round(1 / 61 + 1 / 63, 6))
    assert got["D"][1] == round(1 / 62, 6) and got["C"][1] == round(1 / 63, 6)


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "fee fee campus"), (2, "campus library"), (3, "exam hall here"), (4, "")], "doc_id bigint, text string")
    q = spark.createDataFrame([(9, "fee campus")], "item_id bigint, text string")
    got = {r.doc_id: r.score for r in retrieval.bm25_scores(docs, q).collect()}
    n, avg = 3, 8 / 3
    df = {"fee": 1, "campus": 2, "library": 1, "exam": 1, "hall": 1, "here": 1}
    raw = {t: np.log(n - d + 0.5) - np.log(d + 0.5) for t, d in df.items()}
    mean = np.mean(list(raw.values()))
    idf = {t: v if v >= 0 else rules.BM25_EPSILON * mean for t, v in raw.items()}

    def part(t, tf, dl):
        return idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg))

    assert abs(got[1] - part("fee", 2, 3) - part("campus", 1, 3)) < 1e-9
    assert abs(got[2] - part("campus", 1, 2)) < 1e-9 and set(got) == {1, 2}


def test_chunks_cover_and_fit():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))) + rng.choice(["", ".", "!", ",", "\n\n"])
                    for _ in range(900))
    parts = split_text(text)
    assert all(0 < len(p) <= rules.CHUNK_SIZE for p in parts)
    assert set("".join(text.split())) == set("".join("".join(parts).split()))
    words = text.split()
    joined = " ".join(parts)
    assert all(w.strip(".!,") in joined for w in words)
    assert split_text("x" * 1200) and max(map(len, split_text("x" * 1200))) <= rules.CHUNK_SIZE
    assert split_text("short text") == ["short text"]


def test_stems():
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor",
            "hopping": "hop", "relational": "relat", "conditional": "condit", "happy": "happi", "generalization": "gener",
            "probate": "probat", "controlling": "control", "hopefulness": "hope", "sky": "sky"}
    assert {w: stem.stem(w) for w in want} == want


def test_fuzzy():
    assert common_subsequence("abcbdab", "bdcaba") == 4
    a, b = frozenset("apply for a course".split()), frozenset("course apply".split())
    assert token_set_ratio(a, b) == 100.0
    assert token_set_ratio(frozenset(["abc"]), frozenset(["xyz"])) == 0.0
    # shared "new"; "a york" against "jersey" has one common character
    assert token_set_ratio(frozenset("a new york".split()), frozenset("new jersey".split())) == 50.0


def _pairs(spark):
    rows = [("ffioedd dysgu", "tuition fees", "x"), ("ffioedd", "fees", "x"), ("llyfrgell", "library", "x"), ("y llyfrgell fawr", "main library", "x")]
    return spark.createDataFrame(rows, "cy string, en string, origin string")


def test_query_glosses(spark):
    q = spark.createDataFrame([(1, "Beth yw ffioedd dysgu y llyfrgell fawr, ffioedd?", "cy"), (2, "ffioedd", "en")], "item_id int, text string, lang string")
    got = {r.item_id: r.augmented for r in lexicon.augment(q, "item_id", "text", F.col("lang"), _pairs(spark)).collect()}
    assert got[1].endswith("  [en: fees library]") and got[2] == "ffioedd"
    ngram = {r.item_id: r.augmented for r in lexicon.ngram_augment(q, "item_id", "text", _pairs(spark)).collect()}
    assert ngram[1].endswith(" tuition fees library fees"), ngram[1]
    gloss = {r.item_id: r.gloss for r in lexicon.gloss_text(q, "item_id", "text", _pairs(spark)).collect()}
    assert gloss[1] == "Beth yw fees dysgu y library fawr, fees?"


def test_lexicon_rules(spark):
    rec = spark.createDataFrame([(1, "s", "Cwrs", "course"), (2, "s", "cwrs", "later"), (3, "s", " ", "blank"), (4, "s", "12", "12 3")],
                                "seq int, subject string, cy string, en string")
    new = spark.createDataFrame([(5, "s", "cwrs", "other"), (6, "s", "tŷ", "house"), (7, "s", "tŷ", "home"), (8, "no", "ci", "dog"),
                                 (9, "s", "deddf", "the very long act of parliament")], "seq int, subject string, cy string, en string")
    got = {r.cy: (r.en, r.origin) for r in lexicon.merge(rec, new, ["s"]).collect()}
    assert got["cwrs"] == ("course", "existing") and got["tŷ"] == ("home", "new") and "ci" not in got and "deddf" not in got


def test_patterns_keep_override(spark):
    rows = [(1, "a", "PGCE"), (2, "b", "pgce "), (3, "b", "x"), (4, "b", "x"), (5, "c", "y"), (6, "d", "y")]
    df = spark.createDataFrame(rows, "seq int, tag string, pattern string")
    got = {r.seq: r.removed for r in knowledge.dedupe_patterns(df, [("pgce", "b"), ("y", "zzz")]).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


def test_chat_layouts(spark):
    schema = records.CHAT
    rows = [{"messages": [{"role": "assistant", "content": "first"}, {"role": "user", "content": " q "}]},
            {"conversations": [{"from": "human", "value": "hq"}, {"from": "gpt", "value": "ha"}]},
            {"prompt": "", "question": "fq", "answer": "fa"}, {"prompt": "only"}]
    df = spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows], 1))
    pair = corpus.pair_from_record(F.col("messages"), F.col("conversations"),
                                   [(F.col("prompt"), F.col("response")), (F.col("question"), F.col("answer"))])
    got = [r[0] and tuple(r[0]) for r in df.select(pair).collect()]
    assert got == [("q", "first"), ("hq", "ha"), ("fq", "fa"), None]


def test_record_readers(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"passages": [{"text": "a", "title": "t"}, {"content": " b "}, {"text": ""}]}))
    raw = records.read_passages(spark, str(tmp_path / "p.json"))
    got = corpus.passage_records(raw, ["text", "content"], ["title", "heading"], "pos").collect()
    assert [(r.title, r.text) for r in got] == [("t", "a"), ("corpus_1", "b")]
    (tmp_path / "m.json").write_text(json.dumps({"__comment": "x", "cwrs": "course"}))
    (tmp_path / "l.json").write_text(json.dumps([{"welsh": "tŷ", "english": "house"}]))
    assert [tuple(r) for r in records.read_term_map(spark, str(tmp_path / "m.json")).collect()] == [("cwrs", "course")]
    assert [tuple(r) for r in records.read_term_map(spark, str(tmp_path / "l.json")).collect()] == [("tŷ", "house")]
    (tmp_path / "v.json").write_text(json.dumps({"ids": ["a", "b", "c"], "langs": ["cy"], "hashes": ["1", "2", "3"], "vectors": [[1.0], [], [2.0]]}))
    assert [(r.id, r.lang) for r in records.read_vector_sidecar(spark, str(tmp_path / "v.json")).collect()] == [("a", "cy"), ("c", "en")]


LINKS = [("https://a.org/", "https://a.org/b/"), ("https://a.org/b", "https://a.org/c#x"), ("https://a.org/b", "https://sub.a.org/d"),
         ("https://sub.a.org/d", "https://a.org"), ("https://a.org/b", "https://other.net/"), ("https://a.org/b", "https://a.org/f.pdf"),
         ("https://sub.a.org/d", "https://a.org/e/")]


def test_crawl_levels(spark):
    edges = spark.createDataFrame(LINKS, "src string, dst string")
    seeds = spark.createDataFrame([("https://a.org",)], "url string")
    got = {r.norm: r.level for r in web.crawl_levels(edges, seeds, ["a.org"]).collect()}
    assert got == {"https://a.org/": 0, "https://a.org/b": 1, "https://sub.a.org/d": 2, "https://a.org/e": 3}


def test_page_reader(spark):
    html = ('<html lang="cy-GB"><head><title> T </title><style>x</style></head><body><nav>menu</nav><p>Hello  <b>there</b></p>'
            '<a href="/x">go</a><script>bad()</script></body></html>')
    df = spark.createDataFrame([(1, "https://a.org/p/q", html)], "page_id bigint, url string, html string")
    row = web.extract_pages(df).first()
    assert (row.title, row.lang, row.text, row.links) == ("T", "cy", "Hello there go", ["https://a.org/x"])
    assert df.select(web.visible_text(F.col("html"))).first()[0] == "Hello there go"


def test_append_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "idx")
    docs = spark.createDataFrame([("a", "x", "en"), ("b", "y", "cy"), ("a", "x", "en")], "title string, text string, lang string")
    for _ in range(2):
        corpus.append_passages(spark, docs, path)
    assert spark.read.parquet(path).count() == 2
    assert corpus.is_built(spark, path) and not corpus.is_built(spark, str(tmp_path / "none"))


def test_validation_split(spark):
    rows = [(1, 0, "system", "x"), (1, 1, "user", ""), (1, 2, "user", "hi"), (1, 3, "user", "y" * 4001)]
    good, bad = tn.split_valid(spark.createDataFrame(rows, TURN))
    assert [r.turn for r in good.collect()] == [2] and bad.count() == 3


def test_fact_gate_and_off_topic(spark):
    from tidemark.operators import understanding as un
    df = spark.createDataFrame([(1.0, 0.9), (1.0, 0.5), (0.1, 0.0)], "best double, second double")
    assert [r[0] for r in df.select(un.fact_passes(0.28, 1.15)).collect()] == [False, True, False]
    lit = F.lit
    flag = un.off_topic(lit(0.1), lit(False), lit(0.0), lit(0.1), lit(False), lit(False))
    assert spark.range(1).select(flag).first()[0] is True


def test_daily_stream_in_another_zone(spark, sf):
    from tidemark.streaming.feedback import run_daily
    utc = sorted(tuple(r) for r in run_daily(spark, f"{sf}/events*.parquet").collect())
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        other = sorted(tuple(r) for r in run_daily(spark, f"{sf}/events*.parquet").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert utc == other and len(utc) == 30


def test_sparse_stats_reused(spark):
    from tidemark.functions import text as tx
    docs = spark.createDataFrame([(1, "fee fee campus"), (2, "campus library"), (3, "")], "doc_id bigint, text string")
    q = spark.createDataFrame([(9, "fee library")], "item_id bigint, text string")
    stats = retrieval.build_stats(docs, tx.index_tokens(F.col("text")))
    assert (stats.n, stats.avgdl) == (2, 2.5)
    fresh = {tuple(r) for r in retrieval.bm25_scores(docs, q).collect()}
    assert fresh == {tuple(r) for r in retrieval.bm25_scores(docs, q, stats=stats).collect()}


def test_extractive_answer(spark):
    from tidemark.operators import answers
    hits = spark.createDataFrame([
        (1, 1, 0.5, "how much are the fees", "The weather is nice in this town today. Tuition fees are £9,000 per year for everyone!"),
        (1, 2, 0.4, "how much are the fees", "Tuition fees are £9,000 per year for everyone! The fees office opens early each day.")],
        "item_id int, rnk int, score double, query_text string, text string")
    row = answers.compose(hits).first()
    assert row.answer.startswith("Tuition fees are £9,000 per year for everyone!") and row.answer.count("£9,000") == 1
    assert row.n_sentences == 3


def test_pick_response_is_stable(spark):
    resp = spark.createDataFrame([(1, "a", "en", "x"), (2, "a", "en", "y"), (3, "a", "cy", "z"), (4, "b", "en", "w")],
                                 "seq int, tag string, lang string, text string")
    asked = spark.createDataFrame([(0, "a", "en"), (1, "a", "en"), (2, "a", "cy"), (3, "b", "cy"), (4, "none", "en")],
                                  "draw int, tag string, lang string")
    got = {r.draw: r.response for r in knowledge.pick_response(asked, resp, F.col("draw")).collect()}
    assert got == {0: "x", 1: "y", 2: "z", 3: "w", 4: None}
