"""Training-data operators against brute force and on awkward tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import classifier, decontaminate, line_dedup, main_text, ngram_join, pieces, pii, quality, sharding, shingles, token_cache
from tidemark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, own long, words int, n_words int, id int, v int, n int, size int, `key` string, label int, entity string"
EXTRA = ["x", 1, 2, 3, 4, 5, 6, 7, "k", 8, "e"]


def _words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho".split()) + str(rng.randrange(60)) for _ in range(n))


def awkward(spark):
    long = " ".join(_words(i, 400) for i in range(8))
    texts = [None, "", " \n\t ", "one", "one", "one two three", _words(1, 30), _words(1, 30), _words(1, 29) + " changed", long, "\n".join(_words(s, 12) for s in range(6)),
             "Write to a.b@c.example.org or +44 20 7946 0958 from 10.0.0.255, card 4111 1111 1111 1111.", "日本語のテキスト ünï ▁ \U0001F600"]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None, None, *EXTRA) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, None, None, None, None, *EXTRA), (None, _words(2, 40), "en", "s1", 3, *EXTRA)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, _words(1, 30)), (2, None), (3, ""), (4, "one two three"), (4, "one two three")], "item_id long, text string")


@pytest.fixture(scope="module")
def model_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


# ---- 1 sharding -----------------------------------------------------------------------------------------------------

def test_room_tree_takes_the_tightest():
    rng, tree, held = random.Random(3), sharding.RoomTree(), []
    for box in range(300):
        room = rng.randrange(100)
        tree.add(room, box)
        held.append((room, box))
    for _ in range(400):
        size = rng.randrange(120)
        fits = sorted(x for x in held if x[0] >= size)
        found = tree.take(size)
        assert found == (fits[0] if fits else None)
        if found:
            held.remove(found)


def test_best_fit_against_plain_search():
    rng = random.Random(4)
    sizes = sorted((rng.randrange(1, 50) for _ in range(200)), reverse=True)
    rooms, plain = [], []
    for s in sizes:
        fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
        i = min(fits)[1] if fits else len(rooms)
        if not fits:
            rooms.append(60)
        rooms[i] -= s
        plain.append(i)
    assert sharding.best_fit(sizes, 60) == plain
    assert sharding.best_fit(sizes, 60, 3) is None


@pytest.mark.parametrize("sizes", [[5] * 33, [100, 1, 1, 1, 1], list(range(50, 0, -1)), [], [7]])
def test_near_equal(sizes):
    shards = sharding.near_equal(sizes, 4)
    loads = [sum(s for s, b in zip(sizes, shards, strict=True) if b == i) for i in range(4)]
    assert max(loads) - min(loads) <= max(sizes, default=0)


def test_shards_are_whole_and_gapless(docs, monkeypatch):
    monkeypatch.setattr(sharding, "PACKET", 8)  # several rounds
    out = sharding.shard_documents(docs, 4).toPandas()
    assert len(out) == docs.count()
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert (out.groupby("text_crc32")["shard"].nunique() == 1).all()
    plain = docs.toPandas()["text"].fillna("")
    assert out["size"].sum() == sum(len(t.encode()) + 1 for t in plain)


def test_shards_balance(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PACKET", 512)
    rows = [(i, "x" * (i * 37 % 211)) for i in range(1500)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 16).toPandas()
    loads = out.groupby("shard")["size"].sum()
    assert len(loads) == 16 and loads.max() - loads.min() <= 212 * 8


def test_shards_of_nothing(empty):
    assert sharding.shard_documents(empty, 4).count() == 0


# ---- 2 decontamination ----------------------------------------------------------------------------------------------

def test_masks_catch_every_substitution_pattern():
    for r in range(decontaminate.SUBSTITUTIONS + 1):
        for gone in itertools.combinations(range(decontaminate.WINDOW), r):
            assert any(not {i + o for o in m} & set(gone) for m in decontaminate.MASKS for i in range(decontaminate.WINDOW - decontaminate.SPAN + 1))


def _agreeing(a: list[str], b: list[str]) -> int:
    best = 0
    for shift in range(-len(b), len(a)):
        same = [0 <= i + shift < len(a) and a[i + shift] == b[i] for i in range(len(b))]
        best = max([best, *(sum(same[i : i + 13]) for i in range(len(b)))])
    return best


def test_overlaps_against_brute_force(spark):
    rng, rows, tests = random.Random(5), [], [(i, _words(100 + i, 20 + i)) for i in range(6)] + [(9, "only nine words are in this short item here")]
    for i in range(60):
        words = _words(i, 60).split()
        part = tests[i % 7][1].split()[: rng.randrange(8, 24)]
        for _ in range(rng.randrange(4)):
            part[rng.randrange(len(part))] = "other"
        words[20 : 20 + len(part)] = part
        rows.append((i, ", ".join(words).upper() if i % 2 else " ".join(words)))
    got = decontaminate.overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(tests, "item_id long, text string"), ["doc_id"])
    got = {(r["doc_id"], r["item_id"]): r["agreeing"] for r in got.collect()}
    want = {}
    for i, t in rows:
        for k, x in tests:
            item, n = x.split(), _agreeing(re.findall(r"\w+", t.lower()), x.split())
            if n >= (len(item) if len(item) < 13 else 11):
                want[i, k] = n
    assert got == want and want


def test_decontaminate_awkward(docs, items, empty):
    out = decontaminate.decontaminate(docs, items)
    assert out.columns == docs.columns
    left = [r["doc_id"] for r in out.collect()]
    assert sorted(x for x in left if x is not None) == [0, 1, 2, 3, 4, 5, 11, 12] and left.count(None) == 2  # 9 and 10 hold parts of the item too
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).count() == docs.count()


# ---- 3 line dedup ---------------------------------------------------------------------------------------------------

def test_line_dedup_rules(spark):
    common, rare = "Shared  line of the site", "line seen on few sites"
    rows = [(i, f"own line {i}\n{common if i % 2 else common.upper()}\n\nend {i}" + (f"\n{rare}" if i < 7 else ""), f"s{i % 9}") for i in range(40)]
    rows += [(50, None, "s1"), (51, "", None), (52, common, "s2"), (0, rows[0][1], "s0")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r["doc_id"]: r for r in line_dedup.line_dedup(df, counts=("lines", "gone")).collect()}
    assert out[0]["text"] == rows[0][1] and out[0]["gone"] == 0  # first occurrence, also in its repeated row
    assert out[1]["text"] == f"own line 1\n\nend 1\n{rare}" and out[39]["text"] == "own line 39\n\nend 39"
    assert out[50]["text"] is None and out[51]["text"] == "" and out[52]["text"] == "" and out[52]["gone"] == 1
    assert 52 not in [r["doc_id"] for r in line_dedup.dedup_documents(df).collect()]


def test_line_dedup_awkward(docs, empty):
    assert line_dedup.dedup_documents(docs, min_sites=100).count() == docs.count()
    assert line_dedup.dedup_documents(docs).columns == docs.columns
    assert line_dedup.dedup_documents(empty).count() == 0


# ---- 4 n-gram Jaccard join ------------------------------------------------------------------------------------------

def _components(rows: list[tuple[int, str]]) -> dict[int, tuple[int, int]]:
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = {k: new if v == old else v for k, v in label.items()}
    return {i: (len(s), label[i]) for i, s in sets.items()}


def _families() -> list[tuple[int, str]]:
    rng, rows = random.Random(6), []
    for family in range(12):
        base = _words(1000 + family, 60).split()
        for _ in range(14):
            words = list(base)
            for _ in range(rng.randrange(6)):
                words[rng.randrange(60)] = f"edit{rng.randrange(9)}"
            rows.append(" ".join(words) + (" shared tail of the site in every text here " if family % 2 else ""))
    rows += ["", None, "one two", "ONE two", "one two three four five", " ".join(_words(1000, 60).split()[:50])]
    return list(enumerate(rows))


@pytest.mark.parametrize(("small", "cut", "local"), [(8, 2048, 8), (2, 2048, 2), (2, 5, 8)])
def test_join_against_brute_force(spark, monkeypatch, small, cut, local):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "SLICE", cut)
    monkeypatch.setattr(ngram_join, "LOCAL", local)
    rows = _families()
    out = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).toPandas()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.itertuples()} == _components(rows)


def test_dual_traversal_keeps_every_link():
    rows = [t for _, t in _families() if t]
    sets = list(shingles.sets(__import__("pyarrow").array(rows)))
    sizes = np.array([len(s) for s in sets])
    v, maps = np.arange(len(sets)), [ngram_join.bitmap(s) for s in sets]
    for roots in (v, v // 3):
        a, b = ngram_join.dual_traversal(v, sizes, maps, roots)
        found = set(zip(a.tolist(), b.tolist(), strict=True))
        for x, y in itertools.combinations(range(len(sets)), 2):
            if roots[x] != roots[y] and ngram_join.similar(sets[x], sets[y]):
                assert (x, y) in found
        assert all(roots[x] != roots[y] for x, y in found) and len(found) < len(v) * (len(v) - 1) // 4


def test_keep_one_awkward(docs, empty):
    out = ngram_join.keep_one(docs)
    assert out.columns == docs.columns
    left = sorted((r["doc_id"] for r in out.collect()), key=lambda x: -1 if x is None else x)
    assert left == [None, None, 0, 1, 2, 3, 5, 6, 9, 10, 11, 12]
    assert ngram_join.keep_one(empty).count() == 0


def test_components_of_chains_and_cliques(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7)] + [(a, b) for a in range(200, 206) for b in range(200, 206)]
    got = {r["v"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 120)} | {i: 200 for i in range(200, 206)}


# ---- 5 quality rules ------------------------------------------------------------------------------------------------

def test_quality_base_columns(spark, docs):
    extra = spark.createDataFrame([(90, "a b c d e f " * 4), (91, "a a a a a a a"), (92, "x | # y\nx | # y\n\nx | # y")], "doc_id long, text string")
    df = docs.select("doc_id", "text").union(extra).select("*", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"))
    for r in quality.verdicts(df, F.struct("doc_id", "text")).collect():
        text = r["row"]["text"] or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
        at: dict = {}
        for j in range(len(w) - 4):
            at.setdefault(tuple(w[j : j + 5]), []).append(j)
        cover = {k for v in at.values() if len(v) > 1 for j in v for k in range(j, j + 5)}
        lines = [x for x in text.split("\n") if x.strip()]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover))
        assert r["base_failed"] == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and (not r["kept"] or not r["base_failed"])


def test_cutoffs_follow_their_group(spark):
    rows = [(i, " ".join(f"w{i}x{j} {'#' if source == 'code' else 'z'}" for j in range(20)), "en", source) for i in range(300) for source in ("code", "news")]
    rows += [(1000, " ".join(f"a{j} #" for j in range(20)), "en", "news"), (1001, " ".join(f"a{j} #" for j in range(20)), "en", "code"), (1002, " ".join(f"a{j} b" for j in range(20)), None, "rare")]
    out = {r["row"]: r["kept"] for r in quality.verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), F.col("doc_id")).where("row >= 1000").collect()}
    assert out == {1000: False, 1001: True, 1002: True}


def test_quality_awkward(docs, empty):
    out = quality.quality_filter(docs)
    assert out.columns == docs.columns and {6, 7, 8, 9, 10} <= {r["doc_id"] for r in out.collect()}
    assert quality.quality_filter(empty).count() == 0


# ---- 6 classifier ---------------------------------------------------------------------------------------------------

def _labelled(spark, n: int):
    rows = [(i, _words(i, 25) if i % 3 else " | ".join(_words(i, 12).split()), int(i % 3 > 0)) for i in range(n)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(n, None), (None, "x y"), (n + 1, "")], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y) for i, _, y in rows] + [(n, None), (n + 1, 1), (None, 0)], "doc_id long, quality int")


def test_classifier_on_held_out_rows(spark):
    docs, labels = _labelled(spark, 400)
    out = classifier.classify(docs, labels).join(labels.where("doc_id < 400"), "doc_id").toPandas()
    test = out[out["held_out"]]
    assert len(test) > 50 and ((test["quality"] == test["predicted"]).mean() > 0.97) and out["score"].between(0, 1).all()


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(60, 5)), np.where(rng.random(60) < 0.5, 1.0, -1.0)
    w = classifier.dual_descent([(np.arange(5), r) for r in x], y, np.ones(60), 400)
    w = np.r_[w[:5], w[-1]]
    z = np.c_[x, np.ones(60)]
    hinge = np.maximum(0, 1 - y * (z @ w))
    assert np.allclose(w, 2 * (hinge * y) @ z, atol=1e-4)  # gradient of |w|^2 / 2 + sum of squared hinge losses


def test_classifier_without_lessons(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in classifier.classify(docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in range(12)], "doc_id long, quality int")
    assert {r["score"] for r in classifier.classify(docs, ones).collect()} == {1.0}
    assert classifier.classify(empty, ones).count() == 0


# ---- 7 main text ----------------------------------------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body class="has-sidebar">
<header><h1>Site of the day</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div id="cookie-notice">We use the cookies of this site for you and all of the others.</div>
<div class=ad>Buy the best of all.</div><article><header><h1>Head &amp; line</h1></header><p>It is the text of <b>this</b>&nbsp;page
and of the day.<p>alpha | beta</p><form><p>Your name of the day</p></form><ul><li>one<li>two</ul><p>a < b<br>and c</p><aside>more of the same</aside>
<section class="comments"><article class="comment"><p>The comment of a reader that is as long as the text of the page is.</p></article></section></article>
<footer>&copy; of the site</footer></body></html>"""


@pytest.mark.parametrize(("page", "text"), [
    (PAGE, "Head & line\nIt is the text of this page and of the day.\nalpha | beta\none\ntwo\na < b and c"),
    (None, ""), ("", ""), ("<!-- open <p>x", ""), ("<article>Les.</article>", "Les."),
    ("<p>The text of this page is long enough to be seen as the text of it by all of us.<p>Short as it is.<div class='share-bar'>Tell the others</div>",
     "The text of this page is long enough to be seen as the text of it by all of us.\nShort as it is."),
    ("<ul><li><a>one of the links</a><li><a>two of the links</a></ul>", ""),
])
def test_main_text(page, text):
    assert main_text.main_text(page) == text


def test_extract_keeps_columns(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "y"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    assert [r["text"] == "" for r in main_text.extract(pages, ["page_id", "url"]).collect()] == [False, True, True]
    assert main_text.extract(pages.limit(0), ["page_id"]).count() == 0


# ---- 8 pieces -------------------------------------------------------------------------------------------------------

def test_n_best_against_all_paths(model_path):
    model, rng = pieces.vocabulary(model_path), random.Random(2)
    for _ in range(150):
        text = "".join(rng.choice("theandio▁\n,.²ñ x") for _ in range(rng.randint(1, 8)))
        paths = []

        def grow(at, score, ids, part=" " + text, paths=paths):
            if at == len(part):
                paths.append((score, ids))
            for end, s, x in model._arcs(part, at) if at < len(part) else ():
                grow(end, score + s, ids + list(x))

        grow(0, 0.0, [])
        paths.sort(key=lambda p: -p[0])
        found = model.segmentations(text, 4)
        assert [round(p[0], 6) for p in paths[:4]] == [round(f[0], 6) for f in found]
        assert all(model.decode(f[1]) == text for f in found)
        _, score, loss, spells = model.encode(text)
        assert spells and score == pytest.approx(paths[0][0]) and loss == pytest.approx(paths[0][0] - paths[1][0] if len(paths) > 1 else np.inf)


def test_encoding_round_trip(docs, empty, model_path, monkeypatch):
    monkeypatch.setattr(pieces, "STRIDE", 50)
    out = pieces.encoded(docs, model_path, [F.col("doc_id"), F.col("text").alias("original")])
    back = pieces.decoded(out, model_path, [F.col("original"), F.col("round_trip"), F.col("n_pieces")]).collect()
    assert all(r["text"] == (r["original"] or "") and r["round_trip"] and (r["n_pieces"] > 0) == bool(r["original"]) for r in back)
    ranked = pieces.n_best(docs, model_path, [F.col("doc_id")], 3).where("doc_id = 6").first()["ranked"]
    assert len(ranked) == 3 and ranked[0]["score"] >= ranked[1]["score"] >= ranked[2]["score"]
    assert pieces.encoded(empty, model_path, [F.col("doc_id")]).count() == 0


def test_queries_return_ranked_lists(spark, sf, model_path):
    from tidemark.llm import registry

    model = pieces.vocabulary(model_path)
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    few = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    last = corpus_pipeline.STAGES[-1][1](spark, few, sf)
    for out in (registry.op8_piece_lattice(spark, sf), last):
        rows = out.collect()
        assert len(rows) == (len(text) if out is not last else 20)
        for r in rows:
            lists, scores = [tuple(r["ids"])], [r["score"]]
            for other in r["others"]:
                ids = list(r["ids"])
                for e in reversed(other["edits"]):
                    ids[e["start"] : e["end"]] = e["ids"]
                lists.append(tuple(ids))
                scores.append(other["score"])
            assert len(set(lists)) == len(lists) == (pieces.N_BEST if r["n_pieces"] > 20 else len(lists))
            assert scores == sorted(scores, reverse=True)
            assert r["round_trip"] and all(model.decode(x) == text[r["doc_id"]] for x in lists)
            assert r["margin"] is None or r["margin"] == pytest.approx(scores[0] - scores[1])
            assert [(s, tuple(x)) for s, x in model.segmentations(text[r["doc_id"]], pieces.N_BEST)] == list(zip(scores, lists, strict=True))


def test_ranked_lists_of_ties_and_wrong_ids(model_path, monkeypatch):
    model = pieces.Pieces(model_path)
    for text in ("x" * 3000, "a a a a a", "=" * 500 + " the theandio"):
        lists = model.segmentations(text, 4)
        assert len({tuple(ids) for _, ids in lists}) == 4 and all(model.decode(ids) == text for _, ids in lists)
        whole = [f for f, _ in model.ranked(text, 4)]
        monkeypatch.setattr(pieces, "STRIDE", 50)
        assert [f for f, _ in model.ranked(text, 4)] == whole
        monkeypatch.undo()
    flat = model.segmentations("right", 1)[0][1]
    ends = np.array([len(flat)])
    values = pieces.pa.array(flat, pieces.pa.int32())
    assert model.spell(["right"], [1], ends, values) == [True] and model.spell(["wrong"], [1], ends, values) == [False]


# ---- 9 personal data ------------------------------------------------------------------------------------------------

RULES = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def _base(text: str) -> str:
    out = []
    for rank, (kind, rule) in enumerate(RULES):
        for m in re.finditer(rule, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if (kind == "ip" and max(map(int, m[0].split("."))) > 255) or (kind == "card" and not (12 <= len(digits) <= 19 and _luhn(digits))) or (
                    kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_base_spans_against_brute_force(spark, docs):
    rng = random.Random(8)
    bits = ["a@b.c", "_x@y.z", "@", ".", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111111111111112", "+44 (20) 7946-0958", "+1", " ", "é", "\U0001F600", "7", "-", "00000255.0.0.1"]
    texts = ["".join(rng.choice(bits) for _ in range(12)) for _ in range(400)] + ["9" * 20000, "a" * 20000, "1-" * 5000, "x@" * 3000, None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").union(docs.select("text"))
    for r in df.select("text", pii.joined_spans(pii.base_spans(F.coalesce("text", F.lit("")))).alias("got")).collect():
        assert r["got"] == _base(r["text"] or ""), r["text"][:200]


def test_disclosing_terms(spark):
    rows = [(i, f"Call Zorblatt 4711 at boss{i // 6}@corp.example.org about the plan" if i < 6 else f"Nothing about the plan {i}") for i in range(60)]
    rows += [(70, None), (71, ""), (72, "mail solo@corp.example.org Quux")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["row"]: [(s["kind"], s["value"]) for s in r["spans"]] for r in pii.found_spans(df, F.col("doc_id")).collect()}
    assert out[0] == [("term", "Call"), ("term", "Zorblatt"), ("term", "4711"), ("email", "boss0@corp.example.org")]
    assert out[10] == out[70] == out[71] == [] and out[72] == [("email", "solo@corp.example.org")]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert clean[0] == "  [NUMBER] at [EMAIL] about the plan" and clean[10] == rows[10][1] and clean[70] is None


def _terms_found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["row"]: [(s["start"], s["value"]) for s in r["spans"] if s["kind"] == "term"] for r in pii.found_spans(df, F.col("doc_id")).collect()}
    assert len(out) == len(texts)
    return out


def test_disclosing_terms_of_rare_entities(spark):
    # in a large corpus the share of a pair met once or twice reaches the threshold; that of a common word does not
    texts = ["plain words here"] * 3000 + ["plain words Quux solo@corp.example.org", "Rara here duo@corp.example.org", "Rara words duo@corp.example.org"]
    out = _terms_found(spark, texts)
    assert (out[3000], out[3001], out[3002], out[0]) == ([(12, "Quux")], [(0, "Rara")], [(0, "Rara")], [])


def test_disclosing_terms_in_whole_texts(spark):
    far = "plain words " * 30
    texts = ["plain words"] * 3000 + [f"Zorblatt {far}a{i // 8}@b.org {far}zorblatt" for i in range(8)] + ["words Zorblatt plain", "+44 20 7946 0958 ZORBLATT"]
    out = _terms_found(spark, texts)
    assert all([v for _, v in out[i]] == ["Zorblatt", "zorblatt"] for i in range(3000, 3008))
    assert (out[3008], out[3009], out[0]) == ([(6, "Zorblatt")], [(17, "ZORBLATT")], [])


def test_located_and_masked_terms(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 3)
    rng = random.Random(5)
    bits = ["a@b.cd", "+1 234 567 8901", "abc", "xyz1", " ", "-", "4111111111111111", "é\U0001F600", "10.0.0.1", "zz"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(14))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("spans", pii.base_spans(F.col("text")))
    for r in df.select("text", "spans", pii.located(pii._free(F.col("text"), F.col("spans")), pii.FREE_TERM).alias("got")).collect():
        want = [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\W_]{3,}", r["text"]) if not any(s["start"] < m.end() and m.start() < s["end"] for s in r["spans"])]
        assert [tuple(x) for x in r["got"]] == want, r["text"]


def test_pii_awkward(docs, empty):
    assert pii.sanitised(docs).columns == docs.columns and pii.sanitised(docs).count() == docs.count()
    assert pii.found_spans(empty, F.col("doc_id")).count() == 0


# ---- 10 token counts ------------------------------------------------------------------------------------------------

def test_counts_and_cache(spark, docs, empty, model_path):
    from sentencepiece import SentencePieceProcessor

    cache, model = token_cache.fresh_cache(spark), SentencePieceProcessor(model_file=model_path)
    for _ in range(2):  # the second run encodes nothing
        out = token_cache.token_counts(docs, model_path, cache, limit=100).toPandas()
        assert len(out) == docs.count()
        stored = spark.read.parquet(cache)
        assert stored.count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    text = {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id IS NOT NULL").collect()}
    for r in out.dropna().itertuples():
        n = len(model.encode(text[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text[r.doc_id].encode()), n, n > 100)
    assert token_cache.token_counts(empty, model_path, token_cache.fresh_cache(spark)).count() == 0
    other = __import__("public_tokenizers").path("byte_bpe_50k.json")
    assert token_cache.token_counts(docs, other, cache).count() == docs.count()  # another version, the same cache
    assert hashlib.sha256(open(other, "rb").read()).digest() == token_cache.tokenizer_version(other)


def test_registered_queries_match_their_sql(spark, sf):
    from oracle_check import compare, connect

    from tidemark.llm.registry import ORACLES, QUERIES

    con = connect(sf)
    for name, sql in ORACLES.items():
        assert compare(QUERIES[name](spark, sf), sql, con) == "", name
