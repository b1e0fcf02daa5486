"""Periodic runs against brute force: every period of every text compared word by word."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import types as T

from tidemark.llm import registry, runs


def brute(words: list[str]) -> list[tuple[int, int, int]]:
    n, out = len(words), {}
    for q in range(1, n // 2 + 1):
        k = 0
        while k < n - q:
            e = k
            while e < n - q and words[e] == words[e + q]:
                e += 1
            if e > k and e + q - k >= max(12, 2 * q):
                out.setdefault((k, e + q), q)
            k = e + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def collapsed(words: list[str], found: list[tuple[int, int, int]]) -> str:
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, words: list[str]) -> list[str]:
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def texts(seed: int, count: int) -> list[str | None]:
    rng = random.Random(seed)
    out: list[str | None] = [None, "", " \t\n", "a", "a " * 11, "a " * 12, "a " * 3000, "x y " * 700 + "z", " wide  wide " * 9]
    while len(out) < count:
        n, letters = rng.choice([8, 13, 40, 150, 700]), rng.choice([1, 2, 4, 50])
        w = [f"w{rng.randrange(letters)}" for _ in range(n)]
        if rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + rng.randrange(max(1, (n - a) // 2))
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
            for _ in range(rng.randrange(3)):
                w[rng.randrange(n)] = "odd"
        out.append(rng.choice([" ", "\n", "\t "]).join(w))
    return out


def test_runs_and_collapsed_text_equal_brute_force(spark):
    rows = list(enumerate(texts(3, 160)))
    rows += rows[:12]  # repeated rows
    docs = spark.createDataFrame([(i, t, "r", "k") for i, t in rows], "doc_id long, text string, runs string, collapsed string")
    got = sorted((r.row.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(docs.repartition(5)).collect())
    want = []
    for i, t in rows:
        w = (t or "").replace("\n", " ").replace("\t", " ").split(" ")
        w = [x for x in w if x]
        want.append((i, brute(w), collapsed(w, brute(w))))
    assert got == sorted(want)
    assert sum(len(x[1]) for x in want) > 100


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(i * 7, t) for i, t in enumerate(texts(4, 300))] + [(None, "a " * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.asDict() for r in registry.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows)
    changed = 0
    for i, t in rows:
        w = [x for x in (t or "").replace("\n", " ").replace("\t", " ").split(" ") if x]
        p = planted(i, w) if i is not None else w
        changed += p != w
        found = brute(p)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        assert got[i] == {
            "doc_id": i, "n_runs": len(found), "start": best and best[0], "length": best and best[1], "period": best and best[2],
            "exponent_milli": best and 1000 * best[1] // best[2],
            "runs_sha256": hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest(),
            "collapsed_sha256": hashlib.sha256(collapsed(p, found).encode()).hexdigest()}, (i, t)
    assert changed > 10


@pytest.mark.parametrize("seed", range(3))
def test_tiles_of_one_text_meet_again(spark, seed):
    rng = random.Random(seed)
    period = [f"p{rng.randrange(9000)}" for _ in range(rng.randrange(600, 2500))]
    words = [f"q{rng.randrange(9000)}" for _ in range(900)] + period * 4 + period[:77] + [f"q{rng.randrange(9000)}" for _ in range(300)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    row = runs.periodic_runs(docs).first()
    assert [(r.length, r.period) for r in row.runs] == [(4 * len(period) + 77, len(period))]


def test_empty_table(spark):
    docs = spark.createDataFrame([], T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]))
    assert runs.periodic_runs(docs).count() == 0
