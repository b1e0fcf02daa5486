"""Multiprobe search against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import nearest, registry

SCHEMA = "vec_id long, embedding array<float>, row long, v int, score double"


def in_order(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += float(x) * float(y)
    return total


def brute(rows, query, k):
    """Rows are (id, vector); returns query id -> [(rank, id, score)] lists, one for each query row."""
    ok = [(i, np.array(v, np.float32)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (i, v) in enumerate(ok):
        if i is not None and query(i):
            found = sorted(((-in_order(v, w), math.inf if j is None else j, j) for b, (j, w) in enumerate(ok) if b != a and len(w) == len(v)), key=lambda t: t[:2])[:k]
            out += [(i, r + 1, j, -s) for r, (s, _, j) in enumerate(found)]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 0.5) for i, v in rows], SCHEMA)


def test_awkward_rows_are_exact_while_few(spark):
    rng = np.random.default_rng(1)
    some = [rng.normal(size=6).tolist() for _ in range(30)]
    rows = list(enumerate(some)) + [(100, None), (101, []), (102, [0.0] * 6), (103, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (104, [math.nan] * 6), (105, [math.inf] + [0.0] * 5),
                                    (106, [1.0, 2.0]), (107, [2.0, -1.0]), (None, some[3]), (4, some[4]), (40, some[4]), (60, (np.array(some[5]) * 7).tolist())]
    got = nearest.nearest(frame(spark, rows).repartition(3), F.col("vec_id") % 2 == 0, k=50)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, lambda i: i % 2 == 0, 50)


@pytest.mark.parametrize("kind", ["sphere", "clusters", "norms", "copies"])
def test_recall_and_exact_scores(spark, kind, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 300)
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", 40)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24))
    if kind == "clusters":
        x = x * 0.1 + rng.normal(size=(30, 24))[rng.integers(0, 30, 1500)]
    if kind == "norms":
        x *= rng.lognormal(0, 1, size=(1500, 1))
    if kind == "copies":
        x[rng.random(1500) < 0.4] = x[7]
    x = x.astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = [tuple(r) for r in nearest.nearest(frame(spark, rows), F.col("vec_id") % 10 == 0).collect()]
    want = brute(rows, lambda i: i % 10 == 0, 20)
    assert len(got) == len(want) == 150 * 20
    near = {(q, r): s for q, r, _, s in want}
    assert sum(s == near[q, r] or s >= near[q, 20] for q, r, _, s in got) >= 0.92 * len(want)
    score = {(q, j): s for q, _, j, s in got}
    assert all(s == in_order(x[q], x[j]) for (q, j), s in score.items())
    assert len(score) == len(got) and all(q != j for q, j in score)
    by = {}
    for q, r, j, s in sorted(got, key=lambda t: t[:2]):
        assert r == len(by.setdefault(q, [])) + 1
        by[q].append((-s, j))
    assert all(v == sorted(v) for v in by.values())
    if kind == "copies":
        assert {(q, j) for q, _, j, s in got if s == near[q, 1]} <= {(q, j) for q, _, j, _ in want}


def test_visits_fall_in_estimated_success_and_reach_the_target():
    rng = np.random.default_rng(3)
    for target in (0.5, 0.8, 0.95):
        cells, chance = nearest.visits(rng.normal(size=7) * 3, target)
        assert (np.diff(chance) <= 0).all() and chance.sum() >= target > chance[:-1].sum()
        assert len({tuple(c) for c in cells}) == len(cells)


def test_query_recall_on_the_given_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = {(q, j) for q, _, j, _ in brute(rows, lambda i: i % 20 == 0, 20)}
    got = {(r.query_id, r.vec_id) for r in registry.op11_multiprobe_search(spark, sf).collect()}
    assert len(got) == len(want) and len(got & want) >= 0.9 * len(want)


def test_empty_table(spark):
    assert nearest.nearest(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
