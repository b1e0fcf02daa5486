"""Collocations against SQL-free brute force: numbers and words as keys, rare pairs, hot pairs, awkward rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from tidemark.llm import phrases


def brute(rows, least, top):
    f, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cands = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    covered = Counter()
    for (lang, p), a in cands.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                covered[lang, p[i : i + m]] = max(covered[lang, p[i : i + m]], a)
    out = []
    for (lang, p), a in cands.items():
        if covered[lang, p] and 100 * covered[lang, p] >= 80 * a:
            continue
        score, cut = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:cut]], f[lang, p[cut:]]))
    got, seen = [], Counter()
    for lang, score, a, p, left, right in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            got.append((lang, seen[lang], p.decode(), -a, left, right, total[lang], -score))
    return sorted(got)


def table(seed):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(40)] + ["Ünï", "日本", "\x01c", "to-day"]
    fixed = [["New", "york", "city"], ["of", "the"], ["a", "b", "a", "b"], ["x"] * 4]
    rows = [("en", None), (None, None), ("en", ""), ("de", " \t\n.,;"), (None, "alone")]
    for i in range(120):
        w = []
        for _ in range(rng.randrange(1, 40)):
            w += rng.choice(fixed) if rng.random() < 0.3 else [rng.choice(base) if rng.random() < 0.8 else f"rare{rng.randrange(10**6)}"]
        text = "".join(x + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for x in w)
        rows.append((rng.choice(["en", "en", "en", "de", None, "und"]), text))
    return rows + rows[5:9]


@pytest.mark.parametrize("most_words", [phrases.MOST_WORDS, 0])
@pytest.mark.parametrize("least,top", [(4, 2000), (7, 5)])
def test_equals_brute_force(spark, most_words, least, top):
    rows = table(least)
    docs = spark.createDataFrame([(*r, "p", 1) for r in rows], "lang string, text string, phrase string, n int").repartition(4)
    got = sorted(tuple(r) for r in phrases.collocations(docs, least, top, most_words).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    want = brute(rows, least, top)
    assert got == want
    assert len(want) > 10


def test_windows_of_hot_words_are_dealt_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HOT", 20)
    monkeypatch.setattr(phrases, "PER_RANGE", 50)
    monkeypatch.setattr(phrases, "PACKET", 200)
    rows = table(11)
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(tuple(r) for r in phrases.collocations(docs, 5, 100).collect()) == brute(rows, 5, 100)


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert phrases.collocations(spark.createDataFrame([("en", "a b")], "lang string, text string")).count() == 0
