"""Streams against their batch twins: files out of order, late and invalid rows, restarts, silent conversations."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import corpus as cp
from tidemark.operators import turns as tn
from tidemark.streaming import feedback, turns, vectors

TALK = ["I'm so overwhelmed by this dissertation", "ok", "how much are the fees?", "I want to study nursing in Swansea", "thanks", "I'm so excited, can't wait!"]


def test_turns_in_any_order_over_many_triggers(spark, tmp_path):
    rng = random.Random(3)
    rows = [(c, t, ["user", "assistant", "system"][0 if t % 2 == 0 else rng.choice([1, 1, 2])], rng.choice(TALK)) for c in range(6) for t in range(9)]
    rng.shuffle(rows)
    for i in range(0, len(rows), 11):
        spark.createDataFrame(rows[i : i + 11], turns.TURN).coalesce(1).write.parquet(f"{tmp_path}/in{i}")
    got = turns.run_turn_states(spark, f"{tmp_path}/in*", files_per_trigger=1)
    whole = spark.createDataFrame(rows, turns.TURN).where("role <> 'system'")
    mood = tn.emotions(whole).select("conv_id", "turn", "emotion")
    state = tn.student_state(whole).select("conv_id", "turn", "anchor")
    stack = tn.recent_topics(whole).select("conv_id", "turn", F.array_join("topics", ",").alias("topics"))
    want = mood.join(state, ["conv_id", "turn"]).join(stack, ["conv_id", "turn"])
    assert sorted(map(tuple, got.select("conv_id", "turn", "emotion", "anchor", "topics").collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


class _State:
    def __init__(self):
        self.value, self.timeout, self.hasTimedOut = None, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_silent_conversation_gives_up_waiting():
    state = _State()

    def feed(*rows):
        frame = pd.DataFrame(rows, columns=["turn", "role", "own", "here", "raised"])
        return [tuple(r) for out in turns.fold((7,), iter([frame]), state, 1000) for r in out.itertuples(index=False)]

    assert feed((2, "user", None, "nursing", "fees")) == []
    assert [r[1] for r in feed((0, "user", "sad", None, ""), (0, "user", "again", None, ""))] == [0]
    assert state.timeout == 1000
    state.hasTimedOut = True
    assert feed() == [(7, 2, "sad", "nursing", "fees")]
    assert state.value is None


def test_intake_over_late_and_invalid_rows_in_two_runs(spark, tmp_path):
    base = dt.datetime(2024, 3, 1)
    rng = random.Random(1)
    rows = [(i, base + dt.timedelta(hours=rng.randrange(24 * 12)), i, "error", 0.0, "{}") for i in range(300)]
    rng.shuffle(rows)
    store, source = f"{tmp_path}/store", f"{tmp_path}/events"
    for part in (rows[:170], rows[170:]):
        spark.createDataFrame(part, feedback.EVENT).repartition(4).write.mode("append").parquet(source)
        feedback.take_in(spark, source, store, files_per_trigger=1)
        seen = feedback.newest(spark, f"{store}/daily")
        assert seen.count() > 0
    want = {}
    for i, ts, *_ in rows:
        if i % 9 != 1:
            want.setdefault(ts.strftime("%Y-%m-%d"), []).append(min(5, max(1, i % 9 - 1)))
    assert {r.day: (r.n, r.avg_satisfaction) for r in seen.collect()} == {d: (len(v), round(sum(v) / len(v), 6)) for d, v in want.items()}
    bad = spark.read.parquet(f"{store}/quarantine/batch=*")
    assert sorted(r.event_id for r in bad.collect()) == [i for i in range(300) if i % 9 == 1]
    days = spark.read.option("basePath", f"{store}/daily").parquet(f"{store}/daily/batch=*")
    assert days.groupBy("batch").count().agg(F.max("batch")).first()[0] >= 7


def test_refresh_embeds_changes_only_and_replays_safely(spark, tmp_path):
    store = f"{tmp_path}/store"
    merge = vectors.refresh(store, cp.hashing_vectoriser(8))
    first = spark.createDataFrame([(1, 1, "a b"), (2, 1, "c"), (3, 1, "d"), (3, 2, "e")], "id bigint, version int, text string")
    second = spark.createDataFrame([(1, 3, "a b"), (2, 3, "c c"), (4, 3, "new")], "id bigint, version int, text string")
    for batch, i in ((first, 0), (second, 1), (second, 1)):
        merge(batch, i)
    got = {r.id: (r.hash, r.batch) for r in vectors.current(spark, store).collect()}
    text = {1: ("a b", 0), 2: ("c c", 1), 3: ("e", 0), 4: ("new", 1)}
    want = spark.createDataFrame([(i, t) for i, (t, _) in text.items()], "id int, t string").select("id", cp.content_hash(F.col("t")).alias("h"))
    assert got == {r.id: (r.h, text[r.id][1]) for r in want.collect()}
    assert spark.read.parquet(f"{store}/batch=1").count() == 2
