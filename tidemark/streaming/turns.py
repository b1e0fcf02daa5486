"""Conversation turns as a stream with state per conversation.

Rules run in the JVM before grouping; the stateful step only folds small labels, and its result equals the window versions of
the batch operators. Turns are folded in the order of their numbers whatever order files and triggers bring them in: a turn
that comes before its predecessors waits in the state. A conversation that stays silent for ``PATIENCE`` gives up waiting,
folds what it has and leaves the state.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark import rules
from tidemark.functions import regex as rx
from tidemark.operators import turns as tn
from tidemark.session import scratch_path

TURN = "conv_id bigint, turn bigint, role string, text string"
OUT = "conv_id bigint, turn bigint, emotion string, anchor string, topics string"
STATE = "near string, anchor string, topics string, expected bigint, waiting string"
#: Silence after which a conversation counts as ended; turn numbers start at FIRST.
PATIENCE = 24 * 3600 * 1000
FIRST = 0


def labelled(turns: DataFrame) -> DataFrame:
    """Turns with their own emotion, anchor and topic labels; each mask is a column, so it is built once."""
    t = F.col("text")
    masks = turns.select(
        "conv_id", "turn", "role", rx.first_label(t, rules.EMOTIONS, True).alias("own"),
        tn.rule_mask(t, [p for p, _ in rules.COURSES], True).alias("_course"),
        tn.rule_mask(t, [p for p, _ in rules.TOPICS], True).alias("_topic"),
        tn.rule_mask(t, [p for p, _ in rules.TOPICS_RECENT]).alias("_recent"))
    here = F.coalesce(tn.mask_first(F.col("_course"), tn.COURSE_LABELS), tn.mask_first(F.col("_topic"), tn.TOPIC_LABELS))
    return masks.select("conv_id", "turn", "role", "own", here.alias("here"),
                        F.array_join(tn.mask_list(F.col("_recent"), tn.RECENT_LABELS), ",").alias("raised"))


class Conversation:
    """What is carried from turn to turn: the last three (role, label) pairs, the anchor and the topics raised so far."""

    def __init__(self, near: str = "", anchor: str = "", topics: str = "") -> None:
        self.recent = [tuple(p.split("=", 1)) for p in near.split(";") if p]
        self.anchor, self.stack = anchor, [t for t in topics.split(",") if t]

    def packed(self) -> tuple[str, str, str]:
        return ";".join("=".join(p) for p in self.recent), self.anchor, ",".join(self.stack)

    def take(self, role: str, own: str, here: str, raised: str) -> tuple | None:
        """Fold one turn in; a user turn returns its emotion, anchor and topics. Other roles than the two speakers pass by."""
        if role not in ("user", "assistant"):
            return None
        out = None
        if role == "user":
            self.anchor = here or self.anchor
            self.stack += [t for t in raised.split(",") if t and t not in self.stack]
            earlier = [label for r, label in self.recent if r == "user" and label]
            out = (own or (earlier[-1] if earlier else "neutral"), self.anchor or None, ",".join(self.stack[-5:]))
        self.recent = [*self.recent, (role, own)][-3:]
        return out


def fold(key, batches: Iterator[pd.DataFrame], state: GroupState, patience: int | None = None) -> Iterator[pd.DataFrame]:
    """Fold the turns that are next in order; the others wait. A turn number that was folded before is passed over."""
    near, anchor, topics, expected, waiting = state.get if state.exists else ("", "", "", FIRST, "[]")
    talk, held = Conversation(near, anchor, topics), {t[0]: t for t in json.loads(waiting)}
    for batch in batches:
        rows = batch.astype(object).where(batch.notna(), "")
        for turn, *rest in zip(*(rows[c] for c in ("turn", "role", "own", "here", "raised")), strict=True):
            if turn >= expected:
                held.setdefault(int(turn), (int(turn), *rest))
    out = []
    for turn in sorted(held):
        if turn != expected and not state.hasTimedOut:
            break
        found = talk.take(*held.pop(turn)[1:])
        expected = turn + 1
        if found:
            out.append((key[0], turn, *found))
    if state.hasTimedOut:
        state.remove()
    else:
        state.update((*talk.packed(), expected, json.dumps([held[t] for t in sorted(held)])))
        if patience:
            state.setTimeoutDuration(patience)
    yield pd.DataFrame(out, columns=["conv_id", "turn", "emotion", "anchor", "topics"])


def turn_states(turns: DataFrame, patience: int | None = PATIENCE) -> DataFrame:
    """Without ``patience`` no conversation is given up: a query that drains its source and stops would never stop for its timers."""
    timeout = GroupStateTimeout.ProcessingTimeTimeout if patience else GroupStateTimeout.NoTimeout
    return labelled(turns).groupBy("conv_id").applyInPandasWithState(partial(fold, patience=patience), OUT, STATE, "append", timeout)


def run_turn_states(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Drain the source once in bounded triggers; each lands under its own id, so a replay overwrites itself."""
    out = scratch_path(spark, "turn-states")
    turns = spark.readStream.schema(TURN).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    query = (turn_states(turns, None).writeStream.outputMode("append").trigger(availableNow=True)
             .option("checkpointLocation", scratch_path(spark, "turn-offsets"))
             .foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).start())
    query.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{out}/batch=*")
