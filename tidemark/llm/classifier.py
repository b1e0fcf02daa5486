"""Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, a linear hinge-loss model on top.

Indicators are UTF-8 byte n-grams of orders ``ORDERS`` and three word patterns (a word twice or three times in a row, a
line seen before), hashed to ``WIDTH`` places. A text is the set of places that occur in it at all, as packed bits.

1. Log-count ratios come from all labelled training rows: every task adds up place counts per class, the sums are merged.
2. A training row is its indicators times the ratios, scaled to length one. The squared hinge loss is fitted by dual
   coordinate descent on ``FIT_ROWS`` rows, the documented bound (kept in the mean: a row's hash decides by itself).
3. A logistic curve through the margins of another ``CURVE_ROWS`` rows turns a margin into a probability.

Null and empty texts have no indicators and get the score of a zero margin. Null labels teach nothing; an id labelled
twice teaches twice; with one class or none in the training rows the score is the share of label 1 (a half without
rows). Other columns, language, source and id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import body, stage

WIDTH = 1 << 15
ORDERS = (1, 2, 3, 4)
FIT_ROWS = 6000
CURVE_ROWS = 3000
COST = 1.0
PASSES = 12
#: Hash places that choose the rows to fit on.
_PLACES = 1 << 30


def indicators(text: str) -> np.ndarray:
    """Sorted places of the indicators in a whole text."""
    seen = np.zeros(WIDTH, dtype=bool)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    rolling = np.zeros(len(data), dtype=np.uint32)
    for n in range(1, max(ORDERS) + 1):
        if len(data) < n:
            break
        rolling = rolling[: len(data) - n + 1] * np.uint32(0x01000193) + data[n - 1 :] + np.uint32(1)
        if n in ORDERS:
            mixed = rolling * np.uint32(0x9E3779B1)
            seen[mixed >> np.uint32(32 - 15)] = True
    words = text.split()
    twice = sum(a == b for a, b in zip(words, words[1:], strict=False))
    thrice = any(a == b == c for a, b, c in zip(words, words[1:], words[2:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    seen[[0, 1, 2]] = 20 * twice > len(words), thrice, 4 * len(set(lines)) < 3 * len(lines)
    return np.flatnonzero(seen)


def _packed(places: np.ndarray) -> bytes:
    flags = np.zeros(WIDTH, dtype=bool)
    flags[places] = True
    return np.packbits(flags).tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, dtype=np.uint8)))


def class_counts(labelled: DataFrame) -> DataFrame:
    """(text, label) -> (label, n, counts): rows and summed indicators per class, one row per task and class, then merged."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros((2, WIDTH), dtype=np.int64), [0, 0]
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[label][indicators(text)] += 1
                rows[label] += 1
        yield pa.RecordBatch.from_pydict({"label": pa.array([0, 1], pa.int32()), "n": pa.array(rows, pa.int64()), "counts": pa.array(list(sums), pa.list_(pa.int64()))})

    parts = labelled.select("text", "label").mapInArrow(add, "label int, n bigint, counts array<bigint>")
    # blocks of places, so that the merge of many tasks is dealt over many tasks too
    blocks = parts.select("label", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1), F.lit(1024)), lambda i: F.struct(i.alias("at"), F.slice("counts", i + 1, 1024).alias("part")))).alias("b"))
    places = blocks.select("label", "n", "b.at", F.posexplode("b.part").alias("i", "c")).groupBy("label", (F.col("at") + F.col("i")).alias("place"))
    return places.agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def log_ratios(counts: pd.DataFrame) -> np.ndarray:
    """log of (smoothed share of a place among class 1's indicators over that of class 0)."""
    both = np.ones((2, WIDTH))
    both[counts["label"], counts["place"]] += counts["c"]
    shares = both / both.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def _row(places: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    values = ratios[places]
    length = np.sqrt(values @ values)
    return values / length if length else values


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], signs: np.ndarray, cost: np.ndarray, passes: int = PASSES) -> np.ndarray:
    """Weights (last one the bias) of the squared hinge loss; rows are (places, values) in a fixed random order each pass."""
    weights, alpha = np.zeros(WIDTH + 1), np.zeros(len(rows))
    slack = 0.5 / cost
    squares = np.array([v @ v + 1.0 for _, v in rows]) + slack
    order = np.random.default_rng(7)
    for _ in range(passes):
        for i in order.permutation(len(rows)):
            places, values = rows[i]
            slope = signs[i] * (weights[places] @ values + weights[-1]) - 1.0 + slack[i] * alpha[i]
            new = max(0.0, alpha[i] - slope / squares[i])
            if new != alpha[i]:
                change = (new - alpha[i]) * signs[i]
                weights[places] += change * values
                weights[-1] += change
                alpha[i] = new
    return weights


def logistic_curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of P(label 1) = 1 / (1 + exp(-(slope * margin + shift))) by Newton steps on smoothed targets."""
    ones = labels.sum()
    target = np.where(labels == 1, (ones + 1) / (ones + 2), 1 / (len(labels) - ones + 2))
    x, w = np.c_[margins, np.ones(len(margins))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 1e-6)), float(w[1])


def fit(labelled: DataFrame, fit_rows: int = FIT_ROWS, curve_rows: int = CURVE_ROWS, cost: float = COST) -> dict:
    """Model from (id, text, label) rows: ``weights`` per place, ratios and curve."""
    labelled = labelled.where(F.col("label").isin(0, 1) & F.col("text").isNotNull()).select("id", "text", F.col("label").cast("int"))
    counts = class_counts(labelled).toPandas()  # 2 * WIDTH rows at most, at any input size
    rows = counts.drop_duplicates("label").set_index("label")["n"] if len(counts) else pd.Series(dtype=int)
    n0, n1 = int(rows.get(0, 0)), int(rows.get(1, 0))
    if not n0 or not n1:
        return {"constant": 0.5 if n0 + n1 == 0 else float(n1 > 0)}
    ratios = log_ratios(counts)
    share = min(1.0, (fit_rows + curve_rows) / (n0 + n1))
    place = F.pmod(F.xxhash64("id", "text"), F.lit(_PLACES))
    chosen = labelled.where(place < int(share * _PLACES)).select(place.alias("place"), "text", "label")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [_packed(indicators(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary()), batch.column(2)], ["place", "bits", "label"])

    def train(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["place", "label", "bits"], kind="stable")
        labels = group["label"].to_numpy()
        places = [_unpacked(b) for b in group["bits"]]
        data = [(p, _row(p, ratios)) for p in places]
        cut = len(data) * fit_rows // (fit_rows + curve_rows)
        signs, share = np.where(labels == 1, 1.0, -1.0), max(1e-3, min(1 - 1e-3, labels[:cut].mean() if cut else 0.5))
        weights = dual_descent(data[:cut], signs[:cut], cost * np.where(labels[:cut] == 1, 0.5 / share, 0.5 / (1 - share)))
        margins = np.array([weights[p] @ v + weights[-1] for p, v in data[cut:]])
        slope, shift = logistic_curve(margins, labels[cut:])
        return pd.DataFrame({"weights": [weights.tolist()], "slope": [slope], "shift": [shift]})

    packed = chosen.mapInArrow(pack, "place long, bits binary, label int")
    model = packed.withColumn("one", F.lit(0)).groupBy("one").applyInPandas(train, "weights array<double>, slope double, shift double").first()
    return {"weights": np.array(model["weights"]), "ratios": ratios, "slope": model["slope"], "shift": model["shift"]}


def scored(docs: DataFrame, model: dict, keep: list[Column], text_col: str = "text") -> DataFrame:
    """keep... and ``score`` for every row, in batches; the model (WIDTH numbers) goes with the task."""
    rows = docs.select(*keep, body(F.col(text_col)).alias("whole text"))
    if "constant" in model:
        return rows.select(*rows.columns[:-1], F.lit(model["constant"]).alias("score"))
    out = rows.drop("whole text").withColumn("score", F.lit(0.0)).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios, weights, bias = model["ratios"], model["weights"][:-1] * model["ratios"], model["weights"][-1]
        squares = ratios * ratios
        for batch in batches:
            values = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(batch.num_columns - 1)):
                places = indicators(text.as_py())
                length = np.sqrt(squares[places].sum())
                margin = bias + (weights[places].sum() / length if length else 0.0)
                values[i] = 1 / (1 + np.exp(-np.clip(model["slope"] * margin + model["shift"], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values)], [f.name for f in out])

    return rows.mapInArrow(score, out)


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """(id, held_out, score, predicted); trained on labelled rows that are not held out."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(~held_out(F.col("id")) & F.col("id").isNotNull())
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    # labels grow with the corpus: joined by shuffle at every size
    model = fit(stage(rows.join(known.hint("merge"), "id"), "labelled"))
    out = scored(docs, model, [F.col(id_col).alias("id")], text_col)
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
