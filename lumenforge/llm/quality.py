"""Quality classifier: naive Bayes support vectors.

Features are presence indicators of hashed byte n-grams of the whole lower-cased
text. Each is scaled by its class log-count ratio; a linear hinge-loss model is
then fitted by dual coordinate descent, and its margin is put on the scale from
0 to 1 by a logistic fitted on held-out folds of the sample.

The fit uses a bounded sample of labelled rows (``sample`` documents, balanced by
class, one bitmap of 2^bits bits for each) and runs in one task; the driver gets the
model alone. Everything else covers all rows. Null and empty texts get a score like any other (their only
n-grams are the boundary's). With no labelled rows, or one class, the score is
that class's share (0.5 without any).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, id_crc
from .ngrams import chunks, presence
from .sampling import balanced_sample

ORDERS, BITS, SAMPLE = (1, 2, 3, 4), 16, 4000


def bitmaps(rows: DataFrame, text_col: str, label: str, orders: tuple[int, ...], bits: int) -> DataFrame:
    """y, x: labels and packed presence bitmaps of a sample."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, docs in chunks(pdf["t"].tolist()):
                x = np.packbits(presence(docs, orders, bits), axis=1)
                yield pd.DataFrame({"y": pdf["y"].iloc[at : at + len(docs)].to_numpy(), "x": [r.tobytes() for r in x]})

    src = rows.select(F.col(label).alias("y"), F.col(text_col).alias("t"))
    return src.mapInPandas(giving_back(run), f"y {src.schema['y'].dataType.simpleString()}, x binary")


def fitted(sample: DataFrame, bits: int, share: float) -> dict:
    """The model of a bounded sample's bitmaps, fitted in one task; only the model comes to the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = sorted(((str(y), y, x) for pdf in batches for y, x in zip(pdf["y"].tolist(), pdf["x"].tolist())), key=lambda r: (r[0], r[2]))
        x = np.zeros((len(got), (1 << bits) // 8), np.uint8)
        for row, r in zip(x, got):
            row[:] = np.frombuffer(r[2], np.uint8)
        labels = [r[1] for r in got]
        del got
        yield pd.DataFrame({"model": [pickle.dumps(fit(labels, x, share))]})

    made = sample.repartition(1).mapInPandas(giving_back(run), "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else {"weight": None, "constant": 0.5}


def log_count_ratio(x: np.ndarray, y: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """x: packed bitmaps; y: +1 or -1. log((p / |p|) / (q / |q|)) with p, q smoothed counts of documents by class."""
    p, q = (alpha + sum_bits(x[y == s]) for s in (1, -1))
    return np.log((p / p.sum()) / (q / q.sum()))


def sum_bits(x: np.ndarray) -> np.ndarray:
    total = np.zeros(x.shape[1] * 8)
    for a in range(0, len(x), 256):
        total += np.unpackbits(x[a : a + 256], axis=1).sum(0)
    return total


def dual_descent(index: list[np.ndarray], value: np.ndarray, y: np.ndarray, c: np.ndarray, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """L1-loss linear support vectors by dual coordinate descent; the last weight is the bias.

    index: the features of each row; value: each feature's value, so that row i
    holds value[index[i]]; rows are scaled to length 1. c: upper bound of each row's dual.
    """
    w, bias, alpha = np.zeros(len(value)), 0.0, np.zeros(len(index))
    size = np.array([float(np.dot(v, v)) for v in (value[idx] for idx in index)])
    scale, diag = 1.0 / np.maximum(1e-12, np.sqrt(size)), np.where(size > 0, 2.0, 1.0)
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(index)):
            at = index[i]
            x = value[at] * scale[i]  # made anew, as all rows' values would be most of the driver's memory
            g = y[i] * (float(w[at] @ x) + bias) - 1.0
            new = min(max(alpha[i] - g / diag[i], 0.0), c[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * x
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return np.append(w, bias)


def logistic(m: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a m + b))) by Newton's method; weight: of each row."""
    a, b = 1.0, 0.0
    t = np.where(y > 0, 0.999, 0.001)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g, s = weight * (p - t), weight * np.maximum(p * (1 - p), 1e-6)
        h = np.array([[s @ (m * m) + 1e-3, s @ m], [s @ m, s.sum() + 1e-3]])
        da, db = np.linalg.solve(h, [g @ m + 1e-3 * (a - 1), g.sum()])
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-8:
            break
    return max(a, 1e-3), b


def fit(labels: list, x: np.ndarray, share: float, cost: float = 1.0) -> dict:
    """x: packed bitmaps of the sample; share: label 1's share of all labelled rows, which the scale is set to."""
    y = np.where(np.array(labels, float) > 0.5, 1, -1) if labels else np.zeros(0)
    if len(set(y.tolist())) < 2:
        return {"weight": None, "constant": float(y[0] > 0) if len(y) else 0.5}
    narrow = np.uint16 if x.shape[1] * 8 <= 1 << 16 else np.int32  # the driver holds all of these
    index = [np.flatnonzero(np.unpackbits(r)).astype(narrow) for r in x]

    def model(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ratio = log_count_ratio(x[rows], y[rows])
        n = np.array([(y[rows] == s).sum() for s in (1, -1)])
        c = cost * len(rows) / (2.0 * np.where(y[rows] > 0, n[0], n[1]))
        return ratio, dual_descent([index[i] for i in rows], ratio, y[rows].astype(float), c)

    def margins(rows: np.ndarray, ratio: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.array([(w[index[i]] * ratio[index[i]]).sum() / max(1e-12, np.sqrt((ratio[index[i]] ** 2).sum())) for i in rows]) + w[-1]

    fold = np.arange(len(y)) % 3
    m = np.zeros(len(y))
    for k in range(3):
        if len(set(y[fold != k].tolist())) == 2:
            m[fold == k] = margins(np.flatnonzero(fold == k), *model(np.flatnonzero(fold != k)))
    pos = float((y > 0).mean())
    a, b = logistic(m, y, np.where(y > 0, share / pos, (1 - share) / (1 - pos)))
    ratio, w = model(np.arange(len(y)))
    return {"weight": (w[:-1] * ratio).astype(np.float64), "square": (ratio**2).astype(np.float64), "bias": float(w[-1]), "a": a, "b": b}


def score(docs: list[bytes], model: dict, orders: tuple[int, ...], bits: int) -> np.ndarray:
    if model["weight"] is None:
        return np.full(len(docs), model["constant"])
    row, col = np.nonzero(presence(docs, orders, bits))
    m = np.bincount(row, model["weight"][col], len(docs)) / np.maximum(1e-12, np.sqrt(np.bincount(row, model["square"][col], len(docs))))
    return 1 / (1 + np.exp(-np.clip(model["a"] * (m + model["bias"]) + model["b"], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> dict:
    """Fit on rows whose crc32(doc_id) mod 5 is not 0. A document with several labels counts by the highest; null labels and ids are left out."""
    known = labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IS NOT NULL")
    known = known.filter(id_crc() % 5 != 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    share = known.agg(F.avg("y")).first()[0]
    if share is None:
        return {"weight": None, "constant": 0.5}
    chosen = balanced_sample(known, "doc_id", "y", sample)
    # at most 2 * sample ids, so the broadcast is bounded
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").limit(4 * sample)
    return fitted(bitmaps(rows, "text", "y", orders, bits), bits, float(share))


def classify(docs: DataFrame, model: dict, threshold: float = 0.3, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> DataFrame:
    """Score every text of ``docs``; narrow, all columns of the input stay, with quality_score and quality_pred added."""
    sc = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = np.concatenate([score(d, sc.value, orders, bits) for _, d in chunks(pdf["text"].tolist())]) if len(pdf) else np.zeros(0)
            yield pdf[names].assign(quality_score=s, quality_pred=(s >= threshold).astype("int32"))

    return docs.mapInPandas(giving_back(run), f"{fields}, quality_score double, quality_pred int")


def op10(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = classify(docs.select("doc_id", "text").withColumn("held_out", id_crc() % 5 == 0), train(docs, labels))
    return out.select("doc_id", "held_out", F.col("quality_score").alias("score"), F.col("quality_pred").alias("predicted"))
