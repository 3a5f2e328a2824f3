"""A head of two layers, fitted on frozen features by full-batch AdamW; the epoch kept has the best balanced accuracy.

logit = w2 . gelu(W1 x + b1) + b2, gelu(z) = z * (1 + erf(z / sqrt 2)) / 2, loss: mean binary cross entropy.

An epoch is one pass: each task adds up the gradient of its training rows and the confusion of
its validation rows (training rows, if there are none) at the weights of now, in matrix products
over a batch; the tasks' sums, as many numbers as the head has, are added by place. The step is taken on
the driver, which holds the weights and two moments, a few KB. Rows whose features or label are
null or NaN take no part; no training rows at all leave the weights as they were.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Decays and epsilon of the step, the cut at which accuracy is taken, bounds of a logit.
BETA1, BETA2, EPSILON, CUT, CLIP = 0.9, 0.999, 1e-8, 0.65, 30.0
_ERF = np.frompyfunc(math.erf, 1, 1)


@dataclass
class GeluHead:
    w1: np.ndarray  # hidden x inputs
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    @classmethod
    def drawn(cls, inputs: int, hidden: int, seed: int = 1) -> GeluHead:
        """Weights uniform within 1 / sqrt(fan in), the same for a seed."""
        rng = np.random.default_rng(seed)
        a, b = 1 / math.sqrt(inputs), 1 / math.sqrt(hidden)
        return cls(rng.uniform(-a, a, (hidden, inputs)), rng.uniform(-a, a, hidden), rng.uniform(-b, b, hidden), float(rng.uniform(-b, b)))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.w1.ravel(), self.b1, self.w2, [self.b2]])

    def shaped(self, flat: np.ndarray) -> GeluHead:
        h, d = self.w1.shape
        return GeluHead(flat[: h * d].reshape(h, d), flat[h * d : h * d + h], flat[h * d + h : h * d + 2 * h], float(flat[-1]))

    def _hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = x @ self.w1.T + self.b1
        return z, 0.5 * (1.0 + _ERF(z / math.sqrt(2.0)).astype(np.float64))

    def logits(self, x: np.ndarray) -> np.ndarray:
        z, normal = self._hidden(x)
        return (z * normal) @ self.w2 + self.b2

    def gradient(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The loss's gradient summed over rows, in the order of ``flat``."""
        z, normal = self._hidden(x)
        g = z * normal
        d = probability(g @ self.w2 + self.b2) - y
        dz = d[:, None] * self.w2 * (normal + z * np.exp(-0.5 * z * z) / math.sqrt(2.0 * math.pi))
        return np.concatenate([(dz.T @ x).ravel(), dz.sum(0), g.T @ d, [d.sum()]])


def probability(logits: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(logits, -CLIP, CLIP)))


class AdamW:
    def __init__(self, size: int, rate: float, decay: float) -> None:
        self.rate, self.decay, self.n = rate, decay, 0
        self.m, self.v = np.zeros(size), np.zeros(size)

    def step(self, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        self.n += 1
        self.m, self.v = BETA1 * self.m + (1 - BETA1) * g, BETA2 * self.v + (1 - BETA2) * g * g
        m, v = self.m / (1 - BETA1**self.n), self.v / (1 - BETA2**self.n)
        return w * (1 - self.rate * self.decay) - self.rate * m / (np.sqrt(v) + EPSILON)


def prepared(rows: DataFrame, features: list[str | Column], label: str, valid: Column) -> DataFrame:
    """x, y, valid: what training reads, cut off from its source."""
    x = F.array(*[(F.col(f) if isinstance(f, str) else f).cast("double") for f in features])
    held = rows.select(x.alias("x"), F.col(label).cast("double").alias("y"), F.coalesce(valid, F.lit(False)).alias("valid"))
    return held.filter("y IS NOT NULL AND NOT isnan(y) AND forall(x, c -> c IS NOT NULL AND NOT isnan(c))")


def measured(rows: DataFrame, head: GeluHead) -> tuple[np.ndarray, int, np.ndarray]:
    """Summed gradient and number of training rows; true and all positives, true and all negatives of validation and of training rows."""
    sent = rows.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, now = np.zeros(len(sent.value.flat()) + 9), sent.value
        for pdf in batches:
            if not len(pdf):
                continue
            x, y, valid = np.array(pdf["x"].tolist()), pdf["y"].to_numpy(), pdf["valid"].to_numpy(bool)
            if (~valid).any():
                total[:-9] += now.gradient(x[~valid], y[~valid])
                total[-9] += (~valid).sum()
            said, ai = probability(now.logits(x)) >= CUT, y >= 0.5
            for a, of in ((-8, valid), (-4, ~valid)):
                total[a : a + 4 or None] += [(said & ai & of).sum(), (ai & of).sum(), (~said & ~ai & of).sum(), (~ai & of).sum()]
        yield pd.DataFrame({"t": [total]})

    parts = rows.mapInPandas(run, "t array<double>")
    sums = parts.select(F.posexplode("t").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("v")).collect()
    total = np.zeros(len(head.flat()) + 9)
    for r in sums:
        total[r["k"]] = r["v"]
    sent.unpersist()
    return total[:-9], int(total[-9]), total[-8:]


def balanced(confusion: np.ndarray) -> float:
    """Of validation rows, if there are any; a class without rows counts 0."""
    c = confusion[:4] if confusion[1] + confusion[3] else confusion[4:]
    return float((c[0] / c[1] if c[1] else 0.0) + (c[2] / c[3] if c[3] else 0.0)) / 2


def fit(rows: DataFrame, head: GeluHead, epochs: int = 20, rate: float = 0.01, decay: float = 0.01) -> tuple[GeluHead, float, list[float]]:
    """rows: x, y, valid (``prepared``). The best epoch's head (the first, of equals), its balanced accuracy, and every epoch's."""
    step, best, seen = AdamW(len(head.flat()), rate, decay), (head, -1.0), []
    gradient, n, _ = measured(rows, head)
    for _ in range(epochs):
        if not n:
            break
        head = head.shaped(step.step(head.flat(), gradient / n))
        gradient, n, confusion = measured(rows, head)
        seen.append(balanced(confusion))
        if seen[-1] > best[1]:
            best = (head, seen[-1])
    return best[0], max(best[1], 0.0), seen


def scored(rows: DataFrame, head: GeluHead, features: list[str | Column], out: str = "p") -> DataFrame:
    """Rows with the head's probability, as columns; null where a feature is null or NaN."""
    x = F.array(*[(F.col(f) if isinstance(f, str) else f).cast("double") for f in features])

    @F.pandas_udf("double")
    def p(xs: pd.Series) -> pd.Series:
        fit_ = np.array([v is not None and all(c is not None and c == c for c in v) for v in xs], bool)
        got = np.full(len(xs), np.nan)
        if fit_.any():
            got[fit_] = probability(head.logits(np.array(xs[fit_].tolist())))
        return pd.Series(got)

    return rows.withColumn(out, F.nanvl(p(x), F.lit(None).cast("double")))
