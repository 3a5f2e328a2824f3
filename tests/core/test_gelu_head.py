"""The head of two layers: gradient, steps and the best epoch against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenforge.operators import gelu_head as gh


def loss(flat, head, x, y):
    h = head.shaped(flat)
    total = 0.0
    for row, t in zip(x, y):
        z = [sum(w * c for w, c in zip(ws, row)) + b for ws, b in zip(h.w1, h.b1)]
        logit = sum(w * v * (1 + math.erf(v / math.sqrt(2))) / 2 for w, v in zip(h.w2, z)) + h.b2
        total += math.log1p(math.exp(-logit)) if t else math.log1p(math.exp(logit))
    return total


def data(n=60, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    return x, ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(n) < 0.05)).astype(float)


def test_gradient_is_that_of_finite_differences():
    x, y = data()
    head = gh.GeluHead.drawn(3, 5, 2)
    flat, eps = head.flat(), 1e-6
    want = [(loss(flat + eps * e, head, x, y) - loss(flat - eps * e, head, x, y)) / (2 * eps) for e in np.eye(len(flat))]
    assert head.gradient(x, y) == pytest.approx(want, abs=1e-5)


def table(spark, x, y, valid):
    rows = [(k, *map(float, r), float(t), bool(v)) for k, (r, t, v) in enumerate(zip(x, y, valid))]
    rows += [(900, None, 1.0, 1.0, 1.0, False), (901, float("nan"), 1.0, 1.0, 0.0, True), (902, 1.0, 1.0, 1.0, None, False)]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double, v boolean").repartition(5)


def test_sums_of_tasks_are_those_of_all_rows(spark):
    x, y = data()
    valid = np.arange(60) % 4 == 0
    head = gh.GeluHead.drawn(3, 4)
    g, n, c = gh.measured(gh.prepared(table(spark, x, y, valid), ["a", "b", "c"], "y", F.col("v")), head)
    assert n == 45 and g == pytest.approx(head.gradient(x[~valid], y[~valid]))
    said = gh.probability(head.logits(x)) >= 0.65
    for a, of in ((0, valid), (4, ~valid)):
        assert c[a : a + 4].tolist() == [(said & (y > 0) & of).sum(), ((y > 0) & of).sum(), (~said & (y < 1) & of).sum(), ((y < 1) & of).sum()]


def plain_fit(x, y, vx, vy, head, epochs, rate, decay):
    w, m, v, best, seen = head.flat(), 0.0, 0.0, (None, -1.0), []
    for t in range(1, epochs + 1):
        g = head.shaped(w).gradient(x, y) / len(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * decay * w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        said, ai = 1 / (1 + np.exp(-head.shaped(w).logits(vx))) >= 0.65, vy > 0
        seen.append((said[ai].mean() + (~said[~ai]).mean()) / 2)
        if seen[-1] > best[1]:
            best = (w, seen[-1])
    return *best, seen


def test_fit_keeps_the_best_epoch(spark):
    x, y = data(400, 3)
    valid = np.arange(400) % 4 == 0
    head = gh.GeluHead.drawn(3, 8)
    rows = gh.prepared(table(spark, x, y, valid), ["a", "b", "c"], "y", F.col("v")).cache()
    got, accuracy, seen = gh.fit(rows, head, epochs=25, rate=0.1, decay=0.02)
    w, best, want = plain_fit(x[~valid], y[~valid], x[valid], y[valid], head, 25, 0.1, 0.02)
    assert got.flat() == pytest.approx(w, rel=1e-6, abs=1e-8) and accuracy == pytest.approx(best) and seen == pytest.approx(want)
    assert accuracy > seen[0] + 0.2 and seen.index(max(seen)) > 0
    scored = gh.scored(table(spark, x, y, valid), got, ["a", "b", "c"]).collect()
    assert {r.id: r.p for r in scored if r.p is not None} == pytest.approx({**dict(enumerate(gh.probability(got.logits(x)))), 902: gh.probability(got.logits(np.ones((1, 3))))[0]})
    assert {r.id for r in scored if r.p is None} == {900, 901}


def test_nothing_to_train_on(spark):
    x, y = data()
    head = gh.GeluHead.drawn(3, 4)
    rows = gh.prepared(table(spark, x, y, np.ones(60, bool)), ["a", "b", "c"], "y", F.col("v"))
    got, accuracy, seen = gh.fit(rows, head, epochs=2)
    assert (got.flat() == head.flat()).all() and accuracy == 0.0 and seen == []
    only = gh.prepared(table(spark, x, y, np.zeros(60, bool)), ["a", "b", "c"], "y", F.col("v"))
    assert len(gh.fit(only, head, epochs=2)[2]) == 2
