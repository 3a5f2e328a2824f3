"""Exact top-k by inner product with pivot-table elimination.

Vectors become integers. With the distances to a set of pivots known, the triangle
inequality gives d(q, x) >= max_p |d(q, p) - d(x, p)|, and so an upper bound of the
inner product, (|q|^2 + |x|^2 - bound^2) / 2. Candidates of a batch lie in groups by
their nearest pivot; a group's row of the pivot table is the range of distances to
each pivot, so a query is bounded against a group at once. Each query takes the groups
in the order of its own bounds and stops when none reaches its k-th best score, which
starts from the sample that pivots are chosen from (rows of the table themselves).
The answer is exact, and ties go to the smaller id.

Whether anything is eliminated is up to the data: groups apart from each other are,
directions without structure are not (README has figures).

Queries go out in blocks of ``block_bytes`` (a bounded broadcast), each against all
rows; every task returns k rows for each query at most, and the best k of those are
kept. Rows with a null id, a null or empty vector, or null or non-finite components
take no part; vectors are compared with those of the same length. Repeated candidate
rows stay apart; query rows of one id and vector count once, and of one id with
different vectors are one query. Products are exact: in floating point as long as no
sum can reach 2^53, else in whole numbers, which saturate at the limits of a long.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import cut


def quantised(emb: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id and v, the components as integers; unfit rows go."""
    x = emb.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    fit = "vec_id IS NOT NULL AND e IS NOT NULL AND size(e) > 0 AND forall(e, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))"
    return x.filter(fit).select("vec_id", F.transform("e", lambda c: F.floor(c * F.lit(scale)).cast("double")).alias("v"))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Far apart from each other: each is the row farthest from those before it."""
    chosen = [int(np.argmax((sample**2).sum(1)))]
    near = ((sample - sample[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(np.argmax(near)))
        near = np.minimum(near, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x**2).sum(1)[:, None] + (p**2).sum(1)[None, :] - 2.0 * (x @ p.T)))


def products(q: np.ndarray, x: np.ndarray, small: bool) -> np.ndarray:
    """Inner products as whole numbers; small: no sum can reach 2^53."""
    if small:
        return (q @ x.T).astype(np.int64)
    whole = np.array([[int(c) for c in row] for row in q], dtype=object) @ np.array([[int(c) for c in row] for row in x], dtype=object).T
    return np.clip(whole, -(1 << 63) + 1, (1 << 63) - 1).astype(np.int64)


class Best:
    """The k best scores and ids of each query, best first; of equal scores the smaller id."""

    NONE = -(1 << 63)

    def __init__(self, n: int, k: int) -> None:
        self.score, self.id = np.full((n, k), self.NONE, np.int64), np.full((n, k), (1 << 63) - 1, np.int64)

    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        n, k = self.score.shape
        touched = np.unique(row)
        rows = np.concatenate([np.repeat(touched, k), row])
        every = np.concatenate([self.score[touched].ravel(), score])
        id_ = np.concatenate([self.id[touched].ravel(), ids])
        order = np.lexsort((id_, ~every, rows))
        rows, at = rows[order], np.arange(len(order))
        place = at - np.maximum.accumulate(np.where(np.concatenate([[True], rows[1:] != rows[:-1]]), at, 0))
        keep = place < k
        self.score[rows[keep], place[keep]], self.id[rows[keep], place[keep]] = every[order][keep], id_[order][keep]


class Queries:
    """A block's queries of one length, with their row of the pivot table and a score that their k-th best reaches for sure."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, pivots: int, k: int) -> None:
        self.ids, self.q, self.k = ids, q, k
        self.pivots = choose_pivots(sample, pivots) if len(sample) else np.zeros((0, q.shape[1]))
        self.table, self.norm = distances(q, self.pivots), (q**2).sum(1)
        self.top = float(np.abs(q).max(initial=0))
        self.floor = np.full(len(q), Best.NONE, np.int64)
        small = self.top * float(np.abs(sample).max(initial=0)) * q.shape[1] < 2**53
        for a in range(0, len(q), 1024):
            s = products(q[a : a + 1024], sample, small)
            s[ids[a : a + 1024, None] == sample_ids[None]] = Best.NONE
            if s.shape[1] >= k:
                self.floor[a : a + 1024] = np.partition(s, -k, axis=1)[:, -k]


def search(qs: Queries, x: np.ndarray, x_id: np.ndarray, best: Best) -> int:
    """Bring the best up to date with the candidates x; how many pairs were evaluated."""
    small = qs.top * float(np.abs(x).max(initial=0)) * x.shape[1] < 2**53
    table, norm = distances(x, qs.pivots), (x**2).sum(1)
    nearest = table.argmin(1) if len(qs.pivots) else np.zeros(len(x), int)
    order = np.argsort(nearest, kind="stable")
    x, x_id, table, norm = x[order], x_id[order], table[order], norm[order]
    start = np.flatnonzero(np.concatenate([[True], np.diff(nearest[order]) > 0]))
    stop = np.append(start[1:], len(x))
    low, high, widest = (np.minimum.reduceat(table, start), np.maximum.reduceat(table, start), np.maximum.reduceat(norm, start))
    bound = np.zeros((len(qs.q), len(start)))
    for p in range(len(qs.pivots)):
        d = qs.table[:, p, None]
        np.maximum(bound, np.maximum(low[None, :, p] - d, d - high[None, :, p]), out=bound)
    upper = (qs.norm[:, None] + widest[None] - bound**2) / 2.0
    upper += 1e-9 * (1.0 + qs.norm[:, None] + widest[None])  # what rounding may take
    turn, evaluated = np.argsort(-upper, axis=1, kind="stable"), 0
    for r in range(len(start)):
        group = turn[:, r]
        least = np.maximum(best.least(), qs.floor)
        alive = np.flatnonzero(upper[np.arange(len(group)), group] >= least)
        if not len(alive):
            break
        alive = alive[np.argsort(group[alive], kind="stable")]
        cuts = np.flatnonzero(np.concatenate([[True], np.diff(group[alive]) > 0, [True]]))
        found = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            rows, g = alive[a:b], group[alive[a]]
            s = products(qs.q[rows], x[start[g] : stop[g]], small)
            evaluated += s.size
            i, j = np.nonzero(s >= least[rows, None])
            found.append((rows[i], x_id[start[g] + j], s[i, j]))
        row, ids, score = (np.concatenate(c) for c in zip(*found))
        other = qs.ids[row] != ids
        if other.any():
            best.add(row[other], ids[other], score[other])
    return evaluated


FOUND = "query_id long, vec_id long, score long"


def scan(vectors: DataFrame, sent, k: int, batch: int = 8192, block: int = 4096) -> DataFrame:
    """Each task's k best rows for each query. sent: Queries by length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = [(n, a, part) for n, qs in sent.value.items() for a in range(0, len(qs.ids), block) for part in [part_of(qs, a, a + block)]]
        best = {(n, a): Best(len(part.ids), k) for n, a, part in blocks}

        def close(n: int, rows: list, ids: list) -> None:
            x, x_id = np.array(rows, np.float64), np.array(ids, np.int64)
            for m, a, part in blocks:
                if m == n:
                    search(part, x, x_id, best[n, a])

        held: dict[int, tuple[list, list]] = {n: ([], []) for n in sent.value}
        for pdf in batches:
            for i, v in zip(pdf["vec_id"].tolist(), pdf["v"]):
                if len(v) in held:
                    rows, ids = held[len(v)]
                    rows.append(v)
                    ids.append(i)
                    if len(ids) == batch:
                        close(len(v), rows, ids)
                        held[len(v)] = ([], [])
        for n, (rows, ids) in held.items():
            if ids:
                close(n, rows, ids)
        for n, a, part in blocks:
            row, col = np.nonzero(best[n, a].id < (1 << 63) - 1)
            yield pd.DataFrame({"query_id": part.ids[row], "vec_id": best[n, a].id[row, col], "score": best[n, a].score[row, col]})

    return vectors.mapInPandas(run, FOUND)


def part_of(qs: Queries, a: int, b: int) -> Queries:
    out = copy.copy(qs)
    for name in ("ids", "q", "table", "norm", "floor"):
        setattr(out, name, getattr(qs, name)[a:b])
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, pivots: int = 32, sample: int = 2000, block_bytes: int = 1 << 24) -> DataFrame:
    """The k best rows of ``vectors`` for each row of ``queries`` (both vec_id, v), but the query's own id. Pivots come from ``sample`` rows of each length, by their ids' hashes."""
    spark = vectors.sparkSession
    queries = queries.dropDuplicates(["vec_id", "v"])
    size = queries.agg(F.sum(F.size("v") * 8 + 64)).first()[0] or 0
    n = -(-size // block_bytes)
    numbered = queries.withColumn("b", F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, n))).cast("int"))
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect() if n else []
    parts = []
    for b in range(n):
        got, by = numbered.filter(F.col("b") == b).collect(), {}
        for length in sorted({len(r["v"]) for r in got}):
            mine, seen = [r for r in got if len(r["v"]) == length], [r for r in rows if len(r["v"]) == length]
            ids, s_ids = (np.array([r["vec_id"] for r in x], np.int64) for x in (mine, seen))
            q, s = (np.array([r["v"] for r in x], np.float64).reshape(-1, length) for x in (mine, seen))
            by[length] = Queries(ids, q, s, s_ids, pivots, k)
        if by:
            found = scan(vectors, spark.sparkContext.broadcast(by), k)
            parts.append(cut(found) if n > 1 else found)
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return reduce(DataFrame.union, parts).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9(emb: DataFrame) -> DataFrame:
    """Queries: rows whose vec_id is divisible by 50."""
    v = quantised(emb)
    return top_k(v, v.filter(F.col("vec_id") % 50 == 0))
