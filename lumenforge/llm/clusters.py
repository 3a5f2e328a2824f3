"""Clusters around centroids, with annulus search.

|d(x, 0) - d(c, 0)| <= d(x, c): a centroid nearer to x than u has a norm from |x| - u
to |x| + u. Centroids are sorted by norm. A vector's upper bound u is its distance to
the nearest of about 2 sqrt(k) probes, the centroids with the closest norms; two binary
searches give the centroids in its annulus, and exactly these are compared. (A bound
from the round before would have to be stored and read again with every vector.) The annulus is widened by what rounding may take, so a centroid
on its edge is in it and ties are seen: of equal distances the smaller number counts.

Components are whole numbers, and distances, sums and floors of means are exact: in
floating point as long as nothing can reach 2^53, else in whole numbers. Components
and distances saturate at the limits of a long.

Kept are vectors of exactly ``dims`` components, none null or non-finite; others have
no row in the result. A null id is no start; ids may repeat (rows of one id are
ordered by their components, if both would start). With fewer vectors than ``k`` there
are fewer centroids, with none an empty result. Extra columns play no part.

Scale: each round is one pass over the input without a shuffle of vectors. A task adds
up its vectors by cluster, so what is exchanged is at most k rows a task, however hot a
cluster; centroids (k x dims numbers, parameters) are all that the driver holds.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

K, DIMS, ROUNDS, SCALE = 40, 64, 5, 256
TOP = (1 << 63) - 1
LOW = 1 << 32


def whole(emb: DataFrame, dims: int = DIMS, scale: float = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and v, the components as longs; unfit rows go."""
    x = emb.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e"))
    x = x.filter(f"e IS NOT NULL AND size(e) = {int(dims)} AND forall(e, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))")
    edge = float(1 << 63)
    scaled = lambda c: F.floor(F.least(F.greatest(c * F.lit(float(scale)), F.lit(-edge)), F.lit(float(np.nextafter(edge, 0)))))
    return x.select("vec_id", F.transform("e", lambda c: scaled(c).cast("long")).alias("v"))


def starts(vectors: DataFrame, k: int = K, salt: str = "2:") -> np.ndarray:
    """The vectors whose ids' hashes are smallest, in that order."""
    h = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    return np.array([r["v"] for r in vectors.filter("vec_id IS NOT NULL").select(h.alias("h"), "v").orderBy("h", "v").limit(k).collect()], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all rows of c, exact; more than a long holds counts as its limit."""
    reach = float(np.abs(x.astype(np.float64)).max(initial=0)) + float(np.abs(c.astype(np.float64)).max(initial=0))
    if reach**2 * x.shape[1] < 2**52:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2.0 * (a @ b.T)).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j in range(len(c)):
        gap = x.astype(object) - c[j].astype(object)
        out[:, j] = [min(TOP, int(s)) for s in (gap * gap).sum(1)]
    return out


class Annulus:
    """Centroids sorted by norm; ``probes`` with norms close to a vector's bound its distance to the nearest one."""

    def __init__(self, centroids: np.ndarray) -> None:
        norm = np.sqrt((centroids.astype(np.float64) ** 2).sum(1))
        self.number = np.argsort(norm, kind="stable")
        self.c, self.norm = centroids[self.number], norm[self.number]
        self.probes = min(len(centroids), 2 * math.ceil(math.sqrt(len(centroids))))

    def _compare(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least squared distance to the centroids from place ``low`` to ``high``, and the smallest number among those that have it."""
        k = len(self.c)
        best, number = np.full(len(x), TOP, np.int64), np.full(len(x), k, np.int64)
        order = np.lexsort((high, low))  # alike ranges stand together, so that a block's ranges make one product
        for a in range(0, len(x), 512):
            at = order[a : a + 512]
            place = np.arange(int(low[at].min()), int(high[at].max()))
            inside = (place >= low[at, None]) & (place < high[at, None])
            d = np.where(inside, squared(x[at], self.c[place]), TOP)
            best[at] = d.min(1)
            number[at] = np.where(inside & (d == best[at, None]), self.number[None, place], k).min(1)
        return best, number

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number and squared distance of each vector's nearest centroid, and how many distances its annuli and probes ask for."""
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
        first = np.clip(np.searchsorted(self.norm, norm) - self.probes // 2, 0, len(self.c) - self.probes)
        bound, _ = self._compare(x, first, first + self.probes)
        u = np.where(bound < TOP, np.sqrt(bound.astype(np.float64)), np.inf)
        slack = 1e-9 * (1.0 + norm + self.norm[-1])
        low, high = np.searchsorted(self.norm, norm - u - slack, "left"), np.searchsorted(self.norm, norm + u + slack, "right")
        best, number = self._compare(x, low, high)
        return number, best, int((high - low).sum()) + len(x) * self.probes


def _rows(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["v"].tolist(), np.int64)


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floors of their vectors' means; empty ones stay."""
    spark, (k, dims) = vectors.sparkSession, centroids.shape
    sent = spark.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = Annulus(sent.value)
        n, high, low = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros((k, dims), np.int64)
        for pdf in batches:
            x = _rows(pdf)
            number, _, _ = search.nearest(x)
            order = np.argsort(number, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(number[order]) > 0])
            who, x = number[order][first], x[order]
            n[who] += np.diff(np.r_[first, len(x)])
            # in two halves, so that no sum leaves the range of a long
            high[who] += np.add.reduceat(x >> 32, first)
            low[who] += np.add.reduceat(x & (LOW - 1), first)
        some = np.flatnonzero(n)
        if len(some):
            yield pd.DataFrame({"cluster": some.astype(np.int32), "n": n[some], "high": list(high[some]), "low": list(low[some])})

    part = vectors.select("v").mapInPandas(run, "cluster int, n long, high array<long>, low array<long>")
    by_place = part.select("cluster", "n", F.posexplode(F.arrays_zip("high", "low")).alias("i", "s"))
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = by_place.groupBy("cluster", "i").agg(F.sum("n").alias("n"), total("s.high").alias("high"), total("s.low").alias("low"))
    out = centroids.copy()
    for r in sums.collect():  # k x dims rows
        out[r["cluster"], r["i"]] = (int(r["high"]) * LOW + int(r["low"])) // r["n"]
    sent.unpersist()
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance (squared) of every vector."""
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = Annulus(sent.value)
        for pdf in batches:
            if len(pdf):
                number, distance, _ = search.nearest(_rows(pdf))
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "cluster": number.astype(np.int32), "distance": distance})

    return vectors.mapInPandas(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame]:
    """The centroids after ``rounds`` and every vector's cluster and distance; ``vectors`` has vec_id and v."""
    centroids = starts(vectors, k)
    if not len(centroids):
        return centroids, vectors.filter("false").select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    for _ in range(rounds):
        centroids = moved(vectors, centroids)
    return centroids, assigned(vectors, centroids)


def op11(emb: DataFrame) -> DataFrame:
    spark = emb.sparkSession
    centroids, found = cluster(whole(emb))
    found = cut(found)
    digest = [(j, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids.tolist())]
    per = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    sums = {r["cluster"]: int(r["s"]) for r in per.collect()}  # a row for each centroid
    whole_sum = min(TOP, sum(sums.values()))
    side = spark.createDataFrame([(j, min(TOP, sums.get(j, 0)), whole_sum, h) for j, h in digest], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
