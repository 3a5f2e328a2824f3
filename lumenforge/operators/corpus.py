"""Corpus building: first-wins dedupe, disjoint and stratified splits, upserts, set differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_by_hash(rows: DataFrame, digest: str, order: str) -> DataFrame:
    """One row for each digest, the one that comes first; combined before the shuffle."""
    rest = [c for c in rows.columns if c != digest]
    return rows.groupBy(digest).agg(F.min_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("r")).select(digest, "r.*")


def exclude(rows: DataFrame, key: str, *sets: DataFrame) -> DataFrame:
    """Rows whose key is in none of the sets (their first columns): one anti-join against their union. A null key is in no set."""
    gone = reduce(DataFrame.union, [s.select(F.col(s.columns[0]).alias("_gone")) for s in sets]).distinct()
    return rows.join(gone, rows[key] == gone["_gone"], "left_anti")


def matching_none(rows: DataFrame, col: str, needles: list[str]) -> DataFrame:
    """Rows whose text contains none of the needles, a short list that is part of the plan."""
    hit = reduce(lambda a, b: a | b, [F.col(col).contains(n) for n in needles], F.lit(False))
    return rows.filter(~F.coalesce(hit, F.lit(False)))


def to_process(models: DataFrame, registry: DataFrame, key: str, done: tuple[str, ...] = ("ok", "skipped")) -> DataFrame:
    """Models without an entry, and those whose entry is a failure."""
    known = registry.select(F.col(key).alias("_k"), F.col("status").alias("_status"))
    joined = models.join(known, models[key] == known["_k"], "left")
    return joined.filter(F.col("_status").isNull() | ~F.col("_status").isin(*done)).drop("_k", "_status")


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Shallow merge by key: a change's non-null fields win, other fields stay, new keys are added."""
    both = base.alias("b").join(changes.alias("c"), key, "full_outer")
    names = list(dict.fromkeys([*base.columns, *changes.columns]))
    pick = lambda c: F.coalesce(*[F.col(f"{side}.{c}") for side, df in (("c", changes), ("b", base)) if c in df.columns])
    return both.select(key, *[pick(c).alias(c) for c in names if c != key])


def append_absent(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """base and those rows whose key it lacks."""
    return base.unionByName(rows.join(base.select(key).distinct(), key, "left_anti"))


def stratified(rows: DataFrame, label: str, digest: Column, order: str, share: float) -> DataFrame:
    """Add ``split``: of each label's n rows the first max(1, half-even(n * share)) in digest order are 'val' if n > 4, all others 'train'.

    digest: a hex string. A row's rank is its bucket's start plus its rank within the
    bucket (the digest's first three digits), so no task holds a whole label.
    """
    keyed = rows.withColumn("_h", digest).withColumn("_b", F.substring("_h", 1, 3))
    sizes = keyed.groupBy(F.col(label).alias("_l"), F.col("_b").alias("_lb")).agg(F.count("*").alias("_n"))
    by = W.partitionBy("_l")
    total = F.sum("_n").over(by)
    sizes = sizes.withColumns({"_before": F.sum("_n").over(by.orderBy("_lb")) - F.col("_n"), "_val": F.when(total > 4, F.greatest(F.lit(1), F.bround(total * F.lit(share)).cast("int"))).otherwise(0)})
    rank = F.row_number().over(W.partitionBy(label, "_b").orderBy("_h", order))
    joined = keyed.withColumn("_r", rank).join(sizes, F.col(label).eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_lb")))
    split = F.when(F.col("_before") + F.col("_r") <= F.col("_val"), "val").otherwise("train")
    return joined.select(*rows.columns, split.alias("split"))


def ordered_distinct(rows: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """Each row's distinct matches, lower-cased, in the order in which they are first seen: key, match, pos."""
    found = rows.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(pattern), 0)).alias("pos", "match"))
    return found.groupBy(key, F.lower("match").alias("match")).agg(F.min("pos").alias("pos"))


def capped(rows: DataFrame, digest: Column, order: str, n: int) -> DataFrame:
    """n rows in the order of a hash: a repeatable random cap, as a distributed top-k."""
    return rows.withColumn("_h", digest).orderBy("_h", order).limit(n).drop("_h")


def spaced_offsets(start: int, end: int, batches: int, page: int = 100) -> list[int]:
    """Evenly spaced page offsets over [start, end)."""
    span = max(1, end - start - page)
    return [start + span * k // max(1, batches - 1) for k in range(batches)]
