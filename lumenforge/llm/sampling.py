"""A bounded, class-balanced, repeatable sample of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def balanced_sample(rows: DataFrame, id_col: str, label: str, size: int) -> DataFrame:
    """At most about ``size`` rows, classes as even as their counts allow.

    A row's key is its id's hash times its class's count, so the smallest keys
    hold about equally many of each class. Only ids and labels are sorted; the
    rows themselves are read once more and kept by key. A sample of ``size`` rows
    can hold no more than ``size`` classes, so the most frequent ones are counted out.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(size).collect()}
    if not counts:
        return rows.limit(0)
    per = F.create_map(*[F.lit(x) for k, v in counts.items() for x in (k, float(v))])
    draw = (F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")).cast("double") / F.lit(2.0**64)) + F.lit(0.5)
    keyed = rows.withColumn("_key", draw * F.element_at(per, F.col(label)))
    top = keyed.filter("_key IS NOT NULL").select("_key").orderBy("_key").limit(size).agg(F.max("_key")).first()[0]
    return keyed.filter(F.col("_key") <= F.lit(top)).drop("_key").limit(2 * size)
