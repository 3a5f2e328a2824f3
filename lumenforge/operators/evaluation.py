"""Evaluation analytics over scored rows: one pass with partial aggregation each, no joins of rows with grids.

A scored row has truth ('ai' or 'real'), confidence, and optionally err. A row with
err counts as wrong whatever its confidence. Empty classes have rate 0.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .fusion import EVAL_CUT


def rate(hit: Column | str, all_: Column | str) -> Column:
    """hit / all, 0 where there is nothing."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (hit, all_))
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def confusion_columns(cut: float | Column = EVAL_CUT, err: bool = False) -> list[Column]:
    ai, hit = F.col("truth") == "ai", F.col("confidence") >= cut
    if err:
        hit = F.when(F.col("err"), ~ai).otherwise(hit)
    return [F.count_if(ai & hit).alias("tp"), F.count_if(~ai & ~hit).alias("tn"), F.count_if(~ai & hit).alias("fp"), F.count_if(ai & ~hit).alias("fn")]


def rates(df: DataFrame) -> DataFrame:
    """Add tpr, tnr and balanced accuracy to counts."""
    out = df.withColumns({"tpr": rate("tp", F.col("tp") + F.col("fn")), "tnr": rate("tn", F.col("tn") + F.col("fp"))})
    return out.withColumn("ba", (F.col("tpr") + F.col("tnr")) / 2)


def confusion(rows: DataFrame, by: list[str] | None = None, cut: float = EVAL_CUT, err: bool = False) -> DataFrame:
    return rates(rows.groupBy(*(by or [])).agg(*confusion_columns(cut, err)))


def at_points(rows: DataFrame, points: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Confusion at several operating points from one pass: counts side by side, then one row for each point."""
    wide = []
    for name, cut in points.items():
        wide.append(F.struct(F.lit(name).alias("point"), F.lit(float(cut)).alias("threshold"), *confusion_columns(cut)).alias(f"_{name}"))
    one = rows.groupBy(*(by or [])).agg(*wide)
    return rates(one.select(*(by or []), F.inline(F.array(*[F.col(f"_{n}") for n in points]))))


def summary(rows: DataFrame, by: list[str] | None = None, cut: float = EVAL_CUT, subset: str = "feed/") -> DataFrame:
    """Counts, rates, hard-case false positives, recall on a named subset (null if it is empty) and times."""
    hit, sub = F.col("confidence") >= cut, F.col("file").contains(subset)
    ms = F.col("infer_ms") + F.col("prep_ms")
    out = rows.groupBy(*(by or [])).agg(
        *confusion_columns(cut), F.count("*").alias("n"), F.count_if(F.col("hard_case") & hit).alias("hard_fp"), F.count_if(F.col("hard_case")).alias("hard_n"),
        F.count_if(sub & hit).alias("subset_tp"), F.count_if(sub).alias("subset_n"), F.coalesce(F.avg(ms), F.lit(0.0)).alias("avg_ms"), F.coalesce(F.sum(ms), F.lit(0.0)).alias("total_ms"),
    )
    return rates(out).withColumn("subset_tpr", F.try_divide(F.col("subset_tp").cast("double"), F.col("subset_n").cast("double")))


def nearest_ranks(rows: DataFrame, by: list[str], col: str, percents: tuple[int, ...]) -> DataFrame:
    """Per group the smallest value that at least so many percent of its rows don't exceed, as p<percent>_<col>; groups without values are left out.

    Rows are counted by value first. Whole units are added up to find a percentile's
    unit, and only that unit's values are gone through, so no task holds a group's values.
    """
    unit, within = W.partitionBy(*by).orderBy("_u"), W.partitionBy(*by, "_u", "_p").orderBy(col)
    counted = rows.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count("*").alias("_n")).withColumn("_u", F.floor(col))
    units = counted.groupBy(*by, "_u").agg(F.sum("_n").alias("_m"))
    units = units.withColumns({"_upto": F.sum("_m").over(unit), "_all": F.sum("_m").over(W.partitionBy(*by))})
    asked = units.withColumn("_p", F.explode(F.array(*map(F.lit, percents)))).withColumn("_r", F.floor((F.col("_p") * F.col("_all") + 99) / 100))
    asked = asked.filter((F.col("_upto") >= F.col("_r")) & (F.col("_upto") - F.col("_m") < F.col("_r"))).select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_u").alias("_unit"), "_p", (F.col("_r") - F.col("_upto") + F.col("_m")).alias("_rest"))
    same = reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"_by_{c}")), by, F.col("_u") == F.col("_unit"))
    found = counted.join(asked, same).withColumn("_at", F.sum("_n").over(within)).filter((F.col("_at") >= F.col("_rest")) & (F.col("_at") - F.col("_n") < F.col("_rest")))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("_p") == p, F.col(col))).alias(f"p{p}_{col}") for p in percents])


def timing(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """rows: total_ms, ran_second, second_ms, first_ms, has_timing."""
    mean = lambda c, when: F.coalesce(F.avg(F.when(when, F.col(c))), F.lit(0.0))
    if not by:
        return timing(rows.withColumn("_whole", F.lit(0)), ["_whole"]).drop("_whole")
    known = F.col("has_timing")
    out = rows.groupBy(*by).agg(
        F.coalesce(F.avg("total_ms"), F.lit(0.0)).alias("avg_total_ms"), F.count("*").alias("n"),
        F.count_if(known & F.col("ran_second")).alias("second_n"), mean("first_ms", known).alias("avg_first_ms"), mean("second_ms", known & F.col("ran_second")).alias("avg_second_ms"),
    )
    ranks = nearest_ranks(rows, by, "total_ms", (50, 90))
    ranks = ranks.select(*[F.col(c).alias(f"_r_{c}") for c in by], "p50_total_ms", "p90_total_ms")
    joined = out.join(ranks, reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"_r_{c}")), by, F.lit(True)), "left").drop(*[f"_r_{c}" for c in by])
    return joined.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("p50_total_ms", "p90_total_ms")})


def sigmoid(x: Column) -> Column:
    """Stable on both sides."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def sweep(rows: DataFrame, positives: Column, hard: Column, first: int = 35, last: int = 94, min_tnr: float = 0.95, min_tpr: float = 0.75) -> DataFrame:
    """Rates of ``positives`` and ``hard`` rows at thresholds first/100 to last/100 and which one is picked.

    Rows are dealt to the number of thresholds they reach, so the shuffle holds one
    count for each threshold and task; what follows is over that small table.
    """
    # a plain sum: inside a lambda function the optimizer would compute the score anew for each threshold
    reached = reduce(add, [(F.col("confidence") >= F.lit(t / 100.0)).cast("int") for t in range(first, last + 1)])
    counts = rows.groupBy(reached.alias("reached")).agg(F.count_if(positives).alias("p"), F.count_if(hard).alias("h"))
    spark = rows.sparkSession
    steps = spark.range(0, last - first + 2, 1, 1).select(F.col("id").cast("int").alias("reached"))
    w = W.orderBy(F.desc("reached"))
    every = W.partitionBy()
    full = steps.join(counts, "reached", "left").fillna(0, ["p", "h"])
    full = full.select("reached", F.sum("p").over(w).alias("p_hit"), F.sum("h").over(w).alias("h_hit"), F.sum("p").over(every).alias("p_n"), F.sum("h").over(every).alias("h_n")).filter("reached > 0")
    out = full.select(
        ((F.col("reached") - 1 + first) / F.lit(100.0)).alias("threshold"),
        rate("p_hit", "p_n").alias("tpr"),
        F.when(F.col("h_n") > 0, rate(F.col("h_n") - F.col("h_hit"), F.col("h_n"))).otherwise(1.0).alias("hard_tnr"),
    )
    out = out.withColumns({"ok": (F.col("hard_tnr") >= min_tnr) & (F.col("tpr") >= min_tpr), "gate_ba": 0.5 * (F.col("tpr") + F.col("hard_tnr"))})
    out = out.withColumn("score", 100.0 * F.col("tpr") + 20.0 * (F.col("tpr") + F.col("hard_tnr")) + 20.0 * F.col("hard_tnr"))
    best = F.row_number().over(W.orderBy(F.desc("ok"), F.desc("score"), "threshold")) == 1
    return out.withColumn("picked", best)


def ranking(summaries: DataFrame, key: str) -> DataFrame:
    """Best balanced accuracy first, faster first among equals; the key settles what is left."""
    return summaries.withColumn("rank", F.row_number().over(W.orderBy(F.desc("ba"), F.asc("avg_ms"), key)))


def balanced_head(rows: DataFrame, n: int, label: str = "truth", hard: str | None = None, pos: str = "image_id") -> DataFrame:
    """The first n/2 of each label (hard real cases first, if asked), AI before real, n in all.

    Each side is a distributed top-k: no window over the whole table.
    """
    each = max(1, n // 2)
    order = [F.col(pos)]
    ai = rows.filter(F.col(label) == "ai").orderBy(*order).limit(each)
    real = rows.filter(F.col(label) == "real").orderBy(*([F.desc(hard)] if hard else []), *order).limit(each)
    return ai.unionByName(real).orderBy(label, *order).limit(n)
