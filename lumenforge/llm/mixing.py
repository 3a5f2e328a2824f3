"""Mixing sources to target weights with a low-discrepancy slot schedule.

Slot j draws the golden-ratio point frac((j+1)*phi) and belongs to the source whose
interval of the cumulative target weights holds it. A source's documents, shuffled and
laid end to end, are a stream that comes round again; it is entered where the source's
first point lies within the interval. The source's target, rounded to a word, is cut into
as many equal blocks as it has slots, and its r-th slot takes block r. What a document
gives is what the join of its places with those blocks says. So every source gets its
share of any prefix to within a few blocks and its target to the word, whatever the number
of slots; order, and which documents give once more than others, are the points' choice.
A source that no point met has one slot at the end. No document gives more than
``max_epochs`` times its words, since a target is no more than that.

Null texts have size 0; documents of size 0 are never taken and stay in the
result with taken = 0. A null source is a source of its own, last in order.
Documents are shuffled by a hash of id, source and size; rows equal in all of
these are interchangeable. With no words at all every target is 0.

Scale: streams are laid out by two-level running sums, so no task holds a whole
source; documents meet blocks by (source, block), so a source with a third of all rows is
spread. The number of slots is a parameter, blocks grow with the input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, running_start

#: 2^40 / golden ratio, odd; j up to 2^22 keeps every product below 2^63.
POINT_BITS, GOLDEN, MOST_SLOTS = 40, 679535556991, 1 << 22
BUCKETS = 2048


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), repeat: float = 3.0) -> DataFrame:
    """Per source: source_size, weight and target.

    Targets share the sum of all sizes by weight; one that exceeds ``repeat``
    times its source stops there and the excess is shared among the others
    again. The end of that process is a water level: target = min(cap, level *
    weight). Sources are few against documents, so these windows are small.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", pick).withColumn("cap", F.col("source_size") * F.lit(float(repeat)))
    by_level = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_level.rowsBetween(W.unboundedPreceding, -1), by_level.rowsBetween(0, W.unboundedFollowing)
    everything = W.partitionBy()
    per = per.withColumn("total", F.sum("source_size").over(everything).cast("double"))
    # the level if exactly the sources before this one are capped rises as long as that is right, and falls from there on
    per = per.withColumn("_l", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    per = per.withColumn("level", F.max("_l").over(everything))
    return per.select("source", "source_size", "weight", F.least(F.col("cap"), F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, slots: int = 1 << 20, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, id_col: str = "doc_id", point: Callable[[Column], Column] | None = None) -> dict[str, DataFrame]:
    """Plan the mix. Returns

    * ``documents``: one row per input row, with the words that the mix takes of it;
    * ``schedule``: slot, source, block, and the words of its repeated stream from ``begin`` to ``end``;
    * ``parts``: the mix itself, which words of which document stand in which slot.

    point: a sequence in [0, 1) by number, other than the golden ratio's.
    """
    point = point or _golden
    if not 0 < slots <= MOST_SLOTS:
        raise ValueError(f"slots must be from 1 to {MOST_SLOTS}")
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"))
    base = base.withColumn("h", F.xxhash64("doc_id", "source", "size"))
    base = cut(base)
    targets = source_targets(base.select("source", "size"), weights, float(max_epochs))
    targets = cut(targets.withColumn("take", F.floor(F.col("target") + 0.5).cast("long")))
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    n_slots = -(-int(total) // max(1, -(-int(total) // slots)))

    # each source's stream: documents in hash order, laid end to end
    laid = base.withColumn("o", F.col("h").bitwiseXOR(F.lit(-(1 << 63))))
    laid = running_start(laid, "source", ["o", "doc_id"], "size", "start", F.shiftright("o", 53).cast("int"))
    laid = cut(laid.select("doc_id", "source", "size", "start"))

    # slots to sources by cumulative target weights; v is a point's place within its source's interval
    upto = W.orderBy(F.col("source").asc_nulls_last())
    edges = targets.filter("take > 0").withColumn("hi", F.sum("target").over(upto)).withColumn("lo", F.col("hi") - F.col("target"))
    whole = edges.agg(F.sum("target")).first()[0] or 0.0
    edges = edges.select("source", "source_size", "take", (F.col("lo") / F.lit(whole or 1.0)).alias("lo"), (F.col("hi") / F.lit(whole or 1.0)).alias("hi"), F.lead("target").over(upto).isNull().alias("last"))
    points = spark.range(n_slots).select(F.col("id").alias("j"), point(F.col("id") + 1).alias("u"))
    slot = points.join(F.broadcast(edges) if _few(edges) else edges, (F.col("u") >= F.col("lo")) & ((F.col("u") < F.col("hi")) | F.col("last")))
    slot = slot.select("j", "source", ((F.col("u") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("v"))
    # a source that no point met has one slot after all others
    met = slot.select(F.col("source").alias("s1")).distinct()
    missed = edges.join(met, F.col("source").eqNullSafe(F.col("s1")), "left_anti")
    slot = slot.union(missed.select(F.lit(n_slots - 1) + F.row_number().over(upto), "source", F.lit(0.0))).withColumn("one", F.lit(1))
    slot = running_start(slot, "source", ["j"], "one", "block", (F.col("j") / F.lit(max(1, n_slots // BUCKETS))).cast("int"))
    per = slot.groupBy(F.col("source").alias("s2")).agg(F.count("*").alias("n"), F.min_by("v", "j").alias("v0"))
    t = targets.join(per, F.col("source").eqNullSafe(F.col("s2")), "left").drop("s2").withColumnRenamed("source", "s3")
    enter = F.least(F.floor(F.coalesce("v0", F.lit(0.0)) * F.col("source_size")), F.col("source_size") - 1).cast("long")
    t = cut(t.select("s3", "source_size", "target", "take", F.coalesce("n", F.lit(0)).alias("n"), F.greatest(enter, F.lit(0)).alias("enter")))
    with_source = lambda df: df.join(F.broadcast(t) if _few(t) else t, F.col("source").eqNullSafe(F.col("s3"))).drop("s3")
    share = lambda r: F.col("enter") + F.floor(r.cast("decimal(10,0)") * F.col("take").cast("decimal(20,0)") / F.col("n")).cast("long")
    schedule = with_source(slot).select("j", "source", "block", share(F.col("block")).alias("begin"), share(F.col("block") + 1).alias("end"))
    schedule = cut(schedule.filter("begin < end"))

    # documents meet the blocks that they lie in, each time that the stream comes round
    again = with_source(laid.filter("size > 0")).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max_epochs))))
    again = again.withColumn("a", F.col("pass") * F.col("source_size") + F.col("start")).filter("a < enter + take AND a + size > enter")
    block_of = lambda w: f"cast(((cast({w} as decimal(20,0)) + 1) * cast(n as decimal(10,0)) - 1) div take as long)"
    cuts = again.withColumn("block", F.explode(F.sequence(F.expr(block_of("(greatest(a, enter) - enter)")), F.expr(block_of("(least(a + size, enter + take) - 1 - enter)")))))
    mine = schedule.select("j", F.col("source").alias("s4"), F.col("block").alias("b4"), "begin", "end")
    parts = cuts.join(mine, F.col("source").eqNullSafe(F.col("s4")) & (F.col("block") == F.col("b4")))
    parts = parts.select(F.col("j").alias("slot"), "doc_id", "source", "size", "start", "pass", (F.greatest("a", "begin") - F.col("a")).alias("first"), (F.least(F.col("a") + F.col("size"), "end") - F.col("a")).alias("last")).filter("first < last")

    columns = ["doc_id", "source", "size", "start"]
    given = laid.filter("size > 0").select(*columns, F.lit(0).cast("long").alias("n")).union(parts.select(*columns, (F.col("last") - F.col("first")).alias("n")))
    given = given.groupBy(*columns).agg(F.sum("n").alias("taken")).union(laid.filter("size = 0").select(*columns, F.lit(0).cast("long")))
    return {"documents": with_source(given).select("doc_id", "source", "size", "source_size", "target", "taken", "start"), "schedule": schedule, "parts": parts}


def _few(df: DataFrame, most: int = 10_000) -> bool:
    """Whether a table of sources is small enough to broadcast."""
    return df.limit(most + 1).count() <= most


def _golden(j: Column) -> Column:
    """The j-th golden-ratio point in [0, 1), by integers, so reruns agree to the bit."""
    return ((j * F.lit(GOLDEN)) % F.lit(1 << POINT_BITS)).cast("double") / F.lit(float(1 << POINT_BITS))


def op8(docs: DataFrame) -> DataFrame:
    return mix(docs)["documents"].select("doc_id", "size", "source_size", "target", "taken", "source")
