"""The live flow as Structured Streaming: a queue that merges and pumps, a bounded result cache, timers.

All times are processing times and all states are bounded: a key holds at most
``CACHE`` results. Events of a key come in the order of ``seq``.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed values.
CACHE, IN_FLIGHT, VISIBLE, PENDING_MS, SOFT_TRACKED, HARD_TRACKED, WAIT_MS, REDISCOVER_MS = 400, 8, 900_000.0, 2500, 500, 1000, 32, 1000
OUT = "owner long, seq long, item string, hit boolean, confidence double, label string"


def merged_queue(jobs: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Jobs of the same id merge: the latest priority, bypass if any asked for it. Combined before the shuffle."""
    return jobs.groupBy(key).agg(F.max_by("priority", seq).alias("priority"), F.bool_or("bypass").alias("bypass"), F.max(seq).alias(seq))


def pump(queue: DataFrame, slots: int = IN_FLIGHT, key: str = "id") -> DataFrame:
    """The jobs to start: highest priority first; while visible ones wait, the others stay. A distributed top-k."""
    top = queue.orderBy(F.desc("priority"), key).limit(slots)
    best = F.max("priority").over(W.partitionBy())  # of at most ``slots`` rows
    return top.withColumn("_best", best).filter((F.col("_best") < VISIBLE) | (F.col("priority") >= VISIBLE)).drop("_best")


def run_queue(jobs: DataFrame, start: Callable[[DataFrame, int], None], checkpoint: str, **trigger: object) -> StreamingQuery:
    """Each micro-batch is merged and pumped; ``start`` gets what begins and is asked to be idempotent by batch id."""

    def one(batch: DataFrame, n: int) -> None:
        start(pump(merged_queue(batch)), n)

    return jobs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def label_of(p: float, ai: float, real: float) -> str:
    return "ai" if p >= ai else "real" if p <= real else "uncertain"


def cache_step(cache: OrderedDict, rows: list[tuple], ai: float, real: float, most: int) -> list[tuple]:
    """rows: owner, seq, item, confidence (null: the analysis failed). First in, first out: a repeated item keeps its place, errors aren't kept, hits are labelled at the current thresholds."""
    out = []
    for owner, seq, item, p in rows:
        hit = item in cache
        if hit:
            p = cache[item]
        elif p is not None and p == p:
            cache[item] = p
            if len(cache) > most:
                cache.popitem(last=False)
        known = p is not None and p == p
        out.append((owner, seq, item, hit, p if known else 0.5, label_of(p, ai, real) if known else "error"))
    return out


_NAMES = ["owner", "seq", "item", "hit", "confidence", "label"]


def cached_stream(requests: DataFrame, ai: float = 0.6951, real: float = 0.4099, most: int = CACHE) -> DataFrame:
    """requests: a stream of owner, seq, item, confidence. State: each owner's cache, as two arrays in order of arrival."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, scores = state.get if state.exists else ([], [])
        cache = OrderedDict(zip(items, scores))
        rows = sorted(r for pdf in batches for r in pdf[["owner", "seq", "item", "confidence"]].itertuples(index=False, name=None))
        out = cache_step(cache, rows, ai, real, most)
        state.update((list(cache), list(cache.values())))
        yield pd.DataFrame(out, columns=_NAMES)

    return requests.groupBy("owner").applyInPandasWithState(step, OUT, "items array<string>, scores array<double>", "append", GroupStateTimeout.NoTimeout)


def cached_batch(requests: DataFrame, ai: float = 0.6951, real: float = 0.4099) -> DataFrame:
    """The same over a table, for owners that never have more items than a cache holds (a table has no reason to forget; letting go is the stream's matter): a request is answered by the first result that its item had before it. Combined before the shuffle, so an owner's rows meet in no task."""
    known = F.col("confidence").isNotNull() & ~F.isnan("confidence")
    first = requests.filter(known).groupBy(F.col("owner").alias("_o"), F.col("item").alias("_i")).agg(F.min(F.struct("seq", "confidence")).alias("_first"))
    joined = requests.join(first, F.col("owner").eqNullSafe(F.col("_o")) & F.col("item").eqNullSafe(F.col("_i")), "left")
    hit = F.coalesce(F.col("seq") > F.col("_first.seq"), F.lit(False))
    p = F.when(hit, F.col("_first.confidence")).when(known, F.col("confidence"))
    label = F.when(p.isNull(), "error").when(p >= ai, "ai").when(p <= real, "real").otherwise("uncertain")
    return joined.select("owner", "seq", "item", hit.alias("hit"), F.coalesce(p, F.lit(0.5)).alias("confidence"), label.alias("label"))


def cached_replay(requests: DataFrame, ai: float = 0.6951, real: float = 0.4099, most: int = CACHE) -> DataFrame:
    """What ``cached_stream`` does, over a table and with its limit: the oldest result goes when there are more than ``most``, and comes back when it is asked for again.

    Whether a request is answered depends on all before it, so an owner's requests are a
    sequence; a task streams through them and holds one cache and a batch.
    """
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = requests.select("owner", "seq", "item", "confidence").repartition(n, "owner").sortWithinPartitions("owner", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, cache = object(), OrderedDict()
        for pdf in batches:
            out = []
            for o, part in pdf.groupby("owner", sort=False, dropna=False):
                o = None if o != o else o
                if o != owner:
                    owner, cache = o, OrderedDict()
                out += cache_step(cache, list(part.itertuples(index=False, name=None)), ai, real, most)
            yield pd.DataFrame(out, columns=_NAMES)

    return rows.mapInPandas(run, OUT)


def pending_stream(events: DataFrame, deadline_ms: int = PENDING_MS) -> DataFrame:
    """events: a stream of id, kind ('request' or 'result'). An id whose result doesn't come within the deadline is 'timed-out', by a processing-time timer."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"id": [key[0]], "outcome": ["timed-out"]})
            return
        kinds = {k for pdf in batches for k in pdf["kind"]}
        if "result" in kinds:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"id": [key[0]], "outcome": ["done"]})
        else:
            state.update((True,))
            state.setTimeoutDuration(deadline_ms)

    return events.groupBy("id").applyInPandasWithState(step, "id string, outcome string", "waiting boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def latest_results(first: DataFrame, refined: DataFrame, key: str = "id") -> DataFrame:
    """Two phases of scoring: of each id the last phase that gave a result; a refinement that failed leaves the first."""
    both = first.withColumn("phase", F.lit(1)).unionByName(refined.withColumn("phase", F.lit(2)))
    return both.filter("confidence IS NOT NULL").groupBy(key).agg(F.max_by("confidence", "phase").alias("confidence"), F.max("phase").alias("phase"))


def fresh_results(results: DataFrame, owner: str = "owner", seq: str = "seq", src: str = "src") -> DataFrame:
    """Results whose source is still the owner's current one; those of a source that changed on the way are dropped."""
    now = results.groupBy(F.col(owner).alias("_o")).agg(F.max_by(src, seq).alias("_now"))
    return results.join(now, (F.col(owner) == F.col("_o")) & (F.col(src) == F.col("_now"))).drop("_o", "_now")


def beside(rows: DataFrame, owner: str, order: list[str], value: str, bucket: Column, out: str, after: bool = False) -> DataFrame:
    """Add the value of an owner's row before (or after) each row.

    bucket: a column that never falls in the order. Windows cover one bucket of one
    owner, so an owner with a third of all rows is split; the rows at the edges take
    their value from the table of buckets' ends.
    """
    held = rows.withColumn("_b", bucket)
    inner = W.partitionBy(owner, "_b").orderBy(*order)
    near, edge = (F.lead, F.min_by) if after else (F.lag, F.max_by)
    ends = held.groupBy(F.col(owner).alias("_o"), F.col("_b").alias("_eb")).agg(edge(value, F.struct(*order)).alias("_end"))
    ends = ends.withColumn("_far", near("_end").over(W.partitionBy("_o").orderBy("_eb"))).drop("_end")
    last = F.row_number().over(W.partitionBy(owner, "_b").orderBy(*[F.desc(c) if after else F.asc(c) for c in order])) == 1
    held = held.withColumns({"_near": near(value).over(inner), "_edge": last})
    joined = held.join(ends, F.col(owner).eqNullSafe(F.col("_o")) & F.col("_b").eqNullSafe(F.col("_eb")))
    return joined.withColumn(out, F.when(F.col("_edge"), F.col("_far")).otherwise(F.col("_near"))).drop("_b", "_o", "_eb", "_far", "_near", "_edge")


def debounced(events: DataFrame, owner: str = "owner", at: str = "ts", order: str = "id", wait_ms: int = WAIT_MS) -> DataFrame:
    """owner and fired: a scan starts ``wait_ms`` after the last of an owner's events that follow each other within that time. (As a trigger, ``run_queue`` takes the same interval.)"""
    out = beside(events.select(owner, at, order), owner, [at, order], at, F.date_trunc("day", F.col(at)), "_next", after=True)
    gap = F.timestamp_diff("MICROSECOND", F.col(at), F.col("_next"))
    last = out.filter(F.coalesce(gap >= wait_ms * 1000, F.lit(True)))
    return last.select(owner, (F.col(at) + F.make_dt_interval(secs=F.lit(wait_ms / 1000))).alias("fired"))


def rediscovered(events: DataFrame, owner: str = "owner", at: str = "ts", every_ms: int = REDISCOVER_MS) -> DataFrame:
    """owner, tick: the timer's next tick, at which an owner's events of the interval before are seen, and how many there were."""
    tick = F.window(at, f"{every_ms} milliseconds")["end"].alias("tick")
    return events.groupBy(owner, tick).agg(F.count("*").alias("n"))


def with_resets(events: DataFrame, owner: str = "owner", seq: str = "seq", src: str = "src", fatal: str = "fatal", width: int = 1 << 16) -> DataFrame:
    """Number each owner's sources as they change (``version``), and hold an error back from trying again as long as the source stays (``stuck``).

    seq: distinct within an owner. Counts of changes are added up by buckets of ``width`` first.
    """
    bucket = F.floor(F.col(seq) / F.lit(width))
    out = beside(events, owner, [seq], src, bucket, "_before").withColumn("_change", F.coalesce((F.col("_before") != F.col(src)).cast("int"), F.lit(1))).withColumn("_b", bucket)
    sums = out.groupBy(F.col(owner).alias("_o"), F.col("_b").alias("_sb")).agg(F.sum("_change").alias("_s"))
    sums = sums.withColumn("_base", F.sum("_s").over(W.partitionBy("_o").orderBy("_sb")) - F.col("_s")).drop("_s")
    inside = F.sum("_change").over(W.partitionBy(owner, "_b").orderBy(seq))
    out = out.withColumn("_in", inside).join(sums, F.col(owner).eqNullSafe(F.col("_o")) & (F.col("_b") == F.col("_sb"))).withColumn("version", F.col("_base") + F.col("_in"))
    out = out.drop("_before", "_change", "_b", "_o", "_sb", "_base", "_in")
    first = out.filter(F.col(fatal)).groupBy(F.col(owner).alias("_o"), F.col("version").alias("_v")).agg(F.min(seq).alias("_fatal"))
    joined = out.join(first, F.col(owner).eqNullSafe(F.col("_o")) & (F.col("version") == F.col("_v")), "left")
    return joined.withColumn("stuck", F.coalesce(F.col(seq) > F.col("_fatal"), F.lit(False))).drop("_o", "_v", "_fatal")


def evicted(tracked: DataFrame, owner: str = "owner", seen: str = "seen", soft: int = SOFT_TRACKED, hard: int = HARD_TRACKED) -> DataFrame:
    """Entries to let go: finished ones beyond the ``soft`` most recent of an owner, any beyond ``hard``.

    Only an owner's ``hard`` most recent entries are ranked, which tasks cut to that
    number before the shuffle; the others are held against the two entries at the limits.
    """
    rank = F.row_number().over(W.partitionBy(owner).orderBy(F.desc(seen), "id"))
    recent = tracked.select(F.col(owner), F.col(seen), F.col("id")).withColumn("rank", rank).filter(F.col("rank") <= hard)
    last = lambda n: F.max(F.when(F.col("rank") == n, F.struct(seen, "id")))
    limits = recent.groupBy(F.col(owner).alias("_o")).agg(last(soft).alias("_soft"), last(hard).alias("_hard"))
    beyond = lambda c: F.coalesce((F.col(seen) < F.col(f"{c}.{seen}")) | ((F.col(seen) == F.col(f"{c}.{seen}")) & (F.col("id") > F.col(f"{c}.id"))), F.lit(False))
    return tracked.join(limits, F.col(owner) == F.col("_o")).filter(beyond("_hard") | (beyond("_soft") & F.col("done"))).drop("_o", "_soft", "_hard")
