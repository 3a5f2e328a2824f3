"""Per-owner sequences against plain loops, with a hot owner over several buckets."""

import random

from pyspark.sql import functions as F

from lumenforge.streaming import live


def test_resets_match_plain_loops(spark):
    rng = random.Random(8)
    rows = [(None if rng.random() < 0.1 else 0 if rng.random() < 0.5 else rng.randrange(3), k, rng.choice(["a", "b", None]), rng.random() < 0.2) for k in range(300)]
    got = {(r.owner, r.seq): (r.version, r.stuck) for r in live.with_resets(spark.createDataFrame(rows, "owner int, seq long, src string, fatal boolean"), width=17).collect()}
    last, version, stuck = {}, {}, {}
    for o, k, src, fatal in rows:
        same = o in last and last[o] is not None and src is not None and last[o] == src
        if not same:
            version[o], stuck[o] = version.get(o, 0) + 1, False
        assert got[o, k] == (version[o], stuck[o])
        last[o], stuck[o] = src, stuck[o] or fatal
    assert len(got) == len(rows)


def test_beside_crosses_buckets(spark):
    rows = spark.createDataFrame([("u", k, float(k)) for k in (1, 2, 30, 31, 90)], "owner string, k long, v double")
    got = {r.k: (r.before, r.after) for r in live.beside(live.beside(rows, "owner", ["k"], "v", F.floor(F.col("k") / 10), "before"), "owner", ["k"], "v", F.floor(F.col("k") / 10), "after", after=True).collect()}
    assert got == {1: (None, 2.0), 2: (1.0, 30.0), 30: (2.0, 31.0), 31: (30.0, 90.0), 90: (31.0, None)}


def test_empty_tables_give_nothing(spark):
    none = spark.createDataFrame([], "owner int, seq long, src string, fatal boolean")
    assert live.with_resets(none).count() == 0
    assert live.merged_queue(spark.createDataFrame([], "id string, seq long, priority double, bypass boolean")).count() == 0
    assert live.cached_batch(spark.createDataFrame([], "owner long, seq long, item string, confidence double")).count() == 0
