import random
import time

from pyspark.sql import functions as F

from lumenforge.operators import corpus as co
from lumenforge.plans import live as plan
from lumenforge.session import table
from lumenforge.sources import sinks
from lumenforge.streaming import live

REQUESTS = "owner long, seq long, item string, confidence double"


def requests(n=400, seed=5):
    rng = random.Random(seed)
    return [(0 if rng.random() < 0.4 else rng.randrange(4), k, rng.choice("abcdefghij"), rng.choice([None, rng.random()])) for k in range(n)]


def plain_cache(rows, most):
    caches, out = {}, []
    for o, k, item, p in rows:
        c = caches.setdefault(o, {})
        hit = item in c
        p = c[item] if hit else p
        if not hit and p is not None:
            c[item] = p
            if len(c) > most:
                del c[next(iter(c))]
        out.append((o, k, item, hit, 0.5 if p is None else p))
    return sorted(out)


def test_cache_batch_and_stream_agree(spark, tmp_path):
    rows = requests()
    got = [tuple(r)[:5] for r in live.cached_batch(spark.createDataFrame(rows, REQUESTS)).collect()]
    assert sorted(got) == plain_cache(rows, 400)
    want = plain_cache(rows, 4)
    for part in range(4):
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], REQUESTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{part}"))
        time.sleep(0.05)
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = live.cached_stream(stream, most=4).writeStream.format("memory").queryName("cached").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = [tuple(r)[:5] for r in spark.table("cached").collect()]
    assert sorted(got) == want


def test_cache_lets_go_in_a_replay(spark):
    """Few places and many items, one owner with most of the requests, a null owner; the query meets evictions."""
    rows = requests(600, 9)
    for most in (1, 4, 400):
        got = [tuple(r)[:5] for r in live.cached_replay(spark.createDataFrame(rows, REQUESTS).repartition(3), most=most).collect()]
        assert sorted(got) == plain_cache(rows, most)
    nulls = live.cached_replay(spark.createDataFrame([(None, 1, "a", 0.9), (None, 2, "a", 0.1), (None, 3, "b", None)], REQUESTS)).collect()
    assert [(r.owner, r.hit, r.label) for r in nulls] == [(None, False, "ai"), (None, True, "ai"), (None, False, "error")]
    assert live.cached_replay(spark.createDataFrame([], REQUESTS)).count() == 0


def test_query_evicts(spark, medium):
    rows = spark.sql(plan._SHARED, ev=table(spark, medium, "events"))
    free = live.cached_replay(rows, most=10**6).filter("hit").count()
    assert live.cached_replay(rows).filter("hit").count() < free


def test_queue_and_pump(spark, tmp_path):
    rows = [("a", 1, 10.0, False), ("a", 2, 950_000.0, True), ("a", 3, 990_000.0, False), ("b", 1, 500_000.0, False), ("c", 1, 940_000.0, False)]
    jobs = spark.createDataFrame(rows, "id string, seq long, priority double, bypass boolean")
    merged = {r.id: (r.priority, r.bypass) for r in live.merged_queue(jobs).collect()}
    assert merged["a"] == (990_000.0, True)
    assert [r.id for r in live.pump(live.merged_queue(jobs)).orderBy(F.desc("priority")).collect()] == ["a", "c"]
    assert [r.id for r in live.pump(live.merged_queue(jobs.filter("id = 'b'"))).collect()] == ["b"]
    jobs.write.parquet(str(tmp_path / "jobs"))
    started = []
    stream = spark.readStream.schema(jobs.schema).parquet(str(tmp_path / "jobs"))
    q = live.run_queue(stream, lambda df, n: started.extend(r.id for r in df.collect()), str(tmp_path / "c"))
    assert q.awaitTermination(120) and sorted(started) == ["a", "c"]


def test_two_phases_and_eviction(spark):
    first = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", None)], "id string, confidence double")
    refined = spark.createDataFrame([("a", 0.9), ("b", None)], "id string, confidence double")
    assert {r.id: (r.confidence, r.phase) for r in live.latest_results(first, refined).collect()} == {"a": (0.9, 2), "b": (0.2, 1)}
    tracked = spark.range(6).selectExpr("0 AS owner", "id", "id AS seen", "id % 2 = 0 AS done")
    assert sorted(r.id for r in live.evicted(tracked, soft=2, hard=4).collect()) == [0, 1, 2]


def test_upsert_append_and_splits(spark):
    base = spark.createDataFrame([(1, "x", "k"), (2, "y", "k")], "id int, a string, b string")
    new = spark.createDataFrame([(2, "z"), (3, "w")], "id int, a string")
    assert sorted(map(tuple, co.upsert(base, new, "id").collect())) == [(1, "x", "k"), (2, "z", "k"), (3, "w", None)]
    assert co.append_absent(base.select("id", "a"), new, "id").count() == 3
    rows = spark.range(203).select("id", F.when(F.col("id") < 4, "few").when(F.col("id") < 29, "some").otherwise("many").alias("label"))
    got = co.stratified(rows, "label", F.sha2(F.col("id").cast("string"), 256), "id", 0.1)
    assert {(r.label, r.split): r.n for r in got.groupBy("label", "split").agg(F.count("*").alias("n")).collect()} == {("few", "train"): 4, ("some", "val"): 2, ("some", "train"): 23, ("many", "val"): 17, ("many", "train"): 157}
    assert got.select("id").distinct().count() == 203


def test_exclusions(spark):
    rows = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    gone = spark.createDataFrame([(2,), (None,)], "id int")
    assert {r.id for r in co.exclude(rows, "id", gone).collect()} == {1, None}
    assert co.spaced_offsets(0, 400, 5) == [0, 75, 150, 225, 300]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("m1", 0.9, 1), ("m2", 0.8, 2)], "model string, ba double, rank int")
    sinks.write_suite(rows, str(tmp_path / "suite"))
    assert spark.read.json(str(tmp_path / "suite")).first()["count"] == 2
    assert sinks.markdown(rows, ["rank", "model", "ba"]).splitlines()[2] == "| 1 | m1 | 0.9000 |"
    both = sinks.merged(rows, rows.drop("rank"))
    assert both.filter("harness = 'browser' AND rank IS NULL").count() == 2
    files = spark.createDataFrame([("f", "ai", "d"), ("g", "real", "e")], "file string, label string, domain string")
    sinks.write_manifest(files, str(tmp_path / "m"))
    plan = spark.read.parquet(str(tmp_path / "m" / "rows")).filter("label = 'ai'")
    assert plan.count() == 1
