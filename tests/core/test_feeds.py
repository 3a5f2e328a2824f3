"""Feeds, artifacts, the debounced scan and the fitted head against plain loops."""

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenforge.operators import provenance as pv
from lumenforge.operators import training
from lumenforge.sources import feeds, sinks
from lumenforge.streaming import live


def test_scan_ends_at_the_first_short_page(spark):
    rng = random.Random(2)
    rows = [(s, k) for s in ("a", "b", "c", None) for k in range(60) if rng.random() < 0.97 or k < 10]
    rows += [("full", k) for k in range(30)] + [("late", k) for k in range(10, 40)]
    got = sorted(map(tuple, feeds.until_short(spark.createDataFrame(rows, "s string, k long"), "s", "k", 10).collect()), key=str)
    want = []
    for s in {s for s, _ in rows}:
        page = 0
        while True:
            here = [k for x, k in rows if x == s and k // 10 == page]
            want += [(s, k) for k in here]
            if len(here) < 10:
                break
            page += 1
    assert got == sorted(want, key=str)


def test_feed_ends_when_it_runs_dry(spark):
    rng = random.Random(3)
    pages, known = [], {"k1", "k2"}
    for feed in range(5):
        for n in range(60):
            dull = feed < 4 and 20 < n < 26 + 4 * feed
            ids = None if dull and feed % 2 else ["k1"] if dull else [rng.choice([None, "k2", f"i{rng.randint(0, 400)}"]) for _ in range(rng.randint(0, 4))]
            pages.append((feed, n, ids))
    got = {tuple(r) for r in feeds.until_dry(spark.createDataFrame(pages, "feed int, number int, ids array<string>"), spark.createDataFrame([(k,) for k in known], "id string")).collect()}
    want = set()
    for feed in range(5):
        seen, empty, stale = set(known), 0, 0
        for _, n, ids in sorted(p for p in pages if p[0] == feed):
            empty = 0 if ids else empty + 1
            if empty >= 5:
                break
            fresh = {i for i in ids or [] if i is not None} - seen
            want |= {(feed, n, i) for i in fresh}
            seen |= fresh
            stale = 0 if fresh else stale + 1
            if stale >= 8:
                break
    assert got == want


def test_artifacts_are_held_against_their_digests(spark):
    digest = lambda b: hashlib.sha256(b).hexdigest()
    files = spark.createDataFrame([("a", bytearray(b"one")), ("b", bytearray(b"two")), ("extra", bytearray(b"x"))], "name string, content binary")
    manifest = spark.createDataFrame([("a", digest(b"one")), ("b", digest(b"other")), ("c", digest(b"three"))], "name string, sha256 string")
    got = {r.name: (r.n_bytes, r.status) for r in feeds.verified(files, manifest).collect()}
    assert got == {"a": (3, "ready"), "b": (3, f"error: digest {digest(b'two')}"), "c": (None, "missing")}


def test_scans_are_debounced(spark):
    start, rng = datetime(2024, 1, 1, 23, 59, 59), random.Random(4)
    rows, at = [], {}
    for k in range(300):
        o = rng.choice([0, 0, 1, 2])
        at[o] = at.get(o, 0) + rng.choice([0, 5, 31, 32, 33, 400])
        rows.append((o, start + timedelta(milliseconds=at[o]), k))
    got = sorted(tuple(r) for r in live.debounced(spark.createDataFrame(rows, "owner int, ts timestamp, id int")).collect())
    want = []
    for o in (0, 1, 2):
        mine = [t for x, t, _ in rows if x == o]
        want += [(o, t + timedelta(milliseconds=32)) for t, n in zip(mine, [*mine[1:], None]) if n is None or n - t >= timedelta(milliseconds=32)]
    assert got == sorted(want)


def test_pending_requests_time_out(spark, tmp_path):
    """Of two requests one gets its result; the other is timed out by the timer, in a later batch."""
    schema = "id string, kind string"
    for k, rows in enumerate(([("a", "request"), ("b", "request")], [("a", "result")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = live.pending_stream(stream, deadline_ms=1500).writeStream.format("memory").queryName("pending").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            if spark.table("pending").count() >= 2 or not q.isActive:
                break
            q.awaitTermination(1)
        got = {r.id: r.outcome for r in spark.table("pending").collect()}
    finally:
        q.stop()
    assert got.get("b") == "timed-out" and got.get("a") in ("done", "timed-out")


def test_head_is_fitted_on_features(spark):
    rng = random.Random(5)
    rows = [(k, rng.gauss(2.0 if k % 2 else -2.0, 1.0), rng.random(), k % 2) for k in range(400)]
    table = spark.createDataFrame(rows, "id int, a double, b double, y int")
    train, valid = table.filter("id < 300"), table.filter("id >= 300")
    model, accuracy = training.fit_head(train, valid, ["a", "b"], "y")
    got = training.with_probability(model, valid, ["a", "b"]).collect()
    tpr = sum(r.p >= 0.65 for r in got if r.y) / sum(r.y for r in got)
    tnr = sum(r.p < 0.65 for r in got if not r.y) / sum(not r.y for r in got)
    assert accuracy == pytest.approx((tpr + tnr) / 2) and accuracy > 0.9
    assert training.fit_head(train, valid.limit(0), ["a", "b"], "y", passes=(1,))[1] > 0.5


def test_page_of_a_summary(spark):
    page = sinks.html(spark.createDataFrame([("b<", 0.5, 2), ("a", None, 1)], "name string, ba double, rank int"), ["name", "ba"], "rank", "Suite & more")
    assert page.index("<td>a</td><td>—</td>") < page.index("<td>b&lt;</td><td>0.5000</td>") and "Suite &amp; more" in page


def test_containers_are_walked_in_one_pass(spark):
    """Rows that aren't walked reach the walker without their content."""
    rows = spark.createDataFrame([(1, bytearray(b"plain midjourney")), (2, bytearray(b"\xff\xd8\xff\xe1\x00\x0cMidjourney\xff\xda"))], "id int, content binary")
    out = pv.verdict(rows)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert {r.id: r.prov for r in out.collect()} == {1: 0.98, 2: 0.98}
    assert out.filter(F.col("prov_stop")).count() == 2
