"""The page's queue: requeueing, slots and leases, as a stream and as a replay."""

import random
import time

from lumenforge.plans.live import page_slots
from lumenforge.streaming import slots

EVENTS = "owner long, seq long, kind string, id string, priority double, bypass boolean"
SEEN, HIDDEN = 1_000_000.0, 500_000.0


def job(seq, i, priority=SEEN, bypass=False, owner=1):
    return (owner, seq, "job", i, priority, bypass)


def say(seq, kind, i, owner=1):
    return (owner, seq, kind, i, None, None)


def play(rows, **limits):
    page = slots.Page(**limits)
    return [page.on(*r[1:]) for r in sorted(rows, key=lambda r: r[1])], page


def test_places_and_slots():
    rows = [job(k, f"i{k}") for k in range(10)]
    out, page = play(rows)
    assert [r[0] for r in out] == [f"i{k}" for k in range(8)] + [None, None]
    assert [r[1] for r in out] == [f"i{k}" for k in range(6)] + [None] * 4 and out[-1][4:] == (2, 8)
    # completions out of order: the first that waits for a slot gets it, the best that waits for a place starts
    assert page.on(10, "done", "i3", None, None)[:2] == ("i8", "i6")
    assert page.on(11, "failed", "i7", None, None)[:2] == ("i9", None)
    assert page.on(12, "done", "i0", None, None)[:2] == (None, "i8")
    assert page.on(13, "done", "i0", None, None)[4:] == (0, 7)  # nothing twice


def test_work_out_of_sight_gives_way_and_comes_back():
    out, page = play([job(0, "far", HIDDEN, True), job(1, "near"), job(2, "next"), say(3, "check", "near"), say(4, "check", "far"), say(5, "done", "near"), say(6, "done", "next")], in_flight=2, slots=1)
    assert [r[0] for r in out] == ["far", "near", None, None, "next", "far", None]
    assert [r[2] for r in out] == [None, None, None, None, "far", None, None]
    assert [r[1] for r in out] == ["far", None, None, None, "near", "next", "far"]
    assert page.flight["far"][1] and list(page.flight) == ["far"]


def test_results_are_not_asked_for_twice():
    out, _ = play([job(0, "a"), say(1, "done", "a"), job(2, "a"), job(3, "a", bypass=True), say(4, "failed", "a"), job(5, "b"), say(6, "failed", "b"), job(7, "b"), say(8, "what", "b"), say(9, "done", None)])
    assert [r[0] for r in out] == ["a", None, None, "a", None, "b", None, "b", None, None]


def test_merging_keeps_place_and_wish():
    rows = [job(k, f"w{k}") for k in range(8)] + [job(8, "a", HIDDEN, True), job(9, "b", HIDDEN), job(10, "a", HIDDEN - 1), job(11, "b", HIDDEN - 1), say(12, "done", "w0")]
    out, page = play(rows)
    assert out[-1][0] == "a" and page.flight["a"][:2] == (HIDDEN - 1, True)


def events(n=600, seed=3):
    rng = random.Random(seed)
    kinds = ["job"] * 9 + ["check"] * 3 + ["done"] * 4 + ["failed"]
    return [(0 if rng.random() < 0.4 else rng.randrange(4), k, rng.choice(kinds), f"i{rng.randrange(30)}", rng.choice([SEEN, HIDDEN]) - rng.randrange(50), rng.random() < 0.2) for k in range(n)]


def waited(spark, name, what, n, seconds=120):
    end = time.time() + seconds
    while time.time() < end and spark.table(name).filter(what).count() < n:
        time.sleep(0.5)


def test_stream_and_replay_agree(spark, tmp_path):
    rows = events()
    pages, want = {}, []
    for o, *event in rows:
        want.append((o, event[0], *pages.setdefault(o, slots.Page()).on(*event)))
    assert any(r[4] for r in want) and max(r[-1] for r in want) == 8 and any(r[3] and r[3] != r[2] for r in want)
    table = spark.createDataFrame(rows, EVENTS)
    key = lambda r: (r[1], r[0])
    assert sorted((tuple(r) for r in slots.replayed(table).collect()), key=key) == sorted(want, key=key)
    for part in range(3):
        spark.createDataFrame(rows[part * 200 : part * 200 + 200], EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{part}"))
        time.sleep(0.05)
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = slots.paged_stream(stream).writeStream.format("memory").queryName("paged").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    waited(spark, "paged", "seq IS NOT NULL", len(rows))
    q.stop()  # by itself it would go on until its leases are over
    assert sorted((tuple(r) for r in spark.table("paged").collect()), key=key) == sorted(want, key=key)


def test_leases_free_what_is_never_ended(spark, tmp_path):
    rows = [job(k, f"i{k}") for k in range(3)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(str(tmp_path / "in" / "b0"))
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in" / "*"))
    q = slots.paged_stream(stream, lease_ms=1500, in_flight=2).writeStream.format("memory").queryName("leased").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    waited(spark, "leased", "expired IS NOT NULL", 3)
    q.stop()
    got = [tuple(r) for r in spark.table("leased").collect()]
    assert {r[2] for r in got if r[1] is not None} == {"i0", "i1", None}
    freed = [r for r in got if r[5]]
    assert {r[5] for r in freed} == {"i0", "i1", "i2"} and [r[2] for r in freed if r[5] == "i0"] == ["i2"]


def test_query_meets_every_case(spark, medium):
    rows = page_slots(spark, medium).collect()
    assert max(r.in_flight for r in rows) == 8 and any(r.yielded for r in rows) and any(r.inferring and r.inferring != r.started for r in rows)


def test_no_events(spark):
    assert slots.replayed(spark.createDataFrame([], EVENTS)).count() == 0
