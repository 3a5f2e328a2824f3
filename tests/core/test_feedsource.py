"""Feeds as a data source: retries, offsets, partitions, pushed filters."""

import json
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lumenforge.functions import seeded
from lumenforge.sources import feedsource as fsrc


class Flaky(fsrc.Landed):
    """Page n fails as often as ``fails`` says, and leaves a file for each attempt."""

    def fetch(self, page):
        tries = Path(self.options["tries"])
        n = len(list(tries.glob(f"{page}-*")))
        (tries / f"{page}-{n}-{time.time_ns()}").touch()
        for p, times, what in json.loads(self.options["fails"]):
            if p == page and n < times:
                raise OSError("unreachable") if what == 0 else fsrc.Answer(what)
        return super().fetch(page)


def land(folder, pages):
    folder.mkdir(parents=True, exist_ok=True)
    for n, ids in pages.items():
        body = {"images": [{"id": i, "src": f"s/{i}", "promptid": f"p{i}"} for i in ids], "prompts": [{"id": f"p{i}", "prompt": f"a {i}"} for i in ids]}
        (folder / f"{n}.json").write_text(json.dumps(body))


@pytest.fixture
def feed(spark, tmp_path):
    spark.dataSource.register(fsrc.FeedSource)
    (tmp_path / "tries").mkdir()
    return tmp_path


def test_waits_double_and_stop():
    class Source:
        def __init__(self, *errors):
            self.errors = list(errors)

        def fetch(self, page):
            if self.errors:
                raise self.errors.pop(0)
            return b"{}"

    def waits(*errors):
        seen = []
        try:
            n = fsrc.fetched(Source(*errors), 0, wait=seen.append)[1]
        except (fsrc.Answer, OSError) as e:
            n = str(e)
        return seen, n

    assert waits() == ([], 1)
    assert waits(fsrc.Answer(500), fsrc.Answer(429)) == ([0.8, 1.6], 3)
    assert waits(OSError("gone"), OSError("gone"), fsrc.Answer(503)) == ([0.5, 1.0, 3.2], 4)
    assert waits(*[fsrc.Answer(500)] * 4) == ([0.8, 1.6, 3.2], "status 500")
    assert waits(fsrc.Answer(404)) == ([], "status 404")


def test_batch(spark, feed):
    land(feed / "in", {0: ["a", "b"], 1: [], 2: ["c", None], 3: ["d"], 5: ["far"]})
    rows = spark.read.format("feed").option("path", str(feed / "in")).option("pagesPerPartition", 2).load()
    assert rows.rdd.getNumPartitions() == 2
    assert sorted(((r.page, r.place, r.id, r.src, r.prompt) for r in rows.collect()), key=str) == sorted([(0, 0, "a", "s/a", "a a"), (0, 1, "b", "s/b", "a b"), (2, 0, "c", "s/c", "a c"), (2, 1, None, "s/None", "a None"), (3, 0, "d", "s/d", "a d")], key=str)
    land(feed / "none", {})
    assert spark.read.format("feed").option("path", str(feed / "none")).load().count() == 0


def flaky(spark, feed, fails, **options):
    read = spark.read.format("feed").options(path=str(feed / "in"), tries=str(feed / "tries"), fails=json.dumps(fails), transport=f"{__name__}:Flaky", busyWait=0.01, errorWait=0.01, pagesPerPartition=1)
    return read.options(**options).load()


def test_a_page_that_fails_twice_answers(spark, feed):
    land(feed / "in", {n: [f"i{n}"] for n in range(4)})
    got = {r.id: r.attempts for r in flaky(spark, feed, [[1, 2, 503], [2, 1, 0]]).collect()}
    assert got == {"i0": 1, "i1": 3, "i2": 2, "i3": 1}
    assert len(list((feed / "tries").glob("1-*"))) == 3


def test_a_page_that_never_answers(spark, feed):
    land(feed / "in", {n: [f"i{n}"] for n in range(3)})
    with pytest.raises(Exception, match="status 500"):
        flaky(spark, feed, [[1, 99, 500]]).collect()
    rows = flaky(spark, feed, [[1, 99, 404]], skipFailed="true").collect()
    assert {(r.page, r.id, r.error) for r in rows} == {(0, "i0", None), (1, None, "status 404"), (2, "i2", None)}


def test_filters_leave_pages_unfetched(spark, feed):
    land(feed / "in", {n: [f"i{n}"] for n in range(8)})
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert sorted(r.id for r in flaky(spark, feed, [], boundedPages="true").filter("page >= 2 AND page < 5 AND id <> 'i3'").collect()) == ["i2", "i4"]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert {p.name.split("-")[0] for p in (feed / "tries").glob("*")} == {"2", "3", "4"}


def test_stream_goes_on_from_its_offsets(spark, feed):
    land(feed / "in", {n: [f"i{n}"] for n in range(5)})

    def run(name):
        stream = spark.readStream.format("feed").options(path=str(feed / "in"), maxPagesPerTrigger=2, pagesPerPartition=1).load()
        q = stream.writeStream.format("parquet").option("path", str(feed / "out")).option("checkpointLocation", str(feed / "c")).queryName(name).trigger(processingTime="100 milliseconds").start()
        q.processAllAvailable()
        q.stop()
        return sorted(r.id for r in spark.read.parquet(str(feed / "out")).collect())

    assert run("first") == [f"i{n}" for n in range(5)]
    land(feed / "in", {n: [f"i{n}"] for n in range(5, 8)})
    assert run("second") == [f"i{n}" for n in range(8)]
    # what the log says of any batch can be read again, row for row
    offsets = [json.loads(p.read_text().splitlines()[-1])["page"] for p in sorted((feed / "c" / "offsets").glob("[0-9]*"), key=lambda p: int(p.name))]
    assert offsets == sorted(set(offsets)) and offsets[-1] == 8 and all(b - a <= 2 for a, b in zip([0, *offsets], offsets))
    reader = fsrc.FeedStream({"path": str(feed / "in"), "pagesPerPartition": "1"})
    again = [[r for part in reader.partitions({"page": 2}, {"page": 6}) for r in reader.read(part)] for _ in range(2)]
    assert again[0] == again[1] and [r[2] for r in again[0]] == ["i2", "i3", "i4", "i5"]


def test_a_page_is_fetched_without_listing_the_folder(feed):
    land(feed / "in", {n: [f"i{n}"] for n in range(4)})
    (feed / "in" / "page=4").mkdir()
    (feed / "in" / "page=4" / "part-0.json").write_text('{"id": "i4"}\n')
    (feed / "in" / "005.json").write_text('{"images": [{"id": "i5"}]}')
    source = fsrc.Landed({"path": str(feed / "in")})
    assert [json.loads(source.fetch(n))["images"][0]["id"] for n in (2, 4)] == ["i2", "i4"] and source.names is None
    assert json.loads(source.fetch(5))["images"] == [{"id": "i5"}] and source.pages() == 6


def test_bundles_hold_many_pages_and_end_at_the_gap(spark, feed):
    ids = [i for i in range(0, 60) if i // 5 != 9]
    rows = spark.createDataFrame([*[(i // 5, i, f"i{i}", None if i % 7 == 0 else "s") for i in reversed(ids)], (None, 99, "n", "n"), (-1, 98, "m", "m")], "page long, at long, id string, src string")
    fsrc.land_bundles(rows, str(feed / "in"), "at", 4)
    assert len(list((feed / "in" / "pages").rglob("part-*.json"))) == 3  # eleven pages
    options = {"path": str(feed / "in"), "transport": "lumenforge.sources.feedsource:Bundled", "bundle": "4"}
    got = spark.read.format("feed").options(**options, pagesPerPartition=3).load().collect()
    assert sorted((r.page, r.place, r.id, r.src) for r in got if r.src) + sorted((r.page, r.place, r.id) for r in got if not r.src) == [(i // 5, i % 5, f"i{i}", "s") for i in range(45) if i % 7] + [(i // 5, i % 5, f"i{i}") for i in range(45) if i % 7 == 0]
    with pytest.raises(fsrc.Answer, match="404"):
        fsrc.transport(options).fetch(9)
    fsrc.land_bundles(rows.limit(0), str(feed / "none"), "at", 4)
    assert fsrc.transport(options | {"path": str(feed / "none")}).pages() == 0


# --- seeded values --------------------------------------------------------------------------


def plain_values(seed, n):
    m, t, out = 0xFFFFFFFF, seed & 0xFFFFFFFF, []
    for _ in range(n):
        t = (t + 0x6D2B79F5) & m
        r = ((t ^ t >> 15) * (t | 1)) & m
        r ^= (r + (((r ^ r >> 7) * (r | 61)) & m)) & m
        out.append((r ^ r >> 14) / 2**32)
    return out


@pytest.mark.parametrize("seed", [0, 1, 42, 0xFFFFFFFF])
def test_values_are_those_of_the_loop(spark, seed):
    got = [r.v for r in spark.range(1000).select("id", seeded.uniform(F.lit(seed), F.col("id")).alias("v")).orderBy("id").collect()]
    assert got == plain_values(seed, 1000)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 65, 1000])
def test_shuffles_are_permutations(spark, size):
    rows = spark.range(size).select("id", seeded.shuffled_place(F.col("id"), size, 7).alias("p"), seeded.shuffled_place(F.col("id"), size, 8).alias("q"))
    rows = rows.select("*", seeded.row_at(F.col("p"), size, 7).alias("back")).collect()
    assert sorted(r.p for r in rows) == list(range(size)) and all(r.back == r.id for r in rows)
    if size >= 64:
        assert sum(r.p == r.id for r in rows) < size / 8 and sum(r.p == r.q for r in rows) < size / 8
