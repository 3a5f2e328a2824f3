"""A cursor feed as a Python data source, in batch and as a stream.

    spark.dataSource.register(FeedSource)
    spark.read.format("feed").option("path", folder).load()
    spark.readStream.format("feed").option("path", folder).option("maxPagesPerTrigger", 50).load()

A feed is pages numbered from 0 without a gap; the number is the cursor. Offsets are
page numbers and a landed page doesn't change, so a stream's batches can be read again
and give the same rows. Pages are planned in partitions of ``pagesPerPartition`` and
fetched there, one after another; a task holds one page.

A page that can't be fetched is tried again in its partition, up to ``attempts`` times,
after waits that double: from ``busyWait`` seconds if the feed is busy or broken (status
429, 500 and above), from ``errorWait`` if it wasn't reached. Any other status isn't tried
again. When attempts run out the task fails, with Spark's own retries behind it; with
``skipFailed`` the page gives one row that holds the error instead.

How a page is fetched is a ``Transport``, chosen by its class's place (``transport``:
``module:Class``). The one that comes with the library reads landed pages from any store
that pyarrow knows: a file ``<n>.json``, or a folder ``page=<n>`` with what Spark's writers left. ``Bundled``
reads pages that ``land_bundles`` wrote, many to a folder.

A page's images are in ``images`` (id, src), prompts in ``prompts`` (id, prompt), as JSON; lines
of a landed folder are images of their own. Images without an id are kept with a null id; a
page without images gives no rows. With ``boundedPages`` a filter on ``page`` leaves other
pages unfetched (the session must allow it: ``spark.sql.python.filterPushdown.enabled``).
"""

from __future__ import annotations

import importlib
import json
import re
import time
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

# Fixed values.
ATTEMPTS, BUSY_WAIT, ERROR_WAIT, BUNDLE = 4, 0.8, 0.5, 64
SCHEMA = "page long, place int, id string, src string, prompt string, attempts int, error string"
_PAGE = re.compile(r"(?:page=)?(\d+)(?:\.json)?$")


class Answer(Exception):
    """The feed answered, but not with a page."""

    def __init__(self, status: int) -> None:
        super().__init__(f"status {status}")
        self.status = status


class Transport:
    """How pages are found and fetched. Made in each task from the source's options."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def pages(self) -> int:
        """How many pages there are from 0 on without a gap."""
        raise NotImplementedError

    def fetch(self, page: int) -> bytes:
        raise NotImplementedError


class Landed(Transport):
    """Pages that lie in a folder."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        at = re.sub(r"^file:/(?!/)", "file:///", options["path"])
        self.store, self.root = fs.FileSystem.from_uri(at) if "://" in at else (fs.LocalFileSystem(), at)
        self.names: dict[int, fs.FileInfo] | None = None

    def _found(self) -> dict[int, fs.FileInfo]:
        if self.names is None:
            found = self.store.get_file_info(fs.FileSelector(self.root))
            self.names = {int(m[1]): f for f in found if (m := _PAGE.fullmatch(f.base_name))}
        return self.names

    def pages(self) -> int:
        n, found = 0, self._found()
        while n in found:
            n += 1
        return n

    def _bytes(self, path: str) -> bytes:
        with self.store.open_input_stream(path) as f:
            return f.read()

    def _held(self, page: int) -> fs.FileInfo | None:
        """Asked for by its usual names first: a task doesn't list the folder."""
        if self.names is None:
            for f in self.store.get_file_info([f"{self.root}/{page}.json", f"{self.root}/page={page}"]):
                if f.type != fs.FileType.NotFound:
                    return f
        return self._found().get(page)

    def fetch(self, page: int) -> bytes:
        held = self._held(page)
        if held is None:
            raise Answer(404)
        if held.type == fs.FileType.File:
            return self._bytes(held.path)
        parts = sorted(f.path for f in self.store.get_file_info(fs.FileSelector(held.path)) if f.base_name.startswith("part-"))
        images = [json.loads(line) for p in parts for line in self._bytes(p).splitlines() if line.strip()]
        return json.dumps({"images": images}).encode()


class Bundled(Landed):
    """Pages that lie ``bundle`` to a folder, as ``land_bundles`` leaves them: a file for each bundle, not for each page. A task holds one bundle."""

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.size = int(options.get("bundle", BUNDLE))
        self.open: tuple[int, dict[int, list]] = (-1, {})

    def _lines(self, folder: str) -> Iterator[dict]:
        held = self.store.get_file_info(fs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        for p in sorted(f.path for f in held if f.base_name.startswith("part-")):
            yield from (json.loads(line) for line in self._bytes(p).splitlines() if line.strip())

    def pages(self) -> int:
        runs = {r["bundle"]: r["run"] for r in self._lines("runs")}
        k = 0
        while runs.get(k) == self.size:
            k += 1
        return k * self.size + runs.get(k, 0)

    def fetch(self, page: int) -> bytes:
        k = page // self.size
        if self.open[0] != k:
            self.open = k, {r["page"]: r["images"] for r in self._lines(f"pages/bundle={k}")}
        if page not in self.open[1]:
            raise Answer(404)
        return json.dumps({"images": self.open[1][page]}).encode()


def land_bundles(rows: DataFrame, at: str, order: str, bundle: int = BUNDLE) -> None:
    """Land images (page, the column to order them by within their page, and the image's own) as lines of a page each, ``bundle`` pages to a folder, for ``Bundled``; beside them how many pages each bundle has without a gap. Rows of no page don't land."""
    fields = [c for c in rows.columns if c not in ("page", order)]
    held = rows.filter("page >= 0").withColumn("bundle", F.expr(f"page div {bundle}"))
    images = F.transform(F.sort_array(F.collect_list(F.struct(order, *fields))), lambda x: F.struct(*[x[c].alias(c) for c in fields]))
    lines = held.repartition("bundle").groupBy("bundle", "page").agg(images.alias("images"))
    lines.sortWithinPartitions("bundle", "page").write.partitionBy("bundle").json(f"{at}/pages")
    there = F.collect_set(F.expr(f"cast(page % {bundle} as int)"))
    runs = held.groupBy("bundle").agg(F.array_min(F.array_except(F.sequence(F.lit(0), F.lit(bundle)), there)).alias("run"))
    runs.coalesce(1).write.json(f"{at}/runs")


def transport(options: dict[str, str]) -> Transport:
    place = options.get("transport")
    if not place:
        return Landed(options)
    module, name = place.split(":")
    return getattr(importlib.import_module(module), name)(options)


def fetched(source: Transport, page: int, attempts: int = ATTEMPTS, busy: float = BUSY_WAIT, error: float = ERROR_WAIT, wait=time.sleep) -> tuple[bytes, int]:
    """A page and how many attempts it took."""
    for n in range(attempts):
        try:
            return source.fetch(page), n + 1
        except Answer as e:
            if n + 1 == attempts or not (e.status == 429 or e.status >= 500):
                raise
            wait(busy * 2**n)
        except OSError:
            if n + 1 == attempts:
                raise
            wait(error * 2**n)
    raise ValueError("attempts must be 1 at least")


def rows_of(page: int, body: bytes, attempts: int) -> Iterator[tuple]:
    held = json.loads(body)
    prompts = {p.get("id"): p.get("prompt") for p in held.get("prompts") or []}
    for k, image in enumerate(held.get("images") or []):
        image = image or {}
        yield page, k, image.get("id"), image.get("src"), image.get("prompt", prompts.get(image.get("promptid"))), attempts, None


class Pages(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        super().__init__((first, last))
        self.first, self.last = first, last


class _Reading:
    """What both readers share."""

    def __init__(self, options: dict[str, str]) -> None:
        self.options = {k.lower(): v for k, v in options.items()}

    def _number(self, name: str, default: float) -> float:
        return float(self.options.get(name.lower(), default))

    def _cut(self, first: int, last: int) -> list[Pages]:
        step = max(1, int(self._number("pagesPerPartition", 16)))
        return [Pages(a, min(a + step, last)) for a in range(first, last, step)]

    def _read(self, part: Pages) -> Iterator[tuple]:
        source = transport(self.options)
        limits = int(self._number("attempts", ATTEMPTS)), self._number("busyWait", BUSY_WAIT), self._number("errorWait", ERROR_WAIT)
        for page in range(part.first, part.last):
            try:
                body, n = fetched(source, page, *limits)
            except (Answer, OSError) as e:
                if self.options.get("skipfailed", "false").lower() != "true":
                    raise
                yield page, None, None, None, None, limits[0], str(e)
                continue
            yield from rows_of(page, body, n)


class FeedReader(_Reading, DataSourceReader):
    first, last = 0, 1 << 62

    def partitions(self) -> list[Pages]:
        return self._cut(self.first, min(self.last, transport(self.options).pages())) or [Pages(0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self._read(partition)


class BoundedReader(FeedReader):
    """Takes bounds of ``page`` from filters; Spark applies every filter again."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("page",):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.last = min(self.last, f.value + (not isinstance(f, LessThan)))
                if isinstance(f, In) and f.value:
                    self.first, self.last = max(self.first, min(f.value)), min(self.last, max(f.value) + 1)
            yield f


class FeedStream(_Reading, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.at = 0

    def initialOffset(self) -> dict:
        return {"page": int(self._number("startingPage", 0))}

    def latestOffset(self) -> dict:
        """Every landed page, or as many more than last time as a trigger may have."""
        most = int(self._number("maxPagesPerTrigger", 1 << 62))
        self.at = max(self.at, min(transport(self.options).pages(), max(self.at, self.initialOffset()["page"]) + most))
        return {"page": self.at}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        self.at = max(self.at, end["page"])  # a stream that starts again goes on from its log
        return self._cut(start["page"], end["page"]) or [Pages(0, 0)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self._read(partition)

    def commit(self, end: dict) -> None:
        pass


class FeedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FeedReader:
        bounded = str(self.options.get("boundedPages", "false")).lower() == "true"
        return (BoundedReader if bounded else FeedReader)(dict(self.options))

    def streamReader(self, schema) -> FeedStream:
        return FeedStream(dict(self.options))
