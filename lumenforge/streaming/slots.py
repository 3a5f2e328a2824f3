"""The queue of one page as state: jobs that merge, slots that are freed, work that gives way and comes back.

Events of an owner, in order of ``seq``:

* ``job`` puts an id in the queue, or renews its priority and keeps a wish to bypass results.
* ``done`` and ``failed`` end an id's work and free its place; after ``done`` the id has a
  result, and a job that doesn't bypass results is dropped when its turn comes.
* ``check`` asks whether an id that is at work should give way: it does if it is out of
  sight while a visible job waits. Its place is freed and it goes back into the queue.

After each event the queue is pumped: of the waiting jobs the one with the highest
priority starts (of equal ones the one that came first) if a place is free; jobs of ids at
work or with a result that come before it are dropped. At most ``IN_FLIGHT`` ids are at work,
the first ``SLOTS`` of them, in the order in which they started, infer; the others wait for a
slot. Any other event, and events about ids that aren't at work, change nothing.

An event gives one row: what started, what got a slot to infer, what gave way, and how many
wait and work. The stream frees, besides, the place of work whose end doesn't come within a
lease, by a timer (``expired``), so a lost worker holds no slot for good.

An owner's events are a sequence by nature, each one's effect depends on all before it; a task
streams through them with no more in memory than the owner's queue.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .live import IN_FLIGHT, VISIBLE

# Fixed value.
SLOTS = 6
OUT = "owner long, seq long, started string, inferring string, yielded string, expired string, waiting int, in_flight int"
NAMES = [c.split()[0] for c in OUT.split(", ")]


@dataclass
class Page:
    """queue: id to (priority, bypass, place); flight: id to (priority, bypass, time at which its lease ends), in order of start; finished: ids with a result."""

    queue: dict[str, tuple[float, bool, int]] = field(default_factory=dict)
    flight: dict[str, tuple[float, bool, int]] = field(default_factory=dict)
    finished: set[str] = field(default_factory=set)
    in_flight: int = IN_FLIGHT
    slots: int = SLOTS

    def _inferring(self) -> set[str]:
        return set(list(self.flight)[: self.slots])

    def _pump(self, until: int) -> str | None:
        if len(self.flight) >= self.in_flight:
            return None
        for i in sorted(self.queue, key=lambda i: (-self.queue[i][0], self.queue[i][2])):
            priority, bypass, _ = self.queue.pop(i)
            if i not in self.flight and (bypass or i not in self.finished):
                self.flight[i] = (priority, bypass, until)
                return i
        return None

    def _gives_way(self, i: str) -> bool:
        return self.flight[i][0] < VISIBLE and any(p >= VISIBLE for j, (p, _, _) in self.queue.items() if j != i)

    def on(self, seq: int, kind: str, i: str, priority: float | None, bypass: bool | None, until: int = 0) -> tuple:
        """started, inferring, yielded, expired, waiting, in_flight after an event."""
        before, yielded = self._inferring(), None
        if kind == "job":
            old = self.queue.get(i)
            self.queue[i] = (priority or 0.0, bool(bypass) or bool(old and old[1]), old[2] if old else seq)
        elif i in self.flight:
            if kind == "done":
                self.finished.add(i)
            if kind in ("done", "failed"):
                del self.flight[i]
            elif kind == "check" and self._gives_way(i):
                p, wish, _ = self.flight.pop(i)
                old, yielded = self.queue.get(i), i
                self.queue[i] = (old[0] if old else p, wish or bool(old and old[1]), old[2] if old else seq)
        return self._after(before, yielded, None, until)

    def expire(self, now: int, until: int) -> Iterator[tuple]:
        """Free the places whose lease is over, one after another."""
        for i in [i for i, (_, _, end) in self.flight.items() if end <= now]:
            before = self._inferring()
            del self.flight[i]
            yield self._after(before, None, i, until)

    def _after(self, before: set[str], yielded: str | None, expired: str | None, until: int) -> tuple:
        started = self._pump(until)
        fresh = [i for i in self._inferring() if i not in before or i == yielded]
        return started, fresh[0] if fresh else None, yielded, expired, len(self.queue), len(self.flight)


def replayed(events: DataFrame, partitions: int | None = None) -> DataFrame:
    """What the stream does, over a table (owner, seq, kind, id, priority, bypass) and without leases. seq is distinct within an owner."""
    n = partitions or int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = events.select("owner", "seq", "kind", "id", "priority", "bypass").repartition(n, "owner").sortWithinPartitions("owner", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner, page = object(), Page()
        for pdf in batches:
            out = []
            for o, *event in pdf.astype(object).where(pdf.notna(), None).itertuples(index=False, name=None):
                if o != owner:
                    owner, page = o, Page()
                out.append((o, event[0], *page.on(*event)))
            yield pd.DataFrame(out, columns=NAMES, dtype=object)

    return rows.mapInPandas(run, OUT)


class Pages(StatefulProcessor):
    """A page's queue and places as lists, results as a map that forgets them after ``keep_ms``."""

    def __init__(self, lease_ms: int, keep_ms: int, in_flight: int, slots: int) -> None:
        self.lease_ms, self.keep_ms, self.in_flight, self.slots = lease_ms, keep_ms, in_flight, slots

    def init(self, handle: StatefulProcessorHandle) -> None:
        job = "id string, priority double, bypass boolean, at long"
        self.handle = handle
        self.queue, self.flight = handle.getListState("queue", job), handle.getListState("flight", job)
        self.finished = handle.getMapState("finished", "id string", "yes boolean", self.keep_ms)

    def _load(self) -> Page:
        read = lambda state: {i: (p, b, at) for i, p, b, at in state.get()}
        return Page(read(self.queue), read(self.flight), {k[0] for k in self.finished.keys()}, self.in_flight, self.slots)

    def _store(self, page: Page, known: set[str]) -> None:
        for state, held in ((self.queue, page.queue), (self.flight, page.flight)):
            if held:
                state.put([(i, *v) for i, v in held.items()])
            else:
                state.clear()
        for i in page.finished - known:
            self.finished.updateValue((i,), (True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        page, now = self._load(), timerValues.getCurrentProcessingTimeInMs()
        known, leased = set(page.finished), now + self.lease_ms
        events = pd.concat(list(rows)).sort_values("seq")[["seq", "kind", "id", "priority", "bypass"]]
        out = [(key[0], e[0], *page.on(*e, leased)) for e in events.astype(object).where(events.notna(), None).itertuples(index=False, name=None)]
        yield from self._close(page, known, out, leased)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        page, now = self._load(), timerValues.getCurrentProcessingTimeInMs()
        out = [(key[0], None, *r) for r in page.expire(now, now + self.lease_ms)]
        yield from self._close(page, set(page.finished), out, now + self.lease_ms)

    def _close(self, page: Page, known: set[str], out: list[tuple], leased: int) -> Iterator[pd.DataFrame]:
        self._store(page, known)
        if any(end == leased for _, _, end in page.flight.values()):
            self.handle.registerTimer(leased)
        if out:
            yield pd.DataFrame(out, columns=NAMES, dtype=object)

    def close(self) -> None:
        pass


def paged_stream(events: DataFrame, lease_ms: int = 60_000, keep_ms: int = 3_600_000, in_flight: int = IN_FLIGHT, slots: int = SLOTS) -> DataFrame:
    """The same over a stream of events. State needs the RocksDB provider, which this sets for the session's next queries.

    Leases are timers: a stream with ``availableNow`` ends when the last of them is over.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return events.groupBy("owner").transformWithStateInPandas(statefulProcessor=Pages(lease_ms, keep_ms, in_flight, slots), outputStructType=OUT, outputMode="append", timeMode="ProcessingTime")
