"""Periodic runs of words by Crochemore's partition refinement.

Positions of a text fall into classes by the factor of l words that starts there.
The classes of l + 1 refine those of l: of a class that was split, every part but
the largest is a splitter, and the positions just before a splitter leave their
class (so a position moves at most log n times). Members of a class are linked in
order; two neighbours at distance l begin a square whose root has l words and isn't
itself a power. Squares at consecutive starts are one run, so nothing has to be
extended, compared or filtered by period afterwards.

The first ``WARM`` lengths are refined for all documents of a chunk at once, by
sorting; that leaves nothing but repeated passages. From there each document that
still has positions together is refined by smaller halves.

Words are what stands between blanks (``[^\\x20\\x09-\\x0D]+``), compared as whole
words. Null and empty texts have no runs and collapse to the empty text; rows are
independent of each other, so repeated ids, ties and clashing columns don't matter.

Scale: narrow, one pass; a task holds ``CHUNK`` words or one longer document, and a
document of n words costs O(n log n), however periodic.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, id_crc
from .mixing import word_count

WARM, CHUNK, LEAST = 4, 400_000, 12


class Refinement:
    """Classes of equal factors of one document, from those of length ``l`` on.

    ``groups``: the classes with more than one member; ``small``: the parts split off
    in the step to l, but the largest of each class, with positions that are alone.
    """

    def __init__(self, l: int, groups: list[list[int]], small: list[list[int]]) -> None:  # noqa: E741
        self.l, self.small = l, small
        self.of: dict[int, int] = {}
        self.next: dict[int, int] = {}
        self.prev: dict[int, int] = {}
        self.size: list[int] = []
        self.head: list[int] = []
        self.gaps: dict[int, list[int]] = defaultdict(list)
        for g in groups:
            self._link(g)

    def _link(self, members: list[int]) -> int:
        """A new class of these positions, in order."""
        c, of, nxt, prev, gaps = len(self.size), self.of, self.next, self.prev, self.gaps
        self.size.append(len(members))
        self.head.append(members[0])
        before = -1
        for p in members:
            of[p] = c
            prev[p] = before
            if before >= 0:
                nxt[before] = p
                gaps[p - before].append(before)
            before = p
        nxt[before] = -1
        return c

    def _unlink(self, c: int, p: int) -> None:
        a, b = self.prev[p], self.next[p]
        if a >= 0:
            self.next[a] = b
            if b >= 0:
                self.gaps[b - a].append(a)
        else:
            self.head[c] = b
        if b >= 0:
            self.prev[b] = a

    def members(self, c: int) -> list[int]:
        out, p, nxt = [], self.head[c], self.next
        while p >= 0:
            out.append(p)
            p = nxt[p]
        return out

    def step(self) -> None:
        """From length l to l + 1."""
        of, size, parts = self.of, self.size, {}
        for splitter in self.small:
            leaving: dict[int, list[int]] = {}
            for p in splitter:
                c = of.get(p - 1)
                if c is not None and size[c] > 1:
                    leaving.setdefault(c, []).append(p - 1)
            for c, out in leaving.items():
                found = parts.setdefault(c, [])
                if len(out) < size[c]:
                    for p in out:
                        self._unlink(c, p)
                    size[c] -= len(out)
                    found.append(self._link(out))
        self.l += 1
        self.small = []
        for c, new in parts.items():
            if new:
                every = [c, *new]
                largest = max(every, key=size.__getitem__)
                self.small += [self.members(x) for x in every if x != largest]

    def squares(self) -> list[int]:
        """Starts of the squares whose root has l words."""
        l, nxt = self.l, self.next  # noqa: E741
        return sorted({p for p in self.gaps.pop(l, ()) if nxt[p] == p + l})


def runs_of(starts: np.ndarray, periods: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of at least ``least`` words, from its squares in order of (period, start)."""
    if not len(starts):
        return []
    first = np.flatnonzero(np.r_[True, (starts[1:] != starts[:-1] + 1) | (periods[1:] != periods[:-1])])
    last = np.r_[first[1:] - 1, len(starts) - 1]
    q, a = periods[first], starts[first]
    length = starts[last] - a + 2 * q
    return sorted((int(x), int(n), int(p)) for x, n, p in zip(a, length, q) if n >= least)


def find(symbols: np.ndarray, sizes: list[int], least: int = LEAST, warm: int = WARM) -> list[list[tuple[int, int, int]]]:
    """The runs of each document, by start, then period; ``symbols`` are the words of all documents as small whole numbers, end to end."""
    n, ends = len(symbols), np.cumsum(sizes)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(ends, sizes) - np.arange(n)
    base = int(symbols.max(initial=0)) + 2
    squares: list[tuple[np.ndarray, np.ndarray]] = []
    at, cls = np.arange(n), doc.astype(np.int64)
    for l in range(1, warm + 1):  # noqa: E741
        there = left[at] >= l
        new = np.where(there, symbols[np.minimum(at + l - 1, n - 1)] + 1, 0)
        key = cls * base + new
        order = np.argsort(key, kind="stable")
        key, at, old = key[order], at[order], cls[order]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (key[1:] % base == 0)] if len(key) else np.zeros(0, bool)
        part = np.cumsum(fresh) - 1
        first = np.flatnonzero(fresh)
        count = np.diff(np.r_[first, len(at)])
        hit = np.flatnonzero(~fresh[1:] & (at[1:] - at[:-1] == l)) if len(at) else np.zeros(0, int)
        squares.append((at[hit], np.full(len(hit), l)))
        if l == warm:
            break
        keep = count[part] > 1
        at, cls = at[keep], part[keep]
        back = np.argsort(at, kind="stable")
        at, cls = at[back], cls[back]
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
    for x, q in squares:
        d = doc[x]
        for k, a, b in _stretches(d):
            found[k].append((x[a:b], q[a:b]))
    offset = ends - np.asarray(sizes)
    if len(at):
        # of the parts of each class the first of the largest stays behind; all others, singles too, are splitters
        parent = old[first]
        biggest = np.lexsort((-count, parent))
        stays = np.zeros(len(first), bool)
        stays[biggest[np.r_[True, parent[biggest][1:] != parent[biggest][:-1]]]] = True
        owner = doc[at[first]]
        busy = np.unique(owner[count > 1])
        mine = np.flatnonzero(np.isin(owner, busy))
        mine = mine[np.argsort(owner[mine], kind="stable")]
        for k, a, b in _stretches(owner[mine]):
            parts = [((at[first[g] : first[g] + count[g]] - offset[k]).tolist(), stays[g]) for g in mine[a:b].tolist()]
            too_late = sizes[k] - warm + 1  # no factor of that length starts there any more
            tree = Refinement(warm, [p for p, _ in parts if len(p) > 1], [[too_late], *(p for p, s in parts if not s)])
            half = sizes[k] // 2
            while tree.small and tree.l < half:
                tree.step()
                if got := tree.squares():
                    found[k].append((np.array(got) + offset[k], np.full(len(got), tree.l)))
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    for k, pairs in found.items():
        x, q = np.concatenate([a for a, _ in pairs]) - offset[k], np.concatenate([b for _, b in pairs])
        order = np.lexsort((x, q))
        out[k] = runs_of(x[order], q[order], least)
    return out


def _stretches(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each stretch of equal keys: key, begin, end."""
    if len(keys):
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        yield from zip(keys[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist())


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that stay, joined by blanks: of each run its first period."""
    if not runs:
        return b" ".join(words)
    stay = np.ones(len(words), bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return b" ".join([words[k] for k in np.flatnonzero(stay).tolist()])


def find_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id") -> DataFrame:
    """doc_id; runs: array of (start, length, period) by start, then period; collapsed: the text without repetitions. One row per input row."""

    def chunk(ids: list, texts: list[list[bytes]]) -> pd.DataFrame:
        number: defaultdict = defaultdict()
        number.default_factory = number.__len__
        symbols = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
        runs = find(symbols, [len(w) for w in texts], least)
        kept = [collapse(w, r).decode("utf-8", "surrogatepass") for w, r in zip(texts, runs)]
        return pd.DataFrame({"doc_id": pd.Series(ids, dtype=object), "runs": [[{"start": a, "length": n, "period": p} for a, n, p in r] for r in runs], "collapsed": kept})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, held, n = [], [], 0
            for i, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                words = (t or "").encode("utf-8", "surrogatepass").split()
                if held and n + len(words) > CHUNK:
                    yield chunk(ids, held)
                    ids, held, n = [], [], 0
                ids.append(None if i is None or i != i else i)
                held.append(words)
                n += len(words)
            if held:
                yield chunk(ids, held)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), "text")
    return rows.mapInPandas(giving_back(run), f"doc_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def with_loops(docs: DataFrame) -> DataFrame:
    """doc_id and text, of which every tenth by crc32 of its id goes round and round from some word on."""
    h, n = id_crc(), word_count()
    g = F.floor(h / 10)
    d = docs.select("doc_id", "text", h.alias("h"), g.alias("g"), n.alias("n"))
    looped = """array_join(transform(sequence(0L, n - 1), i -> element_at(w, cast(if(i < a, i, a + (i - a) % p) + 1 as int))), ' ')"""
    to = d.filter("h % 10 = 0 AND n > 0").withColumn("w", F.expr("regexp_extract_all(text, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)"))
    to = to.withColumn("a", F.expr("g % n")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    return d.filter("NOT (h % 10 = 0 AND n > 0)").select("doc_id", "text").union(to.select("doc_id", F.expr(looped)))


def op13(docs: DataFrame) -> DataFrame:
    found = find_runs(with_loops(docs))
    best = "array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period, r.period as p, r.start as s)))"
    line = "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    out = found.withColumn("b", F.expr(best))
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("b.s").alias("start"),
        F.col("b.length").alias("length"),
        F.col("b.p").alias("period"),
        F.expr("(1000 * b.length) div b.p").alias("exponent_milli"),
        F.sha2(F.expr(line).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
