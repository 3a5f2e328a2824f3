"""Benchmark decontamination with an FM-index for each shard of the corpus.

A shard is a run of neighbouring documents within a task, as word numbers.
Words that no benchmark item has can match nothing, so they become breaks, and
stretches shorter than the shortest phrase are left out; this changes no match.
Over what stays a suffix array is built by prefix doubling, from it the
Burrows-Wheeler transform as a wavelet matrix with block ranks. All phrases are
searched backward at once; the rows that are left are located by walking to
sampled suffix positions, and the occurrences merge into removal spans.

Phrases: every 10 consecutive words of an item; an item of fewer words, but not
none, is one phrase. Null texts have no words. An item with a null id still hits
but is not listed. Items with the same id count once. The benchmark goes out in
blocks of about ``block_words`` words (at most one item more), one pass over the corpus
for each, written before the next; so a worker holds one block's phrases, some 50 bytes
a word, whatever the benchmark's size. Narrow: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

WINDOW, SAMPLE = 10, 8
#: Bytes that belong to words, after A-Z are made small: digits, letters, and all bytes of characters beyond ASCII.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Phrases:
    """The phrases of a block of benchmark items, as word numbers from 2 on (0 ends a shard, 1 is a break).

    In arrays: 4 bytes for each word of each different phrase, 8 for each phrase of an
    item, and the block's different words once.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        self.number: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items if i is not None})
        place = {i: k for k, i in enumerate(self.names)}
        rows: dict[int, list[np.ndarray]] = {}
        owner: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            ids = np.array([self.number.setdefault(w, len(self.number) + 2) for w in words(text)], np.int32)
            if len(ids):
                part = np.lib.stride_tricks.sliding_window_view(ids, min(window, len(ids)))
                rows.setdefault(part.shape[1], []).append(part)
                owner.setdefault(part.shape[1], []).append(np.full(len(part), place.get(item, -1), np.int32))
        #: by length: number of the first phrase, and the different phrases
        self.table: dict[int, tuple[int, np.ndarray]] = {}
        first, count, whose = 0, [], []
        for n in sorted(rows):
            each = np.ascontiguousarray(np.concatenate(rows.pop(n)))
            _, at, inverse = np.unique(each.view(np.dtype((np.void, 4 * n))).ravel(), return_index=True, return_inverse=True)
            self.table[n] = (first, each[at])
            pair = np.unique(np.stack([inverse.astype(np.int32), np.concatenate(owner.pop(n))], 1), axis=0)
            pair = pair[pair[:, 1] >= 0]
            count.append(np.bincount(pair[:, 0], minlength=len(at)))
            whose.append(pair[:, 1])
            first += len(at)
        self.start = np.concatenate([[0], *map(np.ravel, count)]).cumsum()
        self.whose = np.concatenate([np.zeros(0, np.int32), *whose])
        self.shortest = min(self.table, default=0)
        self.alphabet = len(self.number) + 2

    def nbytes(self) -> int:
        """Of the arrays."""
        return self.start.nbytes + self.whose.nbytes + sum(t.nbytes for _, t in self.table.values())

    def items(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items of some phrases: place in ``phrases`` and in ``names``."""
        n = self.start[phrases + 1] - self.start[phrases]
        at = np.repeat(self.start[phrases] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(phrases)), n), self.whose[at]


class BlockRank:
    """Bits with ranks: ones before a place, by counts before each 64-bit word."""

    def __init__(self, bits: np.ndarray) -> None:
        pad = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        pad[: len(bits)] = bits
        self.word = np.packbits(pad, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.word), dtype=np.int64)])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.word[w] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.word[i >> 6] >> (i & 63).astype(np.uint64)).astype(np.int64) & 1


class WaveletMatrix:
    def __init__(self, values: np.ndarray, alphabet: int) -> None:
        self.levels = []
        for lev in reversed(range(max(1, int(alphabet - 1).bit_length()))):
            bit = (values >> lev) & 1
            self.levels.append((lev, BlockRank(bit.astype(np.uint8))))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c[k] stands before place i[k]."""
        base = np.zeros_like(i)
        for lev, b in self.levels:
            one = (c >> lev) & 1 == 1
            i1, b1 = b.ones(i), b.ones(base)
            i = np.where(one, b.zeros + i1, i - i1)
            base = np.where(one, b.zeros + b1, base - b1)
        return i - base

    def get(self, i: np.ndarray) -> np.ndarray:
        value = np.zeros_like(i)
        for lev, b in self.levels:
            bit, ones = b.get(i), b.ones(i)
            value |= bit << lev
            i = np.where(bit == 1, b.zeros + ones, i - ones)
        return value


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling; text ends with a 0 that stands nowhere else."""
    _, rank = np.unique(text, return_inverse=True)
    rank, h, n = rank.astype(np.int64), 1, len(text)
    while True:
        second = np.zeros(n, np.int64)
        second[: n - h if h < n else 0] = rank[h:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank[order] = new
        if new[-1] == n - 1:
            return order
        h *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, alphabet: int, sample: int = SAMPLE) -> None:
        sa = suffix_array(text)
        self.bwt = WaveletMatrix(text[sa - 1], alphabet)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        at = sa % sample == 0
        self.marked, self.sampled = BlockRank(at.astype(np.uint8)), sa[at]
        self.n = len(text)

    def find(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """phrases: rows of one length. Rows that occur, and their suffix range."""
        alive = np.arange(len(phrases))
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in reversed(range(phrases.shape[1])):
            c = phrases[alive, j]
            both = self.bwt.rank(np.r_[c, c], np.r_[lo, hi])
            lo, hi = self.first[c] + both[: len(c)], self.first[c] + both[len(c) :]
            keep = lo < hi
            alive, lo, hi = alive[keep], lo[keep], hi[keep]
            if not len(alive):
                break
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out, steps = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            hit = self.marked.get(rows[todo]) == 1
            done = todo[hit]
            out[done] = self.sampled[self.marked.ones(rows[done])] + steps[done]
            todo = todo[~hit]
            c = self.bwt.get(rows[todo])
            rows[todo] = self.first[c] + self.bwt.rank(c, rows[todo])
            steps[todo] += 1
        return out


def search(docs: list[list[bytes]], phrases: Phrases) -> tuple[np.ndarray, list[np.ndarray], list[list[str]]]:
    """For each document of a shard: hit words, merged spans (rows begin, end) and the items found."""
    empty = np.zeros((0, 2), np.int64)
    hits, spans, items = np.zeros(len(docs), np.int64), [empty] * len(docs), [[] for _ in docs]
    if not phrases.table:
        return hits, spans, items
    get = phrases.number.get
    text = np.fromiter((x for d in docs for x in (*map(get, d, repeat(1)), 1)), np.int64)
    start = np.concatenate([[0], np.cumsum([len(d) + 1 for d in docs])])
    # stretches of known words that are long enough, each followed by a break
    edge = np.diff(np.concatenate([[0], (text != 1).astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - begin >= phrases.shortest
    begin, end = begin[long], end[long]
    if not len(begin):
        return hits, spans, items
    size = end - begin + 1
    place = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    index = FMIndex(np.append(text[place], 0), phrases.alphabet)
    cover = np.zeros(len(text) + 1, np.int64)
    seen_doc, seen_phrase = [], []
    for n, (first, rows) in phrases.table.items():
        for a in range(0, len(rows), 1 << 16):
            which, lo, hi = index.find(rows[a : a + (1 << 16)])
            count = hi - lo
            row = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(which) else lo
            at = place[index.locate(row)]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + n, -1)
            seen_doc.append(np.searchsorted(start, at, "right") - 1)
            seen_phrase.append(np.repeat(first + a + which, count))
    hit = np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]])
    b, e = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
    owner = np.searchsorted(start, b, "right") - 1
    np.add.at(hits, owner, e - b)
    for d in np.unique(owner):
        spans[d] = np.stack([b[owner == d], e[owner == d]], 1) - start[d]
    pairs = np.unique(np.stack([np.concatenate(seen_doc), np.concatenate(seen_phrase)], 1), axis=0)
    at, name = phrases.items(pairs[:, 1])
    for d, i in np.unique(np.stack([pairs[at, 0], name], 1), axis=0).tolist():
        items[d].append(phrases.names[i])
    return hits, spans, items


def merge(a: list, b: list) -> list[dict]:
    out: list[dict] = []
    for x, y in sorted([(s["begin"], s["end"]) for s in a] + [(int(s[0]), int(s[1])) for s in b]):
        if out and x <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], y)
        else:
            out.append({"begin": x, "end": y})
    return out


def benchmark_blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str | None, str | None]]]:
    held, n = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), "text").filter("text IS NOT NULL").toLocalIterator():
        held.append((r["i"], r["text"]))
        n += len(words(r["text"]))
        if n >= block_words:
            yield held
            held, n = [], 0
    if held:
        yield held


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = 400_000, block_words: int = 1_000_000, keep_text: bool = True) -> DataFrame:
    """All columns of ``docs`` (without text, if that isn't wanted) plus dc_words, dc_spans (merged, in words) and dc_items."""
    new = "dc_words long, dc_spans array<struct<begin:long,end:long>>, dc_items array<string>"
    out = docs.withColumns({"dc_words": F.lit(0).cast("long"), "dc_spans": F.expr("cast(array() as array<struct<begin:bigint,end:bigint>>)"), "dc_items": F.expr("cast(array() as array<string>)")})

    def step(sent, names: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            phrases = sent.value
            for pdf in batches:
                counts, spans, items = [], [], []
                shard: list[list[bytes]] = []
                size = 0

                def close() -> None:
                    _, s, i = search(shard, phrases)
                    counts.extend(map(len, shard))
                    spans.extend(s)
                    items.extend(i)

                for t in pdf["text"].tolist():
                    w = words(t)
                    if shard and size + len(w) > shard_words:
                        close()
                        shard, size = [], 0
                    shard.append(w)
                    size += len(w) + 1
                close()
                yield pdf[names].assign(
                    dc_words=np.array(counts, np.int64),
                    dc_spans=[merge(list(old), new.tolist()) for old, new in zip(pdf["dc_spans"], spans)],
                    dc_items=[sorted({*old, *new}) for old, new in zip(pdf["dc_items"], items)],
                )

        return run

    def add(out: DataFrame, items: list, names: list[str]) -> tuple[DataFrame, Broadcast]:
        kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names]
        sent = docs.sparkSession.sparkContext.broadcast(Phrases(items, window))
        return out.mapInPandas(step(sent, names), ", ".join([*kinds, new])), sent

    last: list[tuple[str | None, str | None]] = []
    for items in benchmark_blocks(benchmark, block_words):
        if last:
            # written between passes, so that one block's phrases are held at a time
            found, sent = add(out, last, docs.columns)
            out = cut(found)
            sent.unpersist()
        last = items
    return add(out, last, [c for c in docs.columns if keep_text or c != "text"])[0]


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def op7(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(docs.select("doc_id", "text"), benchmark, keep_text=False)
    n_hit = "CAST(aggregate(dc_spans, 0L, (n, s) -> n + s.end - s.begin) AS BIGINT)"
    return found.selectExpr("doc_id", "dc_words AS n_words", f"{n_hit} AS n_hit", "CAST(size(dc_items) AS BIGINT) AS n_items", "sha2(array_join(dc_items, ','), 256) AS items_sha256", "size(dc_spans) > 0 AS contaminated")
