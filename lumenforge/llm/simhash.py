"""SimHash near-duplicates by a byte-position index with count filtering.

A text's fingerprint has a bit set where over half of its shingles' XXH64 values
have it. Two fingerprints that differ in at most 3 bits agree in at least 5 of
their 8 bytes, each at its position. The index holds every distinct fingerprint
under 14 choices of 4 byte positions and their values, of which every choice of 5
positions has one whole; fingerprints under one key are candidates. Their shared
positional bytes are tallied, pairs below 5 are dropped, and the others verified by
counting bits.

A key leaves 32 bits free. Within a key links become a spanning star of each
connected group, at most one row for each fingerprint: pairs are never listed.
Small groups are compared directly, large ones by looking up all neighbours
within 3 flips of the free bits; both are exact.

Null texts count as empty; texts without words have fingerprint zero. Copies
share a fingerprint and are one node. A null id never names a component unless
all its members' ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, partitions
from .components import components

DIRECT = 2048


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64 bits as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    ones, n = np.zeros(64, np.int64), max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, 1 << 15):
        part = words[a : min(a + (1 << 15), n) + width - 1]
        joined, ends = b" ".join(part), np.cumsum([len(w) + 1 for w in part])
        k = max(1, len(part) - width + 1)
        begin = [0, *ends[: k - 1].tolist()]
        end = (ends[min(width, len(part)) - 1 :] - 1).tolist()
        h = np.array([digest(joined[i:j], seed) for i, j in zip(begin, end)], dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (signed long). Narrow."""
    src = docs.select("doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t, width) for t in pdf["text"].tolist()], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": fp.view(np.int64)})

    return src.mapInPandas(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long")


def byte_masks(need: int = 5) -> list[int]:
    """Masks of byte positions, as signed longs, so that every choice of ``need`` of the 8 positions has one of them whole.

    For 5: both halves of the positions, and two of either half, a pair of one half
    meeting the pairs of the other half's matching of the same number. Of three
    positions of a half every matching has a pair. Else every choice itself.
    """
    if need == 5:
        matchings = (((0, 1), (2, 3)), ((0, 2), (1, 3)), ((0, 3), (1, 2)))
        chosen = [(0, 1, 2, 3), (4, 5, 6, 7)] + [(*a, *(p + 4 for p in b)) for m in matchings for a in m for b in m]
    else:
        chosen = list(combinations(range(8), need))
    out = []
    for at in chosen:
        m = sum(0xFF << (8 * p) for p in at)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def near(a: np.ndarray, b: np.ndarray, need: int, bits: int) -> np.ndarray:
    """Count filter and verification of pairs of unsigned fingerprints."""
    x = a ^ b
    shared = np.zeros(x.shape, np.int8)
    for p in range(8):
        shared += ((x >> np.uint64(8 * p)) & np.uint64(255)) == 0
    ok = shared >= need
    ok[ok] = np.bitwise_count(x[ok]) <= bits
    return ok


def star(fps: np.ndarray, need: int = 5, bits: int = 3, direct: int = DIRECT) -> tuple[np.ndarray, np.ndarray]:
    """Spanning stars of the connected groups of distinct fingerprints that share a key: nodes and their roots, roots left out."""
    n = len(fps)
    label = np.arange(n)
    if n <= direct:
        src, dst = [], []
        for a in range(0, n, 256):
            i, j = np.nonzero(near(fps[a : a + 256, None], fps[None, :], need, bits))
            src.append(i + a)
            dst.append(j)
        pairs = [(np.concatenate(src), np.concatenate(dst))]
        again = lambda: iter(pairs)
    else:
        free = [p for p in range(64) if len(np.unique((fps >> np.uint64(p)) & np.uint64(1))) == 2]
        flips = [np.uint64(sum(1 << p for p in c)) for k in range(1, bits + 1) for c in combinations(free, k)]
        rank = np.argsort(fps)
        ordered = fps[rank]

        def again() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for f in flips:
                want = fps ^ f
                at = np.minimum(np.searchsorted(ordered, want), n - 1)
                hit = np.flatnonzero(ordered[at] == want)
                if len(hit):
                    yield hit, rank[at[hit]]

    while True:
        before = label.copy()
        for i, j in again():
            low = np.minimum(label[i], label[j])
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
        label = label[label]
        if np.array_equal(before, label):
            break
    rest = np.flatnonzero(label != np.arange(n))
    return fps[rest], fps[label[rest]]


def links(fps: DataFrame, need: int = 5, bits: int = 3) -> DataFrame:
    """fps: distinct fp. Rows u, v that connect exactly what chains of links within ``bits`` connect."""
    spark = fps.sparkSession
    keys = F.array(*[F.struct(F.lit(k).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("m")) for k, m in enumerate(byte_masks(need))])
    held = fps.select("fp", F.explode(keys).alias("k")).select("k.c", "k.m", "fp")
    held = held.repartition(partitions(spark), "c", "m").sortWithinPartitions("c", "m")

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        u, v = [], []
        tail: list[np.ndarray] = []  # the last key's rows so far
        tail_key = None

        def close(rows: np.ndarray) -> None:
            if len(rows) > 1:
                a, b = star(rows, need, bits)
                u.append(a)
                v.append(b)

        for pdf in batches:
            c, m, fp = pdf["c"].to_numpy(), pdf["m"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
            if not len(c):
                continue
            cuts = np.flatnonzero((c[1:] != c[:-1]) | (m[1:] != m[:-1])) + 1
            begin, end = np.r_[0, cuts], np.r_[cuts, len(c)]
            if tail_key == (c[0], m[0]):
                tail.append(fp[: end[0]])
                begin, end = begin[1:], end[1:]
            if len(begin):
                close(np.concatenate(tail) if tail else fp[:0])
                size = end - begin
                two = begin[:-1][size[:-1] == 2]  # most groups that aren't single are pairs
                ok = near(fp[two], fp[two + 1], need, bits)
                u.append(fp[two][ok])
                v.append(fp[two + 1][ok])
                for k in np.flatnonzero(size[:-1] > 2):
                    close(fp[begin[k] : end[k]])
                tail, tail_key = [fp[begin[-1] : end[-1]].copy()], (c[-1], m[-1])
            if sum(map(len, u)) > 50_000:
                yield pd.DataFrame({"u": np.concatenate(u).view(np.int64), "v": np.concatenate(v).view(np.int64)})
                u, v = [], []
        close(np.concatenate(tail) if tail else np.zeros(0, np.uint64))
        if u:
            yield pd.DataFrame({"u": np.concatenate(u).view(np.int64), "v": np.concatenate(v).view(np.int64)})

    return held.mapInPandas(groups, "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = 3) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``."""
    marked = cut(fingerprints(docs, width))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(nodes.select("fp"), 8 - bits, bits))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(nodes["fp"].alias("n_fp"), "first", F.coalesce("root", nodes["fp"]).alias("root"))
    named = cut(named)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    per_fp = named.join(least, "root").select("n_fp", "component_id")
    return marked.join(per_fp, marked["fp"] == per_fp["n_fp"]).select("doc_id", "fp", "component_id")


def op6(docs: DataFrame) -> DataFrame:
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return near_duplicates(docs).select("doc_id", hexed.alias("fingerprint"), "component_id")
