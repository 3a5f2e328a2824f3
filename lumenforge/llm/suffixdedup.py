"""Exact repeated-substring removal by sampled windows and hash groups.

This replaces external induced suffix sorting: no suffix order and no common-prefix
values are computed, and there is no recursion and no priority queue. "Sort" below
means grouping by hash. Induced sorting was tried in one process and took 11.5 microseconds
of CPU a byte of text (README).

Every byte covered by a ``length``-byte string that also starts earlier (in a
smaller document, or further left) goes. As in induced suffix sorting, only some
suffixes are sorted for themselves and the rest follow from them:

* Sampled suffixes. A suffix is sampled if its first ``name`` bytes have the least
  hash of some window of length - name + 1 starts (a local minimum, as the S*
  suffixes are under byte order). Every string of ``length`` bytes has one that
  it alone determines, so equal strings agree on theirs.
* External sort. Tuples (name, document, position) go to buckets by name and each
  bucket is sorted; Spark's shuffle files are the queues on disk. A name that
  stands alone has no common prefix of ``name`` bytes with any other suffix, and
  nothing that it induces can repeat.
* Induction. The suffixes whose sampled suffix has a shared name go, with the text
  around it, to the bucket of that name, are sorted there by their first
  ``length`` bytes, and each run with a common prefix of that length keeps its
  earliest member. The others' bytes are the removed spans.

Both sorts first merge what one task holds (one member of each run goes on), so
a passage that a third of all documents share reaches a bucket once a task.
Documents equal as a whole are settled by digest beforehand. Strings are
compared by 128 hash bits.

Null texts count as empty; texts shorter than ``length`` keep everything. Rows with
equal id and text count as one document and get equal results; rows with equal
ids and different texts are ordered by the texts' digests; null ids come first.
Memory follows segments (2 MB of text), tuples of a task and buckets, and there
is a bucket for each 8 MB of text (four for a shuffle partition at least).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh_dir, let_go, partitions, remove_dir

LENGTH, NAME, SEGMENT, BUCKET = 100, 40, 2 << 20, 8 << 20
_ROOT = 0x9E3779B97F4A7C15
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def press(a: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a)


def open_(a: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(a)


# ---- hashing and sampling -------------------------------------------------------

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i modulo 2^64."""
    size = 1 << max(12, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up = np.full(size, _ROOT, np.uint64)
        down = np.full(size, pow(_ROOT, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[size] = (np.cumprod(up), np.cumprod(down))
    return _powers[size]


def _values(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


_VALUES = (_values(1), _values(2))


def rolled(b: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of b[i:i+n] for every i."""
    if len(b) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_VALUES[which][b] * up[: len(b)], out=total[1:])
    h = (total[n:] - total[:-n]) * down[: len(b) - n + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


def sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """min(v[i:i+w]) for every i."""
    n = len(v)
    pad = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = v
    rows = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


class Segment:
    """Neighbouring documents or pieces of one, joined; where their windows start and what each window samples."""

    def __init__(self, parts: list[tuple[int, int, bytes]], length: int, name: int) -> None:
        self.text = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
        sizes = np.array([len(p) for _, _, p in parts], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.row = np.repeat(np.array([r for r, _, _ in parts], np.int64), sizes)
        self.shift = np.repeat(np.array([o for _, o, _ in parts], np.int64) - begin, sizes)  # place in the document less place here
        names = rolled(self.text, name)
        self.start = self.end = self.at = self.name = np.zeros(0, np.int64)
        windows = sizes - length + 1
        ok = np.flatnonzero(windows > 0)
        if not len(ok):
            return
        bits = np.uint64(22)
        tagged = (names >> np.uint64(16)) << bits | np.arange(len(names), dtype=np.uint64)  # least name first, then leftmost
        least = sliding_least(tagged, length - name + 1)
        count = windows[ok]
        where = np.repeat(begin[ok] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        at = (least[where] & np.uint64((1 << 22) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        self.start, self.end = where[new], where[np.concatenate([new[1:], [len(at)]]) - 1] + 1  # windows of each sampled suffix
        self.at, self.name = at[new], names[at[new]] >> np.uint64(16)


def segments(rows: list[bytes], length: int, name: int, most: int = SEGMENT) -> Iterator[Segment]:
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for r, text in enumerate(rows):
        for a in range(0, max(1, len(text) - length + 1), most):
            part = text[a : a + most + length - 1]
            if held and size + len(part) > most:
                yield Segment(held, length, name)
                held, size = [], 0
            held.append((r, a, part))
            size += len(part)
    if held:
        yield Segment(held, length, name)


def ranges(count: np.ndarray, first: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... count[0] of them, then the next."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(count) else np.zeros(0, np.int64)


def not_first(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Which members of runs of equal (h1, h2) aren't the first of their run, in the order given."""
    order = np.argsort(h1, kind="stable")
    a, b = h1[order], h2[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():
        order = np.lexsort((np.arange(len(h1)), h2, h1))
        a, b = h1[order], h2[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    out = np.zeros(len(h1), bool)
    out[order[1:][same]] = True
    return out


# ---- first sort: names ----------------------------------------------------------

TUPLES = "bucket int, sure boolean, names binary, keys binary, places binary"


def sample_tuples(batches: Iterator[pd.DataFrame], buckets: int, length: int, name: int, most: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Sampled suffixes of a task, dealt to buckets by name. Of equal names one goes on, marked sure, as do the others, which need no comparison."""
    names, keys, places = [], [], []
    n = 0

    def flush() -> Iterator[pd.DataFrame]:
        nonlocal names, keys, places, n
        a, k, p = np.concatenate(names), np.concatenate(keys), np.concatenate(places)
        order = np.argsort(a, kind="stable")
        same = np.concatenate([[False], a[order][1:] == a[order][:-1]])
        sure, rest = np.zeros(len(a), bool), np.zeros(len(a), bool)
        rest[order[same]] = True
        sure[order] = same | np.concatenate([same[1:], [False]])
        b = (a % np.uint64(buckets)).astype(np.int64)
        kind, out = "<i4" if p.max() < 1 << 31 else "<i8", []
        for flag, mask in ((False, ~sure), (True, sure & ~rest), (None, rest)):
            at = np.flatnonzero(mask)
            at = at[np.argsort(b[at], kind="stable")]
            edge = np.searchsorted(b[at], np.arange(buckets + 1))
            for x in np.flatnonzero(np.diff(edge)).tolist():
                i = at[edge[x] : edge[x + 1]]
                six = np.ascontiguousarray(a[i].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes() if flag is not None else b""
                out.append((x, flag is not False, six, press(k[i].tobytes()), press(p[i].astype(kind).tobytes())))
        names, keys, places, n = [], [], [], 0
        yield pd.DataFrame(out, columns=["bucket", "sure", "names", "keys", "places"])

    for pdf in batches:
        key = pdf["key"].to_numpy(np.int64)
        for s in segments([(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"].tolist()], length, name):
            if len(s.at):
                k, p = key[s.row[s.at]], s.at + s.shift[s.at]
                if keys and len(keys[-1]) and keys[-1][-1] == k[0] and places[-1][-1] == p[0]:  # a long document's pieces share one
                    k, p, s.name = k[1:], p[1:], s.name[1:]
                names.append(s.name)
                keys.append(k)
                places.append(p)
                n += len(k)
            if n >= most:
                yield from flush()
    if n:
        yield from flush()


def by_bucket(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one bucket at a time, of a partition sorted by bucket."""
    held: list[pd.DataFrame] = []
    now = None
    for pdf in batches:
        for b, part in pdf.groupby("bucket", sort=False):
            if b != now and held:
                yield pd.concat(held)
                held = []
            now = b
            held.append(part)
    if held:
        yield pd.concat(held)


def ints(blob: bytes, n: int) -> np.ndarray:
    raw = open_(blob)
    return np.frombuffer(raw, "<i8" if len(raw) == 8 * n else "<i4").astype(np.int64)


def shared_names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Suffixes whose name another suffix has, as rows (key, places)."""
    for pdf in by_bucket(batches):
        names, keys, places, sure = [], [], [], []
        for r in pdf.itertuples():
            k = np.frombuffer(open_(r.keys), "<i8")
            six = np.frombuffer(r.names, np.uint8).reshape(-1, 6)
            wide = np.zeros((len(k), 8), np.uint8)
            if len(six):
                wide[:, :6] = six
            names.append(wide.view("<u8").reshape(-1) if len(six) else np.full(len(k), np.iinfo(np.uint64).max, np.uint64))
            keys.append(k)
            places.append(ints(r.places, len(k)))
            sure.append(np.full(len(k), bool(r.sure)))
        a, k, p, keep = (np.concatenate(x) for x in (names, keys, places, sure))
        order = np.argsort(a, kind="stable")
        same = a[order][1:] == a[order][:-1]
        keep[order[1:][same]] = True
        keep[order[:-1][same]] = True
        i = np.flatnonzero(keep)
        i = i[np.argsort(k[i], kind="stable")]
        if len(i):
            edge = np.flatnonzero(np.concatenate([[True], k[i][1:] != k[i][:-1], [True]]))
            yield pd.DataFrame({"key": k[i][edge[:-1]], "places": [p[i[x:y]].astype("<i8").tobytes() for x, y in zip(edge[:-1], edge[1:])]})


# ---- second sort: induced suffixes ----------------------------------------------

CONTEXTS = "bucket int, keys binary, starts binary, counts binary, body binary"


def as_ranges(key: np.ndarray, start: np.ndarray, length: int) -> pd.DataFrame:
    """Window starts, ordered by (key, start), as rows (key, spans): merged runs of covered bytes."""
    if not len(key):
        return pd.DataFrame({"key": np.zeros(0, np.int64), "spans": []})
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (start[1:] > start[:-1] + length)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(key)]]) - 1
    k, a, b = key[first], start[first], start[last] + length
    edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
    both = np.stack([a, b], 1).astype("<i8")
    return pd.DataFrame({"key": k[edge[:-1]], "spans": [both[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:])]})


def induce(batches: Iterator[pd.DataFrame], buckets: int, length: int, name: int, most: int = 8 << 20) -> Iterator[pd.DataFrame]:
    """Windows of shared sampled suffixes: later members of a task's own runs are settled here (rows with key and spans), the first ones go on with their text."""
    empty = {"bucket": -1, "keys": b"", "starts": b"", "counts": b"", "body": b""}

    def work(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        pdf = pdf.sort_values("key", kind="stable")
        key = pdf["key"].to_numpy(np.int64)
        shared = [np.unique(np.concatenate([np.frombuffer(b, "<i8") for b in bs])) for bs in pdf["places"]]
        # of each sampled suffix: its document's key, first window and number of windows; of each window only its hashes
        h1, h2, keys, starts, counts, names = [], [], [], [], [], []
        held: list[tuple[Segment, np.ndarray]] = []
        for s in segments([(t or "").encode("utf-8", "surrogatepass") for t in pdf["text"].tolist()], length, name):
            if not len(s.at):
                continue
            row, place = s.row[s.at], s.at + s.shift[s.at]
            mine = np.zeros(len(place), bool)
            for r in np.unique(row):
                x, y = np.searchsorted(row, [r, r + 1])
                mine[x:y] = np.isin(place[x:y], shared[r], assume_unique=True)
            i = np.flatnonzero(mine)
            if not len(i):
                continue
            count = s.end[i] - s.start[i]
            w = ranges(count, s.start[i])
            h1.append(rolled(s.text, length)[w])
            h2.append(rolled(s.text, length, 1)[w])
            keys.append(key[s.row[s.start[i]]])
            starts.append(s.start[i] + s.shift[s.start[i]])
            counts.append(count)
            names.append(s.name[i])
            held.append((s, i))
        if not held:
            return
        keys, starts, counts, names = (np.concatenate(x) for x in (keys, starts, counts, names))
        first = np.concatenate([[0], np.cumsum(counts)])  # each suffix's first window among all
        h1, h2 = np.concatenate(h1), np.concatenate(h2)
        later = not_first(h1, h2)
        del h1, h2
        j = np.flatnonzero(later)
        owner = np.searchsorted(first, j, "right") - 1
        done = as_ranges(keys[owner], starts[owner] + (j - first[owner]), length)
        if len(done):
            yield done.assign(**empty)
        # of each sampled suffix, from its first to its last window that goes on
        on = np.flatnonzero(~later)
        owner = np.searchsorted(first, on, "right") - 1
        edge = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]])) if len(on) else np.zeros(1, np.int64)
        which = owner[edge[:-1]]
        skip, last = on[edge[:-1]] - first[which], on[edge[1:] - 1] - first[which]
        keys, starts, counts, names = keys[which], starts[which] + skip, last - skip + 1, names[which]
        a, bodies = 0, []
        for s, i in held:
            x, y = np.searchsorted(which, [a, a + len(i)])
            begin = s.start[i[which[x:y] - a]] + skip[x:y]
            raw = s.text.tobytes()
            bodies += [raw[p : p + c + length - 1] for p, c in zip(begin.tolist(), counts[x:y].tolist())]
            a += len(i)
        bucket = (names % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cut_at = np.searchsorted(bucket[order], np.arange(buckets + 1))
        out = []
        for x in np.flatnonzero(np.diff(cut_at)).tolist():
            j = order[cut_at[x] : cut_at[x + 1]]
            out.append((x, press(keys[j].astype("<i8").tobytes()), press(starts[j].astype("<i8").tobytes()), press(counts[j].astype("<i8").tobytes()), press(b"".join([bodies[y] for y in j.tolist()])), 0, b""))
        yield pd.DataFrame(out, columns=["bucket", "keys", "starts", "counts", "body", "key", "spans"])

    held, size = [], 0
    for pdf in batches:
        lens = pdf["text"].str.len().fillna(0).to_numpy(np.int64)
        a = 0
        for k in range(len(pdf)):
            size += int(lens[k])
            if size >= most:
                yield from work(pd.concat([*held, pdf.iloc[a : k + 1]]))
                held, size, a = [], 0, k + 1
        held.append(pdf.iloc[a:])
    if held:
        yield from work(pd.concat(held))


def settle(batches: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Of all tasks' first members of a bucket, those that aren't first among them."""
    for pdf in by_bucket(batches):
        if int(pdf["bucket"].iloc[0]) < 0:
            yield pdf[["key", "spans"]]
            continue
        keys = np.concatenate([np.frombuffer(open_(x), "<i8") for x in pdf["keys"]])
        starts = np.concatenate([np.frombuffer(open_(x), "<i8") for x in pdf["starts"]])
        counts = np.concatenate([np.frombuffer(open_(x), "<i8") for x in pdf["counts"]])
        text = np.frombuffer(b"".join([open_(x) for x in pdf["body"]]), np.uint8)
        begin = np.concatenate([[0], np.cumsum(counts + length - 1)[:-1]])
        order = np.lexsort((starts, keys))
        keys, starts, counts, begin = keys[order], starts[order], counts[order], begin[order]
        w = ranges(counts, begin)
        later = not_first(rolled(text, length)[w], rolled(text, length, 1)[w])
        k, s = np.repeat(keys, counts)[later], ranges(counts, starts)[later]
        order = np.lexsort((s, k))
        yield as_ranges(k[order], s[order], length)


# ---- the whole ------------------------------------------------------------------


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, text and a key that orders documents; and whether ids were their own keys."""
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    plain = isinstance(src.schema["doc_id"].dataType, T.IntegralType)
    if plain and not src.filter("doc_id IS NULL").limit(1).count() and not src.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        return src.withColumn("key", F.col("doc_id").cast("long")), True
    spark = docs.sparkSession
    ids = src.select("doc_id", F.sha2("text", 256).alias("sha")).distinct()
    ids = ids.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), "sha").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "sha")
    ids = cut(ids.select("doc_id", "sha", F.monotonically_increasing_id().alias("key")))  # ordered by partition, then place
    left = src.dropDuplicates().withColumn("sha", F.sha2("text", 256))
    right = ids.select(F.col("doc_id").alias("d2"), F.col("sha").alias("s2"), "key")
    return left.join(right, left["doc_id"].eqNullSafe(right["d2"]) & (left["sha"] == right["s2"])).select("doc_id", "text", "key"), False


def find_repeats(docs: DataFrame, length: int = LENGTH, name: int = NAME, bucket_bytes: int = BUCKET) -> DataFrame:
    """docs: key (distinct longs), text without nulls. Rows key, n_bytes, spans (removed runs, in bytes), kept_sha256. A bucket for each bucket_bytes of text."""
    spark = docs.sparkSession
    docs, parts = docs.select("key", "text"), partitions(spark)
    ids = cut(docs.select("key", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha")))
    buckets = max(4 * parts, (ids.agg(F.sum("n_bytes")).first()[0] or 0) // bucket_bytes)
    # on its own, so that the join below deals out what one digest's many rows would load on one task
    first = cut(ids.filter(F.col("n_bytes") >= length).groupBy("sha").agg(F.min("key").alias("one"), F.count("*").alias("many")).filter("many > 1").select("sha", "one"))
    copies = cut(ids.join(first, "sha").filter("key <> one").select("key"))

    tuples = docs.mapInPandas(lambda it: sample_tuples(it, buckets, length, name), TUPLES)
    sorted_names = tuples.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInPandas(shared_names, "key long, places binary")
    marked = sorted_names.groupBy("key").agg(F.collect_list("places").alias("places")).join(copies, "key", "left_anti")
    at = fresh_dir(spark, "repeats")
    docs.join(marked, "key").write.option("compression", "zstd").parquet(at)
    del tuples, sorted_names, marked, first
    let_go(spark)
    held = spark.read.schema("key long, text string, places array<binary>").parquet(at)

    induced = held.mapInPandas(lambda it: induce(it, buckets, length, name), f"{CONTEXTS}, key long, spans binary")
    spread = F.when(F.col("bucket") >= 0, F.col("bucket")).otherwise(-1 - F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    found = induced.withColumn("bucket", spread).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInPandas(lambda it: settle(it, length), "key long, spans binary")
    spans = found.groupBy("key").agg(F.collect_list("spans").alias("found"))

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            runs, shas = [], []
            for t, blobs in zip(pdf["text"].tolist(), pdf["found"].tolist()):
                raw = t.encode("utf-8", "surrogatepass")
                merged = merge(np.concatenate([np.frombuffer(b, "<i8").reshape(-1, 2) for b in blobs]))
                digest, x = hashlib.sha256(), 0
                for a, b in merged:
                    digest.update(raw[x:a])
                    x = b
                digest.update(raw[x:])
                runs.append([{"begin": a, "end": b} for a, b in merged])
                shas.append(digest.hexdigest())
            yield pd.DataFrame({"key": pdf["key"], "spans": runs, "kept": shas})

    span_type = "array<struct<begin:long,end:long>>"
    cleaned = held.select("key", "text").join(spans, "key").mapInPandas(keep, f"key long, spans {span_type}, kept string")
    done = cut(cleaned)
    remove_dir(spark, at)
    out = ids.join(done, "key", "left").join(copies.withColumn("copy", F.lit(True)), "key", "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end")))
    none = F.expr("cast(array() as array<struct<begin:bigint,end:bigint>>)")
    return out.select(
        "key", "n_bytes",
        F.when(F.col("copy"), whole).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(F.col("copy"), F.lit(_EMPTY_SHA)).otherwise(F.coalesce("kept", F.lower(F.hex("sha")))).alias("kept_sha256"),
    )


def merge(pairs: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in pairs[np.argsort(pairs[:, 0], kind="stable")].tolist():
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, name: int = NAME) -> DataFrame:
    """doc_id, n_bytes, spans, kept_sha256 for every row of ``docs``."""
    keyed, own = numbered(docs)
    if own:
        return find_repeats(keyed, length, name).withColumn("doc_id", F.col("key").cast(docs.schema["doc_id"].dataType)).drop("key")
    keyed = cut(keyed)
    got = find_repeats(keyed, length, name).join(keyed.select("key", F.col("doc_id").alias("d2"), F.sha2("text", 256).alias("s2")), "key").drop("key")
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("s1"))
    return rows.join(got, rows["doc_id"].eqNullSafe(got["d2"]) & (rows["s1"] == got["s2"])).select("doc_id", "n_bytes", "spans", "kept_sha256")


def op3(docs: DataFrame) -> DataFrame:
    removed = "CAST(aggregate(spans, 0L, (n, s) -> n + s.end - s.begin) AS BIGINT) AS n_removed"
    return remove_repeats(docs).selectExpr("doc_id", "n_bytes", removed, "CAST(size(spans) AS BIGINT) AS n_spans", "kept_sha256")
