"""Words of a corpus: chunks of documents as numbers, buckets that count words in full, and the words' codes.

A word's code has two parts. First comes its class, by the power of two of its
training count, in a prefix code that gives heavy classes few bits; then, in classes
of at most ``RANKED`` words, the word's rank, else the first bits of its hash. Words
that training holds at most once are one class, and are spelled (``lmspell``).

The first ``SYMBOL`` bits of the code are the word's symbol, which the mixer codes.
Words whose whole code fits are known by then; the words that share a symbol are told
apart by their counts, unless a prediction names one. So no list of all words is
needed in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, id_crc

END = b"\n"
RANKED, CODE_BITS, SYMBOL = 4096, 32, 8
USUAL = 9  # bits of the longest code of a usual word


def press(a: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a)


def open_(a: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(a)


def array(a: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(open_(a), kind)


def hashes(words: list[bytes]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.array([h(w, 7) for w in words], np.uint64)


def top_bits(h: np.ndarray, n: int) -> np.ndarray:
    """The first n bits of 64-bit hashes."""
    return (h >> np.uint64(64 - n)) if n else np.zeros(len(h), np.uint64)


def split_words(body: bytes) -> list[bytes]:
    """The end's line feed is not white space here."""
    return open_(body).split(b" ")


# ---- chunks ---------------------------------------------------------------------

CHUNKS = "kind string, chunk long, bucket int, doc_ids array<{id}>, held array<boolean>, lens array<int>, sizes array<long>, body binary, places binary, counts binary"

DOCS = CHUNKS.removeprefix("kind string, ")  # of one kind's folder


def write_chunks(docs: DataFrame, sample: DataFrame, path: str, bucket_bits: int, most_words: int, most_tokens: int) -> None:
    """Documents as numbers of their chunk's words, and the words by bucket with their training counts. A chunk ends at ``most_words`` distinct words or ``most_tokens`` tokens.

    sample: training documents once more, in one partition; they are one chunk, whose number is -1, and count nothing.
    """
    src = docs.select("doc_id", "text", (id_crc() % 7 == 2).alias("held"), F.lit(False).alias("again"))
    src = src.union(sample.select("doc_id", "text", F.lit(False), F.lit(True)))
    schema = CHUNKS.format(id=src.schema["doc_id"].dataType.simpleString())
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, n_tokens, again = TaskContext.get().partitionId(), 0, 0, False
        number: dict[bytes, int] = {}
        ids, held, body, sizes = [], [], [], []

        def close() -> pd.DataFrame:
            nonlocal seq, number, ids, held, body, sizes, n_tokens
            chunk, lens = -1 - seq if again else (part << 24) + seq, [len(b) for b in body]
            tokens, count = np.concatenate(body), np.zeros(len(number), np.int64)
            if not again:
                np.add.at(count, tokens[np.repeat(~np.array(held, bool), lens)], 1)
            words = list(number)
            bucket = top_bits(hashes(words), bucket_bits).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            b = bucket[order]
            cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1], [True]]))
            rows = [("doc", chunk, -1, ids, held, lens, sizes, press(tokens.astype("<u4").tobytes()), None, None)]
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                at = order[lo:hi]
                rows.append(("word", chunk, int(b[lo]), None, None, None, None, press(b" ".join([words[i] for i in at.tolist()])), press(at.astype("<u4").tobytes()), press(count[at].astype("<u4").tobytes())))
            seq += 1
            number, ids, held, body, sizes, n_tokens = {}, [], [], [], [], 0
            return pd.DataFrame(rows, columns=names)

        for pdf in batches:
            for i, t, h, more in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), pdf["held"].tolist(), pdf["again"].tolist()):
                if ids and more != again:
                    yield close()
                again = more
                raw = (t or "").encode("utf-8", "surrogatepass")
                sizes.append(len(raw))
                ws = raw.lower().split()
                ws.append(END)
                got = list(map(number.get, ws))
                if None in got:
                    for k, x in enumerate(got):
                        if x is None:
                            got[k] = number.setdefault(ws[k], len(number))
                ids.append(None if i is None or i != i else i)
                held.append(h)
                body.append(np.array(got, np.int32))
                n_tokens += len(ws)
                if not again and (len(number) >= most_words or n_tokens >= most_tokens):
                    yield close()
        if ids:
            yield close()

    src.mapInPandas(giving_back(run), schema).write.partitionBy("kind").parquet(path)


# ---- buckets --------------------------------------------------------------------

MERGED = "bucket int, body binary, counts binary, chunks array<long>, sizes array<int>, places binary, refs binary"


def merge_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row per bucket: its distinct words in order, their training counts, and for each chunk which of them it asked for."""
    pdf = pdf.sort_values("chunk")
    number: dict[bytes, int] = {}
    refs, places, count = [], [], []
    for r in pdf.itertuples():
        refs.append(np.array([number.setdefault(w, len(number)) for w in split_words(r.body)], np.int64))
        places.append(open_(r.places))
        count.append(array(r.counts, "<u4"))
    words, ref = list(number), np.concatenate(refs)
    total = np.zeros(len(words), "<i8")
    np.add.at(total, ref, np.concatenate(count).astype("<i8"))
    order = sorted(range(len(words)), key=words.__getitem__)
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    return pd.DataFrame([{
        "bucket": int(pdf["bucket"].iloc[0]), "body": press(b" ".join([words[i] for i in order])), "counts": press(total[order].tobytes()),
        "chunks": pdf["chunk"].tolist(), "sizes": [len(r) for r in refs], "places": press(b"".join(places)), "refs": press(rank[ref].astype("<u4").tobytes()),
    }])


# ---- codes ----------------------------------------------------------------------


def class_of(count: np.ndarray) -> np.ndarray:
    """0: at most once in training, to be spelled; else the whole part of log2."""
    return np.where(count <= 1, 0, np.frexp(count.astype(float))[1] - 1)


def short_codes(mass: dict[int, float]) -> dict[int, tuple[int, int]]:
    """A prefix code: class -> (bits, length); halves of near equal mass, each class weighing a sixty-fourth at least."""
    floor = sum(mass.values()) / 64
    out: dict[int, tuple[int, int]] = {}

    def split(items: list[tuple[int, float]], bits: int, n: int) -> None:
        if len(items) == 1:
            out[items[0][0]] = (bits, n)
            return
        running = np.cumsum([m for _, m in items])
        k = 1 + int(np.argmin(np.abs(running[:-1] - running[-1] / 2)))
        split(items[:k], bits << 1, n + 1)
        split(items[k:], bits << 1 | 1, n + 1)

    split(sorted(((c, max(m, floor)) for c, m in mass.items()), key=lambda x: (-x[1], x[0])), 0, 0)
    return out


def codebook(merged: DataFrame) -> dict:
    """Sizes of the corpus; for each class its bits, the bits that follow, and the hashes to rank by where it is small; and the training tokens of each symbol whose words aren't spelled."""

    def classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                c = array(r.counts, "<i8")
                k = class_of(c)
                n = int(k.max(initial=0)) + 1
                yield pd.DataFrame({"class": np.arange(n), "words": np.bincount(k, minlength=n), "known": np.bincount(k, c > 0, n).astype(np.int64), "mass": np.bincount(k, c, n).astype(np.int64)})

    sizes = merged.select("counts").mapInPandas(classes, "class int, words long, known long, mass long").groupBy("class").agg(F.sum("words"), F.sum("known"), F.sum("mass")).collect()
    words, known, mass = ({r[0]: int(r[k]) for r in sizes} for k in (1, 2, 3))
    small = sorted(c for c, n in words.items() if c and 0 < n <= RANKED)

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                k = class_of(array(r.counts, "<i8"))
                at = np.flatnonzero(np.isin(k, small))
                if len(at):
                    ws = split_words(r.body)
                    yield pd.DataFrame({"class": k[at], "hash": hashes([ws[i] for i in at.tolist()]).view(np.int64)})

    # at most RANKED words of each class
    found: dict[int, list[int]] = {c: [] for c in small}
    for r in merged.select("body", "counts").mapInPandas(ranked, "class int, hash long").collect() if small else []:
        found[r[0]].append(r[1])
    codes = short_codes({0: mass.get(0, 0) + 1.0} | {c: float(m) for c, m in mass.items() if c and words[c]})
    book = {}
    for c, (bits, n) in codes.items():
        if c in found:
            book[c] = (bits, n, (len(found[c]) - 1).bit_length(), np.sort(np.array(found[c], np.int64).view(np.uint64)))
        else:
            book[c] = (bits, n, CODE_BITS - n, None)

    def symbols(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << SYMBOL, np.int64)
        for pdf in batches:
            for r in pdf.itertuples():
                c = array(r.counts, "<i8")
                np.add.at(total, codes_of(split_words(r.body), c, book)[0], np.where(c > 1, c, 0))
        yield pd.DataFrame({"symbol": np.arange(1 << SYMBOL), "mass": total})

    by_symbol = np.zeros(1 << SYMBOL, np.int64)
    for r in merged.select("body", "counts").mapInPandas(symbols, "symbol int, mass long").groupBy("symbol").agg(F.sum("mass")).collect():
        by_symbol[r[0]] = r[1]
    return {"n": sum(mass.values()), "v": sum(known.values()), "book": book, "mass": by_symbol}


def codes_of(words: list[bytes], count: np.ndarray, book: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols (first bit highest), how many bits of them are coded, with 128 added for usual words, codes of 32 bits that tell words apart, and hashes."""
    h, k = hashes(words), class_of(count)
    code, length = np.zeros(len(words), np.uint64), np.zeros(len(words), np.int64)
    for c in np.unique(k).tolist():
        at = np.flatnonzero(k == c)
        bits, n, more, ranks = book[c]
        path = np.searchsorted(ranks, h[at]).astype(np.uint64) if ranks is not None else top_bits(h[at], more)
        code[at] = (np.uint64(bits) << np.uint64(more) | path) << np.uint64(CODE_BITS - n - more)
        length[at] = n + more if c else n
    usual = (count > 1) & (length <= USUAL)
    length = np.minimum(length, SYMBOL)
    symbol = code.astype(np.int64) >> (CODE_BITS - SYMBOL) & (0xFF << (SYMBOL - length))
    return symbol.astype(np.uint8), (length + 128 * usual).astype(np.uint8), code.astype("<u4"), h
