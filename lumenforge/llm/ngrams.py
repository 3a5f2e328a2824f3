"""Hashed byte n-gram presence, for whole texts, vectorised over a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: An odd constant near 2^64 / golden ratio, for multiplicative hashing.
MIX = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def chunks(texts: list[str | None], most_bytes: int = 1 << 20, most_docs: int = 256) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of neighbouring texts as lower-cased bytes, with the place of the first."""
    at, held, n = 0, [], 0
    for k, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass").translate(_LOWER)
        if held and (n + len(b) > most_bytes or len(held) >= most_docs):
            yield at, held
            at, held, n = k, [], 0
        held.append(b)
        n += len(b)
    if held:
        yield at, held


def presence(docs: list[bytes], orders: tuple[int, ...], bits: int) -> np.ndarray:
    """A row per document: uint8[2^bits], 1 where some n-gram of it hashes to. A document's start counts as a zero byte, its end as some.

    Very long documents are walked in steps, so memory follows the step and not the document.
    """
    out = np.zeros((len(docs), 1 << bits), np.uint8)
    flat, top = out.reshape(-1), max(orders)
    step = 1 << 20
    group: list[tuple[int, bytes]] = []
    size = 0

    def flush() -> None:
        joined = np.frombuffer(b"".join([b"\0" + b + b"\0" * top for _, b in group]), np.uint8)
        size = np.array([len(b) + 1 + top for _, b in group], np.int64)
        row = np.repeat(np.array([k for k, _ in group], np.int64), size) << bits
        left = np.repeat(np.cumsum(size), size) - np.arange(len(joined))  # bytes of the same document from here on
        gram = np.zeros(len(joined), np.uint64)
        for n in range(1, top + 1):
            gram[: len(joined) - n + 1] |= joined[n - 1 :].astype(np.uint64) << np.uint64(8 * (n - 1))
            if n in orders:
                m = len(joined) - n + 1
                h = ((gram[:m] + np.uint64(n << 56)) * MIX) >> np.uint64(64 - bits)
                own = left[:m] >= n
                flat[(row[:m] + h.astype(np.int64))[own]] = 1

    for k, b in enumerate(docs):
        for a in range(0, max(1, len(b)), step):
            piece = b[a : a + step + top]
            group.append((k, piece))
            size += len(piece)
            if size >= step:
                flush()
                group, size = [], 0
    if group:
        flush()
    return out


def cells(docs: list[bytes], orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The different hashed n-grams of each document: documents' numbers, in order, and cells below 2^bits, in order within each.

    Long documents are marked in a table of 2^bits cells, step by step, so memory follows the step and not the document.
    """
    top, step = max(orders), 1 << 20
    doc, found = [], []

    def hashed(piece: bytes) -> Iterator[np.ndarray]:
        flat = np.frombuffer(piece, np.uint8)
        gram = np.zeros(len(flat), np.uint64)
        for n in range(1, top + 1):
            m = len(flat) - n + 1
            if m < 1:
                return
            gram[:m] |= flat[n - 1 :].astype(np.uint64) << np.uint64(8 * (n - 1))
            if n in orders:
                yield (((gram[:m] + np.uint64(n << 56)) * MIX) >> np.uint64(64 - bits)).astype(np.int64)

    for k, b in enumerate(docs):
        b = b"\0" + b + b"\0"
        if len(b) <= 1 << 16:
            got = np.unique(np.concatenate([np.zeros(0, np.int64), *hashed(b)]))
        else:
            table = np.zeros(1 << bits, bool)
            for a in range(0, len(b), step):
                piece = b[a : a + step + top - 1]
                for h in hashed(piece):
                    table[h] = True
            got = np.flatnonzero(table)
        doc.append(np.full(len(got), k))
        found.append(got)
    return (np.concatenate(doc), np.concatenate(found)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
