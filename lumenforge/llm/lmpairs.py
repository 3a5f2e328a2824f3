"""Which word follows two words in the whole corpus, exactly: requests of chunks meet by context.

A request names a context (two words before, as 32 bits of their hash within a
bucket), the first bits of the word that follows, and whether its text is held out;
it holds how often training texts of the chunk have it. A bucket adds up requests of
all chunks, ranks what follows each context, and answers each request with the most
frequent word but for the request's own occurrence. A bucket's contexts grow with the
input no more than its share, as the number of buckets follows the input.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from .common import give_back
from .lmmixer import agreeing
from .lmspell import MUL, NODE
from .lmwords import CODE_BITS, SYMBOL, array, open_, press, top_bits

CTX_BITS, WORD_BITS = 30, 20  # of a context within its bucket, and of the word that follows: its symbol and what tells it from others


ONE_SORT = 64 - CTX_BITS - WORD_BITS - 1  # bits of buckets that fit beside a request


def keys_of(symbol: np.ndarray, code: np.ndarray, word: np.ndarray, lens: np.ndarray, train: np.ndarray, bucket_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Each token's request (context, word, held out or not) and its bucket. word: uint32 hash of each token's word."""
    at = np.cumsum(lens) - lens
    one, two = np.zeros((2, len(code)), np.uint64)
    one[1:], two[2:] = word[:-1], word[:-2]
    one[at] = two[at] = 0
    two[(at + 1)[lens > 1]] = 0
    h = ((one + np.uint64(1)) * MUL ^ (two + np.uint64(3)) * NODE) * MUL
    h ^= h >> np.uint64(31)
    h *= NODE
    top = top_bits(h, bucket_bits + CTX_BITS)
    # the symbol, then hash bits of the word
    tail = (code * np.uint32(0x9E3779B1)) >> np.uint32(CODE_BITS - WORD_BITS + SYMBOL)
    low = (symbol.astype(np.uint64) << np.uint64(WORD_BITS - SYMBOL) | tail) << np.uint64(1) | (train == 0)
    return (top & np.uint64((1 << CTX_BITS) - 1)) << np.uint64(WORD_BITS + 1) | low, top >> np.uint64(CTX_BITS)


def sorted_requests(key: np.ndarray, bucket: np.ndarray, bucket_bits: int, order: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Requests and their buckets in order of both, and if asked for, the tokens in that order."""
    if bucket_bits > ONE_SORT:
        o = np.lexsort((key, bucket))
        return key[o], bucket[o], o
    shift = np.uint64(64 - ONE_SORT)
    whole = bucket << shift | key
    o = np.argsort(whole) if order else None
    whole = whole[o] if order else np.sort(whole)
    return whole & ((np.uint64(1) << shift) - np.uint64(1)), whole >> shift, o


def first_of(k: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones(min(1, len(k)), bool), (k[1:] != k[:-1]) | (b[1:] != b[:-1])])


def requests(key: np.ndarray, bucket: np.ndarray, bucket_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct requests in the order of buckets and keys, with their buckets and counts."""
    k, b, _ = sorted_requests(key, bucket, bucket_bits, False)
    start = np.flatnonzero(first_of(k, b))
    return k[start], b[start].astype(np.int64), np.diff(np.append(start, len(k)))


def places(key: np.ndarray, bucket: np.ndarray, bucket_bits: int) -> np.ndarray:
    """Each token's request, by its place among the distinct ones."""
    k, b, order = sorted_requests(key, bucket, bucket_bits, True)
    out = np.empty(len(k), np.int64)
    out[order] = np.cumsum(first_of(k, b)) - 1
    return out


def packed(key: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte of equal weight."""
    return press(np.diff(key, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(body: bytes) -> np.ndarray:
    planes = np.frombuffer(open_(body), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def level_of(n: np.ndarray, all_: np.ndarray) -> np.ndarray:
    """Strength of a prediction met n times in all_ occurrences of its context."""
    share = n / np.maximum(1, all_)
    only = np.where(n >= 4, 3, np.where(n >= 2, 2, 1))
    return np.where(n == 0, 0, np.where(n == all_, only, np.where(share >= 0.5, 4, np.where(share >= 0.2, 5, np.where(share >= 0.05, 6, 7))))).astype(np.uint8)


def merge_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Answers of a bucket, a byte per request: strength, agreeing bits of the symbol, and whether the word is the predicted one."""
    pdf = pdf.sort_values("chunk")
    keys = [unpacked(b) for b in pdf["keys"]]
    sizes = [len(k) for k in keys]
    key, count = np.concatenate(keys), np.concatenate([array(b, "<u4") for b in pdf["counts"]]).astype(np.int64)
    del keys
    count[(key & np.uint64(1)) == 1] = 0
    order = np.argsort(key, kind="stable")
    k = key[order]
    pair = k >> np.uint64(1)
    new = np.concatenate([[True], pair[1:] != pair[:-1]])
    start = np.flatnonzero(new)
    n, pair_of = np.add.reduceat(count[order], start), np.cumsum(new) - 1
    follows = (pair[start] & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    ctx = pair[start] >> np.uint64(WORD_BITS)
    fresh = np.concatenate([[True], ctx[1:] != ctx[:-1]])
    group, head = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
    all_ = np.add.reduceat(n, head)
    ranked = np.argsort(group.astype(np.int64) << 32 | ((1 << 32) - 1 - np.minimum(n, (1 << 32) - 1)), kind="stable")
    size = np.diff(np.append(head, len(group)))
    best, next_ = ranked[head], ranked[np.minimum(head + 1, len(group) - 1)]
    w1, n1 = follows[best], n[best]
    w2, n2 = np.where(size > 1, follows[next_], -1), np.where(size > 1, n[next_], 0)
    g, mine = group[pair_of], follows[pair_of]
    own = 1 - (k & np.uint64(1)).astype(np.int64)
    a1, a2 = n1[g] - own * (w1[g] == mine), n2[g] - own * (w2[g] == mine)
    other = a2 > a1
    said, times = np.where(other, w2[g], w1[g]), np.where(other, a2, a1)
    level = level_of(times, all_[g] - own)
    agree = agreeing((np.maximum(said, 0) >> (WORD_BITS - SYMBOL)).astype(np.uint8), (mine >> (WORD_BITS - SYMBOL)).astype(np.uint8))
    out = np.empty(len(k), np.uint8)
    out[order] = np.where(level > 0, level * 32 + agree * 2 + (said == mine), 0)
    cut = np.cumsum([0, *sizes])
    give_back()
    return pd.DataFrame({"chunk": pdf["chunk"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "said": [press(out[a:b].tobytes()) for a, b in zip(cut, cut[1:])]})
