"""Spelling of rare words bit by bit, by mixed predictors over hashed contexts of bytes.

Words are coded highest bit first, with a space after the last byte. Predictors
look up their hashed context (the last 1, 2, 3 or 5 bytes of the word, or its last
32) and the bits of this byte so far; counts come from every word that training
holds once, each left out of its own. A gate, the set of contexts seen, picks the
weights by which logits add up. Weights and the map from mixed to observed
probability are refined after every block, on the way, by words of training only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ORDERS = (1, 2, 3, 5, 0)  # 0: the last WINDOW bytes
WINDOW, LONGEST = 32, 1024
GATES, STEPS, LIMIT = 1 << len(ORDERS), 33, 8.0
MUL, NODE, MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
UNMUL = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOGS = np.log(np.arange(65537, dtype=np.float32) + np.float32(0.2))


def pieces(words: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Closed words in stretches of at most LONGEST bytes, each behind the WINDOW bytes before it; how many bytes those are; and the word of each. So no context ends at a cut."""
    out, skip, owner = [], [], []
    for k, w in enumerate(words):
        w += b" "
        for a in range(0, len(w), LONGEST):
            s = min(a, WINDOW)
            out.append(w[a - s : a + LONGEST])
            skip.append(s)
            owner.append(k)
    return out, np.array(skip, np.int64), np.array(owner, np.int64)


class Paths:
    """For each predictor the slot of every bit of closed words, and the bits; arrays [8, bytes]."""

    def __init__(self, words: list[bytes], slot_bits: int) -> None:
        parts, skip, owner = pieces(words)
        flat = np.frombuffer(b"".join(parts), np.uint8)
        size = np.array([len(w) for w in parts], np.int64)
        first = np.cumsum(size) - size
        since = np.arange(len(flat)) - np.repeat(first, size)
        keep = since >= np.repeat(skip, size)
        most = int(size.max(initial=1)) + 1
        power, unpower = (np.cumprod(np.full(most, m, np.uint64)) for m in (MUL, UNMUL))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power[since], dtype=np.uint64)])
        reach = np.minimum(since, WINDOW)
        at = np.arange(len(flat))
        window = (total[:-1] - total[at - reach]) * unpower[since - reach]
        last = np.zeros(len(flat), np.uint64)
        for j in range(1, max(ORDERS) + 1):
            last[j:] |= np.where(since[j:] >= j, flat[:-j], 0).astype(np.uint64) << np.uint64(8 * (j - 1))
        ctx = [((last & np.uint64((1 << (8 * n)) - 1) if n else window + reach.astype(np.uint64)) + np.uint64(k + 1)) * MUL for k, n in enumerate(ORDERS)]
        ctx, flat = [c[keep] for c in ctx], flat[keep]
        self.word = np.repeat(owner, size)[keep]
        top, down = flat.astype(np.uint64) | np.uint64(256), np.uint64(64 - slot_bits)
        self.bit = np.empty((8, len(flat)), np.uint8)
        self.slot = np.empty((len(ORDERS), 8, len(flat)), np.uint32)
        for b in range(8):
            node = (top >> np.uint64(8 - b)) * NODE
            self.bit[b] = (flat >> np.uint8(7 - b)) & np.uint8(1)
            for k in range(len(ORDERS)):
                self.slot[k, b] = ((ctx[k] ^ node) * MIX) >> down


def blocks(words: list[bytes], most: int) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of words of about ``most`` words or 16 bytes each."""
    at, size = 0, 0
    for k, w in enumerate(words):
        if k > at and (k - at >= most or size + len(w) > 16 * most):
            yield at, words[at:k]
            at, size = k, 0
        size += len(w)
    if at < len(words):
        yield at, words[at:]


def count_slots(words: list[bytes], slot_bits: int, out: np.ndarray) -> None:
    """Add the zeros and ones seen in each slot to uint32[predictors, 2 << slot_bits]."""
    for _, part in blocks(words, 8_000):
        p = Paths(part, slot_bits)
        for k in range(len(ORDERS)):
            np.add.at(out[k], ((p.slot[k].astype(np.int64) << 1) + p.bit).reshape(-1), np.uint32(1))


def refine_map(seen: np.ndarray) -> np.ndarray:
    """Logits by gate and cell, drawn to the cell's own logit where little was seen."""
    centre = np.linspace(-LIMIT, LIMIT, STEPS)
    prior = 20.0 / (1 + np.exp(-centre))
    return np.log((seen[..., 1] + prior + 1e-3) / (seen[..., 0] + 20.0 - prior + 1e-3)).astype(np.float32)


def refined(s: np.ndarray, gate: np.ndarray, refine: np.ndarray) -> np.ndarray:
    """Half the mix, half what was observed at such a mix."""
    at = (s + np.float32(LIMIT)) * np.float32((STEPS - 1) / (2 * LIMIT))
    low = np.minimum(at.astype(np.int32), STEPS - 2)
    f, flat = at - low, refine.reshape(-1)
    cell = gate.astype(np.int32) * STEPS + low
    r0 = flat.take(cell)
    return np.float32(0.5) * (s + r0 + (flat.take(cell + 1) - r0) * f)


def cell_of(s: np.ndarray, gate: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (gate.astype(np.int64) * STEPS + np.rint((s + LIMIT) * ((STEPS - 1) / (2 * LIMIT))).astype(np.int64)) * 2 + bit


def bit_cost(z: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Natural log of 1 / P(bit) at logit z. Logits are mixed to within LIMIT and maps count fewer than 2^64 bits, so the plain form doesn't overflow."""
    return np.log(np.float32(1) + np.exp(z * (np.float32(1) - np.float32(2) * bit.astype(np.float32))))


class Speller:
    """Mixer of one bucket's words."""

    def __init__(self, table: np.ndarray, rate: float = 0.02) -> None:
        """table: uint16[predictors, slots, 2]."""
        self.slot_bits, self.rate = int(table.shape[1]).bit_length() - 1, np.float32(rate)
        self.pairs = np.ascontiguousarray(table).view("<u4")[..., 0]
        self.weight = np.full((len(ORDERS) + 1, GATES), 0.25, np.float32)
        self.weight[-1] = 0.0
        self.seen = np.zeros((GATES, STEPS, 2))

    def run(self, words: list[bytes], train: bool) -> np.ndarray:
        """Natural log probability of each word; train: the words are in the counts, and weights move after each block."""
        out = np.zeros(len(words))
        refine = refine_map(self.seen)
        for a, part in blocks(words, 400 if train else 4000):
            p = Paths(part, self.slot_bits)
            bit = p.bit.reshape(-1)
            x, gate = np.empty((len(ORDERS) + 1, len(bit)), np.float32), np.zeros(len(bit), np.uint8)
            for k in range(len(ORDERS)):
                pair = self.pairs[k].take(p.slot[k].reshape(-1))
                n0, n1 = pair & np.uint32(0xFFFF), pair >> np.uint32(16)
                if train:
                    n1 -= np.minimum(n1, bit)
                    n0 -= np.minimum(n0, 1 - bit)
                gate |= ((n0 | n1) > 0).astype(np.uint8) << np.uint8(k)
                np.subtract(LOGS.take(n1), LOGS.take(n0), out=x[k])
            x[-1], gate = 0.3, gate.astype(np.intp)
            np.clip(x, -LIMIT, LIMIT, out=x)
            s = np.zeros(len(bit), np.float32)
            for k in range(len(x)):
                s += x[k] * self.weight[k].take(gate)
            np.clip(s, -LIMIT, LIMIT, out=s)
            cost = bit_cost(refined(s, gate, refine), bit).reshape(8, -1).sum(0)
            out[a : a + len(part)] -= np.bincount(p.word, cost, len(part))
            if train:
                err = bit.astype(np.float32) - 1 / (1 + np.exp(-s))
                hits = np.sqrt(np.maximum(1.0, np.bincount(gate, minlength=GATES)))
                for k in range(len(x)):
                    self.weight[k] += self.rate * (np.bincount(gate, x[k] * err, GATES) / hits).astype(np.float32)
                self.seen += np.bincount(cell_of(s, gate, bit), minlength=self.seen.size).reshape(self.seen.shape)
                refine = refine_map(self.seen)
        return out
