"""Mixing of bit predictors over the symbols of words, and of predicted words behind them.

Each bit of each token's symbol gets a logit from

* context predictors, by the zeros and ones that training met behind the same bits
  of the symbol: (0) anywhere, (1) after the word before, in the row that the first
  ``ROWS`` bits of its code name, (2) after the last two usual words of the document,
  in the row that their hash names;
* the word that the two words before predict in the whole corpus (``lmpairs``);
* the word that stood last in this document behind the same word.

A predicted word counts for as long as its symbol agrees; how often predictions of
their strength hold at that bit is observed. A gate (which predictions are alive)
picks the weights by which logits add up, and a map from mixed to observed probability
comes last. Behind a symbol that words share, a bit says whether the word is the
predicted one, for each prediction still alive, by how often that held; else the word
has its share of the symbol's count.

Weights are first refined on a few training texts, after every block of bits. From there
one step of Newton's method over every token of every training text leads to the weights,
and the maps are counted over the same tokens; sums of chunks add up, so it doesn't matter
how texts are dealt. With these weights each document starts, and refines them for itself as
it goes on, so a document's cost depends on nothing but it and the training texts. A
training text's own words are left out of its counts.
"""

from __future__ import annotations

import numpy as np

from .lmspell import LIMIT, LOGS, MIX, MUL, NODE, STEPS, bit_cost, refine_map
from .lmwords import CODE_BITS, SYMBOL

ROWS, CONTEXTS, INPUTS = 14, 3, 6
GATES, BLOCK = 8, 1 << 15
FIRST = 128  # tokens after which a document's weights move for the first time
LEVELS = 8  # strengths of a prediction, 0: none
STRONG = np.array([0, 1, 2, 3, 2, 1, 1, 1], np.uint8)
NODES = 1 << SYMBOL


def firsts(lens: np.ndarray) -> np.ndarray:
    """For each token the place of its document's first one."""
    return np.repeat(np.cumsum(lens) - lens, lens)


def rows_of(code: np.ndarray, usual: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of both contexts for each token of documents end to end."""
    first, at = firsts(lens), np.arange(len(code))
    before = np.empty(len(code), np.int64)
    before[1:] = code[:-1] >> np.uint32(CODE_BITS - ROWS)
    before[at == first] = (1 << ROWS) - 1
    last = np.maximum.accumulate(np.where(usual, at, -1))
    last = np.concatenate([[-1], last[:-1]])  # the last usual word before each token
    none = last < first
    last[none] = 0
    second = last[last]
    word = (code >> np.uint32(16)).astype(np.uint64) + np.uint64(1)
    one, two = np.where(none, np.uint64(0), word[last]), np.where(none | none[last] | (second < first) | (second == last), np.uint64(0), word[second])
    return before, ((one * MUL ^ two * NODE) * MIX >> np.uint64(64 - ROWS)).astype(np.int64)


def count(symbol: np.ndarray, rows: tuple[np.ndarray, np.ndarray], train: np.ndarray, table: np.ndarray) -> None:
    """Add the training tokens' symbols to uint32[2, 1 << ROWS, NODES]."""
    here = np.flatnonzero(train)
    s = symbol[here].astype(np.int64)
    for k in range(2):
        np.add.at(table[k].reshape(-1), (rows[k][here] << SYMBOL) + s, np.uint32(1))


def as_bits(symbols: np.ndarray) -> np.ndarray:
    """uint16[rows, NODES, 2], the zeros and ones behind each run of first bits, from counts of symbols; where there are more than 16 bits hold, both are scaled alike."""
    out = np.zeros((len(symbols), NODES, 2), "<u2")
    for j in range(SYMBOL):
        c = symbols.reshape(len(symbols), 1 << j, 2, -1).sum(-1, dtype=np.int64)
        scale = np.minimum(1.0, 65535.0 / np.maximum(1, c.max(-1)))
        out[:, 1 << j : 2 << j] = np.minimum(65535, np.ceil(c * scale[..., None]))
    return out


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first bits of two symbols are alike."""
    return COMMON[a ^ b]


COMMON = np.array([SYMBOL - int(x).bit_length() for x in range(NODES)], np.uint8)


def local(t: np.ndarray, symbol: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strength, agreeing bits and truth of the word that stood last in the document behind the same word."""
    n = len(t)
    level, agree, hit = np.zeros(n, np.uint8), np.zeros(n, np.uint8), np.zeros(n, bool)
    inner = np.ones(n, bool)
    inner[np.cumsum(lens) - lens] = False
    inner = np.flatnonzero(inner)
    if not len(inner):
        return level, agree, hit
    doc = np.repeat(np.arange(len(lens)), lens)
    key = doc[inner].astype(np.int64) << 32 | t[inner - 1].astype(np.int64)
    order = np.argsort(key, kind="stable")
    k, where = key[order], inner[order]
    same = np.concatenate([[False], k[1:] == k[:-1]])
    at = np.arange(len(k))
    times = at - np.maximum.accumulate(np.where(same, 0, at))
    again = np.flatnonzero(same)
    now, then = where[again], where[again - 1]
    level[now] = np.minimum(times[again], 3)
    agree[now], hit[now] = agreeing(symbol[now], symbol[then]), t[now] == t[then]
    return level, agree, hit


def no_sums() -> dict[str, np.ndarray]:
    """What ``Mixer.gather`` adds to; sums of chunks are added by name."""
    shapes = {"slope": (SYMBOL, GATES, INPUTS), "curve": (SYMBOL, GATES, INPUTS, INPUTS), "seen": (SYMBOL * GATES, STEPS, 2), "held": (2, SYMBOL, LEVELS, 2), "whole": (2, LEVELS, 4, 2)}
    return {name: np.zeros(shape) for name, shape in shapes.items()}


class Mixer:
    """Weights and maps on their way through texts."""

    def __init__(self, whole: np.ndarray, table: np.ndarray, rate: float = 0.02) -> None:
        """whole: uint16[1, NODES, 2], table: uint16[2, 1 << ROWS, NODES, 2], zeros and ones."""
        self.rate = np.float32(rate)
        self.pairs = [whole.view("<u4").reshape(-1), *(t.view("<u4").reshape(-1) for t in table)]
        self.weight = np.full((SYMBOL, INPUTS, GATES), 0.3, np.float32)
        self.weight[:, -1] = 0.0
        self.seen = np.zeros((SYMBOL * GATES, STEPS, 2))
        self.held = np.ones((2, SYMBOL, LEVELS, 2))  # how often predictions failed and held at a bit
        self.whole = np.ones((2, LEVELS, 4, 2))  # and behind the symbol, by both strengths

    def cost(self, symbol: np.ndarray, length: np.ndarray, rows: tuple, train: np.ndarray, said: list, inner: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Natural log of 1 / P of each token.

        train: 1 for tokens of training texts; said: strength, agreeing bits and truth
        of both predictions; inner: log of 1 / P behind the symbol if nothing is
        predicted; shared: whether other words may have the symbol.
        """
        out = np.zeros(len(symbol))
        for a in range(0, len(symbol), BLOCK):
            s = slice(a, a + BLOCK)
            order = np.argsort(SYMBOL - length[s], kind="stable")
            many = len(order) - np.cumsum(np.bincount(length[s], minlength=SYMBOL + 1))[:SYMBOL]
            here = a + order
            sym, own = symbol[here].astype(np.intp), train[here].astype(np.uint32)
            base = [np.zeros(len(here), np.intp), *(r[here] << SYMBOL for r in rows)]
            told = [(lv[here], ag[here]) for lv, ag, _ in said]
            total = np.zeros(len(here), np.float32)
            for j, n in enumerate(many.tolist()):
                if n:
                    total[:n] += self.step(sym[:n], [b[:n] for b in base], own[:n], [(lv[:n], ag[:n]) for lv, ag in told], j)
            out[here] = total
            out[s] += self.behind(train[s] == 1, [tuple(x[s] for x in one) for one in said], inner[s], shared[s])
        return out

    def state(self) -> dict[str, np.ndarray]:
        """What was learned, a few KB."""
        return {"weight": self.weight, "seen": self.seen, "held": self.held, "whole": self.whole}

    def resume(self, state: dict[str, np.ndarray]) -> None:
        for name, value in state.items():
            setattr(self, name, value)

    def gather(self, sums: dict[str, np.ndarray], symbol: np.ndarray, length: np.ndarray, rows: tuple, said: list, shared: np.ndarray) -> None:
        """Add training tokens to ``sums`` (see ``no_sums``): slopes and curvatures of their cost at the weights as they are, and the maps' counts."""
        for a in range(0, len(symbol), BLOCK):
            s = slice(a, a + BLOCK)
            here = a + np.argsort(SYMBOL - length[s], kind="stable")
            many = len(here) - np.cumsum(np.bincount(length[s], minlength=SYMBOL + 1))[:SYMBOL]
            sym, own = symbol[here].astype(np.intp), np.ones(len(here), np.uint32)
            base = [np.zeros(len(here), np.intp), *(r[here] << SYMBOL for r in rows)]
            told = [(lv[here], ag[here]) for lv, ag, _ in said]
            for j, n in enumerate(many.tolist()):
                if n:
                    self._gather(sums, sym[:n], [b[:n] for b in base], own[:n], [(lv[:n], ag[:n]) for lv, ag in told], j)
        left = shared.copy()
        for k in range(2):
            level, agree, hit = said[k]
            rest = np.flatnonzero(left & (level > 0) & (agree == SYMBOL))
            cell = (level[rest].astype(np.int64) * 4 + np.minimum(said[1 - k][0][rest], 3)) * 2 + hit[rest]
            sums["whole"][k] += np.bincount(cell, minlength=LEVELS * 8).reshape(LEVELS, 4, 2)
            left[rest[hit[rest]]] = False

    def _gather(self, sums: dict[str, np.ndarray], sym: np.ndarray, base: list, own: np.ndarray, told: list, j: int) -> None:
        x, gate, bit, alive = self._inputs(sym, base, own, told, j)
        order = np.argsort(gate.astype(np.uint8), kind="stable")
        cuts = np.cumsum(np.bincount(gate, minlength=GATES)).tolist()
        x, gate, bit = x.take(order, axis=1).astype(np.float64), gate.take(order), bit.take(order)
        runs = [(g, slice(a, b)) for g, (a, b) in enumerate(zip([0, *cuts], cuts)) if b > a]
        s = np.empty(len(bit))
        for g, part in runs:
            np.einsum("k,kn->n", self.weight[j, :, g].astype(np.float64), x[:, part], out=s[part])
        s = np.clip(s, -LIMIT, LIMIT, out=s).astype(np.float32)
        p = 1 / (1 + np.exp(-s))
        err, bent = (bit - p).astype(np.float64), x * (p * (1 - p))
        for g, part in runs:
            sums["slope"][j, g] += np.einsum("kn,n->k", x[:, part], err[part])
            for k in range(INPUTS):
                row = np.einsum("kn,n->k", x[k:, part], bent[k, part])
                sums["curve"][j, g, k, k:] += row
                sums["curve"][j, g, k + 1 :, k] += row[1:]
        sums["seen"] += np.bincount(self._cell(s, gate, j) * 2 + bit, minlength=self.seen.size).reshape(self.seen.shape)
        for k, ((_, agree), lives) in enumerate(zip(told, alive)):
            sums["held"][k, j] += np.bincount(lives * np.uint8(2) + (agree > j), minlength=2 * LEVELS).reshape(LEVELS, 2)

    def settle(self, sums: dict[str, np.ndarray]) -> None:
        """Take the step that the sums of all training tokens call for, and their maps. Weights are rounded, so the order of sums doesn't show."""
        step = np.linalg.solve(sums["curve"] + np.eye(INPUTS), sums["slope"][..., None])[..., 0]
        self.weight = np.round(self.weight + np.clip(step, -1, 1).transpose(0, 2, 1), 4).astype(np.float32)
        self.seen, self.held, self.whole = sums["seen"], 1 + sums["held"], 1 + sums["whole"]

    def cost_apart(self, symbol: np.ndarray, length: np.ndarray, rows: tuple, train: np.ndarray, said: list, inner: np.ndarray, shared: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """As ``cost``, but each document by itself: all start from the weights as they are, and a document's own
        move after its first ``FIRST`` tokens and then whenever it has twice as many. Maps stay as they are."""
        out = self.behind(None, said, inner, shared)
        doc, place = np.repeat(np.arange(len(lens)), lens), np.arange(len(symbol)) - firsts(lens)
        long = lens > FIRST
        slot = np.where(long, np.cumsum(long), 0)[doc]  # 0: too short to move
        own = np.zeros((SYMBOL, INPUTS, int(long.sum()) + 1, GATES), np.float32)
        refined, low, high = refine_map(self.seen).reshape(-1), 0, FIRST
        while True:
            here = np.flatnonzero((place >= low) & (place < high)) if low else np.flatnonzero(place < high)
            if not len(here):
                return out
            here = here[np.argsort(SYMBOL - length[here], kind="stable")]
            many = len(here) - np.cumsum(np.bincount(length[here], minlength=SYMBOL + 1))[:SYMBOL]
            sym, mine, at = symbol[here].astype(np.intp), train[here].astype(np.uint32), slot[here]
            moves = lens[doc[here]] > high  # a document's last stretch has nothing behind it that its weights could move for
            base = [np.zeros(len(here), np.intp), *(r[here] << SYMBOL for r in rows)]
            told = [(lv[here], ag[here]) for lv, ag, _ in said]
            total = np.zeros(len(here), np.float32)
            for j, n in enumerate(many.tolist()):
                if n:
                    total[:n] += self._step_apart(sym[:n], [x[:n] for x in base], mine[:n], [(lv[:n], ag[:n]) for lv, ag in told], j, at[:n] * GATES, np.flatnonzero(moves[:n]), own[j], refined)
            out[here] += total
            low, high = high, 2 * high

    def _step_apart(self, sym: np.ndarray, base: list, mine: np.ndarray, told: list, j: int, place: np.ndarray, moves: np.ndarray, own: np.ndarray, refined: np.ndarray) -> np.ndarray:
        """place: of each token's document among the weights; moves: the tokens by which its weights move."""
        x, gate, bit, _ = self._inputs(sym, base, mine, told, j)
        cell, s = place + gate, np.zeros(len(sym), np.float32)
        for k in range(INPUTS):
            s += x[k] * (self.weight[j, k] + own[k]).reshape(-1).take(cell)
        np.clip(s, -LIMIT, LIMIT, out=s)
        z = np.float32(0.5) * (s + refined.take(self._cell(s, gate, j)))
        if len(moves):
            err, cell = (bit.take(moves) - 1 / (1 + np.exp(-s.take(moves)))).astype(np.float32), cell.take(moves)
            size = own[0].size
            scale = self.rate / np.sqrt(np.maximum(1.0, np.bincount(cell, minlength=size)))
            for k in range(INPUTS):
                own[k] += (scale * np.bincount(cell, x[k].take(moves) * err, size)).astype(np.float32).reshape(-1, GATES)
        return bit_cost(z, bit)

    @staticmethod
    def _cell(s: np.ndarray, gate: np.ndarray, j: int) -> np.ndarray:
        return (gate + GATES * j) * STEPS + ((s + np.float32(LIMIT)) * np.float32((STEPS - 1) / (2 * LIMIT)) + np.float32(0.5)).astype(np.int32)

    def _inputs(self, sym: np.ndarray, base: list, own: np.ndarray, told: list, j: int) -> tuple:
        """The predictors' logits of the j-th bits, their gates, the bits, and which predictions are alive."""
        n, bit = len(sym), ((sym >> (SYMBOL - 1 - j)) & 1).astype(np.uint32)
        node = (sym >> (SYMBOL - j)) + (1 << j)
        ones = own & bit
        zeros, one = own ^ ones, bit.astype(np.uint8)
        x = np.empty((INPUTS, n), np.float32)
        for k in range(CONTEXTS):
            pair = self.pairs[k].take(base[k] + node)
            np.subtract(LOGS.take((pair >> np.uint32(16)) - ones), LOGS.take((pair & np.uint32(0xFFFF)) - zeros), out=x[k])
        alive = []
        for k, (level, agree) in enumerate(told):
            lives = level * (agree >= j)
            strength = np.log(self.held[k, j, :, 1] / self.held[k, j, :, 0]).astype(np.float32)
            strength[0] = 0.0
            # a prediction says this bit, unless it ends here
            signs = np.stack([-strength, strength]).reshape(-1)
            x[CONTEXTS + k] = signs.take(lives + np.uint8(LEVELS) * (one ^ (agree == j)))
            alive.append(lives)
        x[-1] = 0.3
        return x, (STRONG.take(alive[0]) + np.uint8(4) * (alive[1] > 0)).astype(np.int32), bit, alive

    def step(self, sym: np.ndarray, base: list, own: np.ndarray, told: list, j: int) -> np.ndarray:
        """Cost of the j-th bits of a block; then weights and maps move."""
        x, gate, bit, alive = self._inputs(sym, base, own, told, j)
        w = self.weight[j]
        s = np.zeros(len(sym), np.float32)
        for k in range(INPUTS):
            s += x[k] * w[k][gate]
        np.clip(s, -LIMIT, LIMIT, out=s)
        cell = self._cell(s, gate, j)
        # half the mix, half what was observed at such a mix
        z = np.float32(0.5) * (s + refine_map(self.seen).reshape(-1)[cell])
        cost = bit_cost(z, bit)
        mine = own.astype(np.float32)
        err = (bit.astype(np.float32) - 1 / (1 + np.exp(-s))) * mine
        some = np.flatnonzero(gate)
        g = gate[some]
        step = np.stack([np.bincount(g, (x[k] * err)[some], GATES) for k in range(INPUTS)])
        step[:, 0] = x.astype(np.float32) @ err - step.sum(1)
        hits = np.bincount(gate, mine, GATES)
        self.weight[j] += self.rate * (step / np.sqrt(np.maximum(1.0, hits))).astype(np.float32)
        self.seen += np.bincount(cell * 2 + bit, mine, self.seen.size).reshape(self.seen.shape)
        for k, ((_, agree), lives) in enumerate(zip(told, alive)):
            self.held[k, j] += np.bincount(lives * np.uint8(2) + (agree > j), mine, 2 * LEVELS).reshape(LEVELS, 2)
        return cost

    def behind(self, own: np.ndarray | None, said: list, inner: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """Cost behind the symbols of a block; own: the tokens by which maps move, if they do."""
        cost, left = np.zeros(len(inner)), shared.copy()
        for k in range(2):
            level, agree, hit = said[k]
            rest = np.flatnonzero(left & (level > 0) & (agree == SYMBOL))
            lv, other, got = level[rest], np.minimum(said[1 - k][0][rest], 3), hit[rest]
            odds = self.whole[k]
            p = (odds[..., 1] / odds.sum(-1))[lv, other]
            cost[rest] -= np.log(np.where(got, p, 1 - p))
            left[rest[got]] = False
            if own is None:
                continue
            cell = ((lv.astype(np.int64) * 4 + other) * 2 + got)[own[rest]]
            odds += np.bincount(cell, minlength=odds.size).reshape(odds.shape)
        # what shares no symbol has no cost here
        return cost + np.where(left, inner, 0.0)
