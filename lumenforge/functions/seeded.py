"""Seeded values and shuffles as columns: the n-th value is computed from n, so nothing is drawn in turn.

The generator's state after n draws is seed + n * step, so its n-th value needs no
loop and no order of rows. A shuffle is a permutation of 0 .. size - 1 by Feistel rounds
on halves of a place's bits; a place that falls out of range goes round again until it
is back. So a row's new place, or the row at a place, is known without a sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The generator's step and multipliers.
STEP, ODD, LATE = 0x6D2B79F5, 1, 61
MASK, ROUNDS, TURNS = 0xFFFFFFFF, 6, 64


def _cut(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK))


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once; as plain text each step would hold the one before several times."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _times(a: Column, b: Column) -> Column:
    """The low 32 bits of a product, in halves, so that no long overflows."""
    high = (F.shiftright(a, 16) * b).bitwiseAND(F.lit(0xFFFF))
    return _cut(a.bitwiseAND(F.lit(0xFFFF)) * b + F.shiftleft(high, 16))


def bits32(seed: Column, n: Column) -> Column:
    """The n-th 32 bits, from n = 0; seed and n are whole numbers."""
    mixed = lambda a, b: _let(a, lambda x: _let(b, lambda y: _times(x, y)))
    late = lambda r: _let(r.bitwiseXOR(_cut(r + mixed(r.bitwiseXOR(F.shiftright(r, 7)), r.bitwiseOR(F.lit(LATE))))), lambda q: q.bitwiseXOR(F.shiftright(q, 14)))
    drawn = lambda t: _let(mixed(t.bitwiseXOR(F.shiftright(t, 15)), t.bitwiseOR(F.lit(ODD))), late)
    state = _let(_cut(n.cast("long") + 1), lambda m: _cut(seed.cast("long") + _times(m, F.lit(STEP))))
    return _let(state, drawn)


def uniform(seed: Column, n: Column) -> Column:
    """The n-th value in [0, 1)."""
    return bits32(seed, n) / F.lit(float(1 << 32))


def _halves(size: int) -> tuple[int, int]:
    bits = max(2, (size - 1).bit_length())
    return bits - bits // 2, bits // 2


def _walk(x: Column, size: int, seed: int, order: range) -> Column:
    """Rounds until a place is in range: fewer than half of all places are out, so turns run out for 1 row in 2^64."""
    step = lambda v, i: F.when((i == 0) | (v >= size), _rounds(v, size, seed, order)).otherwise(v)
    out = F.aggregate(F.sequence(F.lit(0), F.lit(TURNS)), x.cast("long"), step)
    return F.when(out < size, out).otherwise(F.raise_error(F.lit("a place is out of range after all turns")).cast("long"))


def _rounds(v: Column, size: int, seed: int, order: range) -> Column:
    """Each round changes one half of the bits by a value that the other half draws; the same rounds backwards undo it.

    A fold over the rounds' numbers, so that the expression has one of each parity.
    """
    low, high = _halves(size)

    def turn(x: Column, k: Column) -> Column:
        left, right = F.shiftright(x, low), x.bitwiseAND(F.lit((1 << low) - 1))
        own = F.lit(seed) + F.lit(7919) * (k + 1)
        odd = F.shiftleft(left, low).bitwiseOR(right.bitwiseXOR(bits32(own, left).bitwiseAND(F.lit((1 << low) - 1))))
        even = F.shiftleft(left.bitwiseXOR(bits32(own, right).bitwiseAND(F.lit((1 << high) - 1))), low).bitwiseOR(right)
        return F.when(k % 2 == 1, odd).otherwise(even)

    return F.aggregate(F.array(*[F.lit(k) for k in order]), v, turn)


def shuffled_place(place: Column, size: int, seed: int) -> Column:
    """The place of row ``place`` (0 .. size - 1) after the shuffle."""
    return _walk(place, size, seed, range(ROUNDS))


def row_at(place: Column, size: int, seed: int) -> Column:
    """The row that the shuffle puts at ``place``."""
    return _walk(place, size, seed, range(ROUNDS - 1, -1, -1))
