"""Targets are met to the word by few and long slots."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenforge.llm import mixing


@pytest.mark.parametrize("slots", [8, 64, 4096])
def test_small_sources_meet_targets_at_any_number_of_slots(spark, slots):
    sizes = {"a": [90_000, 45_000], "b": [3, 1, 0, 7], "c": [40, 60], "d": [5700], None: [1]}
    docs = spark.createDataFrame([(k, "w " * n, s) for s, ns in sizes.items() for k, n in enumerate(ns)], "doc_id long, text string, source string")
    plan = mixing.mix(docs.repartition(3), slots=slots)
    out = plan["documents"].collect()
    assert len(out) == sum(map(len, sizes.values()))
    place = {s: [] for s in sizes}
    for r in out:
        place[r.source] += [(r.doc_id, w) for w in range(r.start, r.start + r.size)]
    want = Counter()
    for r in plan["schedule"].collect():
        where = {w: i for i, w in place[r.source]}
        for w in range(r.begin, r.end):
            want[(r.source, where[w % len(where)])] += 1
    assert {(r.source, r.doc_id): r.taken for r in out if r.taken} == dict(want)
    for s in sizes:
        mine = [r for r in out if r.source == s]
        assert sum(r.taken for r in mine) == int(mine[0].target + 0.5) and all(r.taken <= 3 * r.size for r in mine)
    assert sum(r.taken for r in out if r.source == "b") == 33


def test_another_sequence_of_points_mixes_otherwise(spark):
    """Targets are met all the same, but which documents give, and in which slot, is the points' choice."""
    docs = spark.createDataFrame([(k, "w " * (1 + k % 9), "abc"[k % 3 if k < 60 else 0]) for k in range(300)], "doc_id long, text string, source string")

    def corput(j):
        bits = [F.shiftright(j, b).bitwiseAND(F.lit(1)).cast("double") * F.lit(2.0 ** -(b + 1)) for b in range(22)]
        return sum(bits[1:], bits[0])

    seen = []
    for point in (None, corput, lambda j: F.lit(0.5) + j * 0):
        plan = mixing.mix(docs, slots=64, point=point)
        rows = plan["documents"].collect()
        of = {s: [r for r in rows if r.source == s] for s in "abc"}
        assert all(sum(r.taken for r in mine) == int(mine[0].target + 0.5) for mine in of.values()) and all(r.taken <= 3 * r.size for r in rows)
        parts = plan["parts"].collect()
        given = Counter()
        for r in parts:
            given[r.doc_id] += r["last"] - r["first"]
        assert {r.doc_id: r.taken for r in rows if r.taken} == dict(given)
        block = {r.j: (r.source, r.end - r.begin) for r in plan["schedule"].collect()}
        filled = Counter()
        for r in parts:
            assert block[r.slot][0] == r.source
            filled[r.slot] += r["last"] - r["first"]
        assert dict(filled) == {j: n for j, (_, n) in block.items()}
        seen.append(({r.doc_id: r.taken for r in rows}, {j: s for j, (s, _) in block.items()}))
    assert all(a[0] != b[0] and a[1] != b[1] for a, b in zip(seen, seen[1:]))


def test_prefixes_hold_each_sources_share(spark):
    docs = spark.createDataFrame([(k, "w " * 50, "abc"[k % 3]) for k in range(900)], "doc_id long, text string, source string")
    plan = mixing.mix(docs, slots=1 << 10)
    slots = sorted((r.j, r.source, r.end - r.begin) for r in plan["schedule"].collect())
    target = {r.source: r.target for r in plan["documents"].collect()}
    for n in (16, 100, 333, 900):
        head = Counter()
        for _, s, size in slots[:n]:
            head[s] += size
        whole = sum(head.values())
        assert all(abs(head[s] / whole - t / sum(target.values())) < 4 / n for s, t in target.items())
