"""op3, op6, op7 against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from lumenforge.llm import decontam, simhash, suffixdedup
from lumenforge.llm.common import table
from lumenforge.llm.components import components

from . import cases


def repeats(rows, length):
    """rows: distinct (id, text); ids in order, nulls first, then by digest."""
    seen, out = set(), {}
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())
    for i, t in sorted({(r[0], r[1] or "") for r in rows}, key=key):
        b = t.encode()
        hit = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                hit[p : p + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for k in range(len(b)) if hit[k] and (k == 0 or not hit[k - 1]))
        out[(i, t)] = (len(b), sum(hit), runs, hashlib.sha256(bytes(x for x, h in zip(b, hit) if not h)).hexdigest())
    return Counter((i, *out[(i, t or "")]) for i, t in ((r[0], r[1]) for r in rows))


@pytest.mark.parametrize("ids", [True, False])
def test_repeats_match_brute_force(spark, ids):
    got = Counter(tuple(r) for r in suffixdedup.op3(cases.frame(spark, 4, ids)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == repeats(cases.rows(4, ids), 100)


def test_repeats_of_real_texts_and_long_documents(spark, small, monkeypatch):
    docs = table(spark, small, "documents").limit(120)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(tuple(r) for r in suffixdedup.op3(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == repeats(rows, 100)
    assert suffixdedup.op3(cases.empty(spark)).count() == 0


def test_segments_cut_long_texts_alike():
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 100, n, dtype=np.uint8)) for n in (0, 50, 99, 100, 101, 700, 3000)]

    def windows(most):
        out = {}
        for s in suffixdedup.segments(texts, 100, 40, most):
            for a, b, at in zip(s.start, s.end, s.at):
                for w in range(a, b):
                    out[(s.row[w], w + s.shift[w])] = at + s.shift[at]
        return out

    assert windows(1 << 20) == windows(150) and len(windows(150)) == sum(max(0, len(t) - 99) for t in texts)


def fingerprint(t, width=3):
    w = (t or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(rows):
    fps = [fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)].append(r[0])
    return Counter((r[0], f"{fps[i]:016x}", min(least[find(i)], default=None)) for i, r in enumerate(rows))


@pytest.mark.parametrize("ids", [True, False])
def test_simhash_matches_brute_force(spark, ids):
    got = Counter(tuple(r) for r in simhash.op6(cases.frame(spark, 5, ids)).collect())
    assert got == linked(cases.rows(5, ids))


def test_simhash_of_real_texts(spark, small):
    docs = table(spark, small, "documents")
    assert Counter(tuple(r) for r in simhash.op6(docs).collect()) == linked([(r.doc_id, r.text) for r in docs.collect()])
    assert simhash.op6(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("direct", [2048, 2])
def test_stars_are_exact(direct):
    rng = np.random.default_rng(1)
    f = np.unique(np.uint64(0xABCDEF0123000000) ^ (rng.integers(0, 1 << 24, 150).astype(np.uint64) & np.uint64(0x00030F0F)))
    u, v = simhash.star(f, direct=direct)
    root = dict(zip(u.tolist(), v.tolist()))
    todo, groups = set(f.tolist()), []
    while todo:
        group, edge = set(), [todo.pop()]
        while edge:
            x = edge.pop()
            group.add(x)
            new = {y for y in todo if (x ^ y).bit_count() <= 3}
            todo -= new
            edge += new
        groups.append(frozenset(group))
    got = defaultdict(set)
    for x in f.tolist():
        got[root.get(x, x)].add(x)
    assert {frozenset(g) for g in got.values()} == set(groups) and len(u) == len(f) - len(groups)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(8, 30)] + [(3, 3), (50, 49), (49, 50)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 7 for i in range(7, 30)}, 49: 49, 50: 49}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def hits(rows, items, window=10):
    phrase = defaultdict(set)
    for i, t in items:
        w = decontam.words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            phrase[tuple(w[k : k + window])].add(i)
    out = []
    for i, t in rows:
        w = decontam.words(t)
        hit, found = [False] * len(w), set()
        for n in {len(p) for p in phrase}:
            for k in range(len(w) - n + 1):
                if (got := phrase.get(tuple(w[k : k + n]))) is not None:
                    hit[k : k + n] = [True] * n
                    found |= {x for x in got if x is not None}
        out.append((i, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return Counter(out)


def test_words_follow_the_contract():
    import re

    t = "A-b_C d1\x7f é\x80Z\nstraße!İ"
    assert decontam.words(t) == [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))]


@pytest.mark.parametrize("blocks", [1 << 20, 60])
@pytest.mark.parametrize("ids", [True, False])
def test_decontamination_matches_brute_force(spark, ids, blocks, monkeypatch):
    rows = cases.rows(6, ids)
    long = next(r[1] for r in rows if r[1] and len(r[1]) > 20000)
    base = next(r[1] for r in rows if r[0] == 78)
    items = [("i1", " ".join(base.split()[5:30])), ("i2", "one"), (None, "two words"), ("i2", "the of x"), ("10", None), ("9", ""), ("z", " ".join(long.split()[100:115])), ("i1", " ".join(base.split()[5:30]))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    whole = decontam.contamination
    monkeypatch.setattr(decontam, "contamination", lambda d, b, **k: whole(d, b, shard_words=300, block_words=blocks, **k))
    got = Counter(tuple(r) for r in decontam.op7(cases.frame(spark, 6, ids), bench).collect())
    assert got == hits([(r[0], r[1]) for r in rows], items)


def test_decontamination_of_real_texts(spark, small):
    docs, bench = table(spark, small, "documents"), table(spark, small, "benchmark")
    want = hits([(r.doc_id, r.text) for r in docs.collect()], [(str(r.item_id), r.text) for r in bench.collect()])
    assert Counter(tuple(r) for r in decontam.op7(docs, bench).collect()) == want
    assert decontam.op7(cases.empty(spark), bench).count() == 0
    assert decontam.op7(docs, bench.limit(0)).filter("contaminated").count() == 0


def test_phrases_are_kept_small():
    """A block's phrases take some 50 bytes a word; every phrase has its items."""
    import random

    rng = random.Random(3)
    items = [(f"i{k % 900}", " ".join(f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(0, 200)))) for k in range(1000)] + [(None, "w1 w2 w3")]
    p, n = decontam.Phrases(items), sum(len(decontam.words(t)) for _, t in items)
    assert p.nbytes() <= 60 * n
    want = {}
    for i, t in items:
        w = [p.number[x] for x in decontam.words(t)]
        for k in range(max(1, len(w) - 9) if w else 0):
            want.setdefault(tuple(w[k : k + 10]), set()).add(i)
    got = {tuple(row): first + k for first, rows in p.table.values() for k, row in enumerate(rows.tolist())}
    assert set(got) == set(want)
    for phrase in rng.sample(sorted(want), 300):
        _, names = p.items(np.array([got[phrase]]))
        assert {p.names[k] for k in names} == want[phrase] - {None}


def test_index_meets_all_pairs_within_three_bits_and_the_count_filter_rejects():
    """Of 14 keys one is shared whenever 5 bytes are; pairs that share only the 4 bytes of a key are dropped by their tally."""
    from itertools import combinations

    masks = [m & (1 << 64) - 1 for m in simhash.byte_masks()]
    sets = [{p for p in range(8) if m >> (8 * p) & 255} for m in masks]
    assert len(masks) == 14 and all(len(s) == 4 for s in sets)
    assert all(any(s <= set(five) for s in sets) for five in combinations(range(8), 5))
    rng = np.random.default_rng(5)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63)) << 1
        b = a
        for bit in rng.choice(64, 3, replace=False):
            b ^= 1 << int(bit)
        assert any(a & m == b & m for m in masks)
    a = np.array([0], np.uint64)
    four = np.array([0x0101010100000000], np.uint64)  # 4 bits in 4 bytes
    assert any(int(four[0]) & m == 0 for m in masks) and not simhash.near(a, four, 5, 64).any() and simhash.near(a, four, 4, 64).all()


def test_benchmark_with_clashing_columns(spark):
    docs = cases.frame(spark, 6)
    items = [("i1", "the of x"), ("i2", "one"), (None, "two words")]
    plain = spark.createDataFrame(items, "item_id string, text string")
    clash = spark.createDataFrame([(*r, 1, "x", None) for r in items], "item_id string, text string, doc_id long, dc_words string, source string")
    assert Counter(map(tuple, decontam.op7(docs, plain).collect())) == Counter(map(tuple, decontam.op7(docs, clash).collect()))
