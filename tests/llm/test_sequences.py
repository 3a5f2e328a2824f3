"""op11, op12 and op13: clusters, byte-level BPE and periodic runs."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

import public_tokenizers
from lumenforge.llm import clusters, runs, wordbpe
from lumenforge.llm.common import table

from . import cases

# --- op13 -----------------------------------------------------------------------------------


def plain_runs(w, least=12):
    """Every stretch of equal neighbours at distance q, for every q; of equal stretches the smallest q."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in out.items())


def plain_op13(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    gone = {k for a, m, q in found for k in range(a + q, a + m)}
    lines = "".join(f"{a},{m},{q}\n" for a, m, q in found)
    kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
    return (doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("warm", [1, 2, 4])
@pytest.mark.parametrize("least", [2, 12])
def test_runs_are_those_of_all_distances(warm, least):
    rng = random.Random(warm * 100 + least)
    for _ in range(300):
        docs = []
        for _ in range(rng.randint(1, 4)):
            w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randint(0, 60))]
            if w and rng.random() < 0.6:
                a = rng.randrange(len(w))
                p = 1 + (len(w) - a) // rng.randint(2, 8)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            docs.append(w)
        flat = np.array([x for d in docs for x in d], np.int64)
        assert runs.find(flat, [len(d) for d in docs], least, warm) == [plain_runs(d, least) for d in docs]


def test_long_periods_cost_little():
    """A position leaves its class a logarithm's number of times."""
    w = np.random.default_rng(0).integers(0, 1000, 60_000)
    a, p = 20_000, 8_001
    w = np.where(np.arange(60_000) < a, w, w[np.minimum(a + (np.arange(60_000) - a) % p, 59_999)])
    assert runs.find(w, [60_000]) == [[(20_000, 40_000, 8_001)]]
    assert runs.find(np.zeros(60_000, np.int64), [60_000]) == [[(0, 60_000, 1)]]


@pytest.mark.parametrize("ids", [True, False])
def test_op13_on_odd_documents(spark, ids):
    rows = cases.rows(3, ids) + [(k, " ".join(random.Random(k).choices("ab c dé".split(), k=40)), *[None] * 23) for k in range(900, 1100)]
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(3)
    got = [tuple(r) for r in runs.op13(docs).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(got, key=key) == sorted((plain_op13(r[0], r[1]) for r in rows), key=key)
    assert sum(r[1] > 0 for r in got) > 5
    assert runs.op13(cases.empty(spark)).count() == 0


def test_runs_whole_results(spark):
    docs = spark.createDataFrame([(1, "x a b a b a b a b a b a b y"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: ([tuple(x) for x in r.runs], r.collapsed) for r in runs.find_runs(docs).collect()}
    assert got == {1: ([(1, 12, 2)], "x a b y"), 2: ([], ""), 3: ([], "")}


# --- op12 -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def whole():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=wordbpe.ranks_of(wordbpe.default_ranks()), special_tokens={})


def test_texts_are_cut_as_the_library_cuts(whole):
    """A vocabulary of pieces' own bytes can't show where cuts are, but merges don't cross them: every piece's ids, in a row, are the text's."""
    rng = random.Random(1)
    alphabet = ["a", "bc", "'s", "'", "ll", " ", "  ", "\t", "\n", "\n\n", "\x1c", "\x85", " ", "　", "́", "é", "ß", "中", "文", "🙂", "՘", "₏", "1", "٣", "½", "!", "...", "​", "\x00", "Ж"]
    cutter = wordbpe.Cutter(wordbpe.default_pattern())
    for _ in range(4000):
        t = "".join(rng.choices(alphabet, k=rng.randint(1, 30)))
        parts = wordbpe.segments(t)
        pieces = cutter.cut(parts[0][0]) + [x for p in parts[1:] for x in cutter.cut(" " + p)]
        assert "".join(pieces) == t
        assert [i for p in pieces for i in whole.encode_ordinary(p)] == whole.encode_ordinary(t), repr(t)
        assert pieces == cutter.cut(t), repr(t)


def test_characters_are_of_the_librarys_kind():
    """The first character that the two libraries see differently goes by the encoder's view."""
    cutter = wordbpe.Cutter(wordbpe.default_pattern())
    theirs = tiktoken.Encoding("l", pat_str=r"\p{L}", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    for c in "՘₏꟏ᇞ":
        assert (len(cutter.cut(f"a{c}")) == 1) == bool(theirs.encode_ordinary(c)), hex(ord(c))


@pytest.mark.parametrize("chunk", [1, 500, 1 << 25])
@pytest.mark.parametrize("ids", [True, False])
def test_op12_is_the_librarys(spark, whole, monkeypatch, ids, chunk):
    monkeypatch.setattr(wordbpe, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(wordbpe, "PIECE_TOKENS", 100)
    rows = cases.rows(5, ids) + [(k, t, *[None] * 23) for k, t in enumerate([" lead", "trail ", "a  b", "x\n y", " ", "it's  we'll\n\n\tdon't", "z" * 5000, "<|endoftext|>"], 5000)]
    docs = spark.createDataFrame(rows, cases.SCHEMA).repartition(3)
    want = []
    for r in rows:
        i = whole.encode_ordinary(r[1] or "")
        want.append((r[0], len(i), hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted((tuple(r) for r in wordbpe.op12(docs).collect()), key=key) == sorted(want, key=key)


def test_op12_on_a_whole_table(spark, whole, small):
    docs = table(spark, small, "documents")
    want = {r.doc_id: len(whole.encode_ordinary(r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in wordbpe.op12(docs).collect()} == want
    assert wordbpe.op12(cases.empty(spark)).count() == 0


def test_each_word_is_sent_once_a_chunk(spark):
    docs = spark.createDataFrame([(k, "the cat the cat, " * 50) for k in range(20)], "doc_id long, text string").coalesce(1)
    sent = wordbpe.explode(docs, wordbpe.default_pattern(), 4).filter("kind = 0").collect()
    words = [w for r in sent for w in wordbpe._split(wordbpe.zstandard.ZstdDecompressor().decompress(r.body), wordbpe._unplanes(r.lens))]
    assert sorted(words) == [b" ", b" cat", b" the", b",", b"the"]


def test_decoding_needs_every_token(spark):
    rows = spark.createDataFrame([(1, bytearray(np.array([1, 0], "<u4").tobytes())), (2, None)], "doc_id int, ids binary")
    few = spark.createDataFrame([(0, bytearray(b"b")), (1, bytearray(b"\xff"))], "token long, bytes binary")
    assert {r.doc_id: r.decoded for r in wordbpe.decode(rows, few).collect()} == {1: b"\xffb", 2: None}
    with pytest.raises(Exception, match="KeyError"):
        wordbpe.decode(rows, few.filter("token = 0")).collect()


# --- op11 -----------------------------------------------------------------------------------


def plain_op11(rows, k=40, rounds=5):
    fit = [(i, [int(np.floor(np.float64(c) * 256)) for c in e]) for i, e in rows if e is not None and len(e) == 64 and all(c is not None and np.isfinite(c) for c in e)]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in fit if i is not None)[:k]
    cs = [v for _, v in first]
    if not cs:
        return []
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in fit]
        cs = [[sum(col) // len(mine) for col in zip(*mine)] if (mine := [v for (_, v), j in zip(fit, of) if j == n]) else c for n, c in enumerate(cs)]
    got = [(i, *near(v)) for i, v in fit]
    per = {j: sum(d for _, d, n in got if n == j) for j in range(len(cs))}
    top = 2**63 - 1
    return [(i, j, d, min(top, per[j]), min(top, sum(per.values())), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, d, j in got]


def vectors(spark, rows):
    return spark.createDataFrame([(i, e, "x", 1) for i, e in rows], "vec_id long, embedding array<double>, cluster string, distance int").repartition(3)


@pytest.mark.parametrize("seed, n, scale", [(0, 150, 0.2), (1, 60, 1e-3), (2, 90, 1e5), (3, 30, 1.0), (4, 1, 1.0)])
def test_op11_is_a_plain_loop(spark, seed, n, scale):
    """Ties (repeated and coarse vectors), one cluster with most rows, fewer rows than centroids, distances beyond 2^53, sums beyond a long."""
    rng = np.random.default_rng(seed)
    rows = [(i, (rng.integers(-3, 4, 64) * scale).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[0][1]) for i in range(n // 2)]
    rows += [(7, None), (8, [0.5] * 63), (9, [None] + [0.0] * 63), (10, [float("nan")] * 64), (11, [float("inf")] * 64), (12, []), (None, rows[0][1])]
    key = lambda r: (r[0] is None, r[0] or 0, r)
    assert sorted((tuple(r) for r in clusters.op11(vectors(spark, rows)).collect()), key=key) == sorted(plain_op11(rows), key=key)


def test_op11_without_vectors(spark):
    assert clusters.op11(vectors(spark, [(1, None)])).count() == 0
    assert clusters.op11(vectors(spark, [(None, [1.0] * 64)])).count() == 0


def test_annuli_leave_centroids_out_and_lose_none():
    rng = np.random.default_rng(5)
    shell = rng.normal(size=(400, 16))
    c = np.round(shell / np.linalg.norm(shell, axis=1)[:, None] * np.repeat(np.arange(1, 41) * 1000, 10)[:, None]).astype(np.int64)
    x = c[rng.integers(0, 400, 3000)] + rng.integers(-40, 41, (3000, 16))
    search = clusters.Annulus(c)
    number, distance, taken = search.nearest(x)
    every = clusters.squared(x, c)
    assert (distance == every.min(1)).all() and (number == every.argmin(1)).all() and taken < 0.25 * every.size


def test_op11_ties_on_the_edge():
    """Centroids equally far on both sides, with norms on the annulus's edge."""
    c = np.array([[30, 0], [10, 0], [10, 0], [-20, 0]], np.int64)
    number, distance, _ = clusters.Annulus(c).nearest(np.array([[20, 0], [10, 0], [-5, 0]], np.int64))
    assert number.tolist() == [0, 1, 1] and distance.tolist() == [100, 0, 225]


def test_moved_centroids_stay_if_empty(spark):
    v = spark.createDataFrame([(1, [0, 0]), (2, [-3, 1])], "vec_id long, v array<long>")
    assert clusters.moved(v, np.array([[0, 0], [900, 900]])).tolist() == [[-2, 0], [900, 900]]
    assert clusters.moved(v.filter(F.lit(False)), np.array([[5, 6]])).tolist() == [[5, 6]]
