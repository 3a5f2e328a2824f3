"""op1, op2, op10: learned scores against brute force and held-out accuracy."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from lumenforge.llm import langid, lmmixer, lmpairs, lmscore, lmspell, lmwords, quality
from lumenforge.llm.common import table

from . import cases


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def tokens(t):
    return (t or "").encode().lower().split() + [b"\n"]


@pytest.mark.parametrize("ids", [True, False])
def test_base_score_is_exact(spark, ids):
    rows = cases.rows(1, ids)
    train = Counter(w for r in rows if crc(r[0]) % 7 != 2 for w in tokens(r[1]))
    n, v = sum(train.values()), len(train)
    want = sorted((str(r[0]), crc(r[0]) % 7 == 2, len(tokens(r[1])), sum(train[w] > 0 for w in tokens(r[1])), n, round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens(r[1])), 6)) for r in rows)
    out = lmscore.score_text(cases.frame(spark, 1, ids), spell_bits=12, most_words=50, bucket_bytes=1000).collect()
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)
    assert got == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)


def test_lm_without_rows_or_training(spark):
    assert lmscore.op1(cases.empty(spark)).count() == 0
    held = next(i for i in range(100) if crc(i) % 7 == 2)
    r = lmscore.score_text(spark.createDataFrame([(held, "a b")], "doc_id long, text string"), spell_bits=10).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (3, 0, 0, 0.0) and r.score < 0


def test_spelling_is_a_distribution():
    words = [b"ab", b"abc", b"b", b"ca"]
    table = np.zeros((len(lmspell.ORDERS), 2 << 10), np.uint32)
    lmspell.count_slots(words, 10, table)
    speller = lmspell.Speller(lmscore.narrow(table.reshape(len(lmspell.ORDERS), 1 << 10, 2)))
    speller.run(words, True)
    every = [bytes([a]) for a in range(256) if a != 32] + [bytes([a, b]) for a in range(256) for b in range(256) if 32 not in (a, b)]
    p = np.exp(speller.run(every, False))
    assert 0 < p.sum() <= 1 + 1e-6
    assert p[every.index(b"b")] > p[every.index(b"q")]
    assert np.isfinite(speller.run([b"x" * 5000, b""], False)).all()


def test_long_words_are_spelled_across_cuts():
    """A word of more than LONGEST bytes has the slots that it has without a cut."""
    rng = np.random.default_rng(5)
    word = bytes(rng.integers(97, 123, 3000).astype(np.uint8))
    cut, whole = lmspell.Paths([b"a", word], 20), None
    longest, lmspell.LONGEST = lmspell.LONGEST, 1 << 20
    try:
        whole = lmspell.Paths([b"a", word], 20)
    finally:
        lmspell.LONGEST = longest
    assert (cut.slot == whole.slot).all() and (cut.bit == whole.bit).all() and (cut.word == whole.word).all()


def test_codes_are_prefix_free_and_symbols_tell_what_is_shared():
    rng = np.random.default_rng(6)
    words = [b"w%d" % k for k in range(9000)]
    count = rng.choice([1, 2, 3, 5, 9, 17, 70, 900], 9000, p=[0.3, 0.5, 0.1, 0.04, 0.03, 0.02, 0.009, 0.001])
    k = lmwords.class_of(count)
    codes = lmwords.short_codes({int(c): float(count[k == c].sum()) for c in np.unique(k)})
    assert sum(2.0**-n for _, n in codes.values()) == 1 and max(n for _, n in codes.values()) <= 8
    h = lmwords.hashes(words)
    book = {}
    for c, (bits, n) in codes.items():
        small = c and (k == c).sum() <= lmwords.RANKED
        book[c] = (bits, n, int((k == c).sum() - 1).bit_length(), np.sort(h[k == c])) if small else (bits, n, 32 - n, None)
    symbol, length, code, _ = lmwords.codes_of(words, count, book)
    length = length & 127
    assert len(set(code[count > 1].tolist())) == (count > 1).sum()
    for s, n in {(int(a), int(b)) for a, b in zip(symbol, length)}:
        assert ((symbol >> (8 - n)) == s >> (8 - n)).sum() == (symbol == s).sum()  # no symbol begins another


def plain_pairs(rows):
    """For each token: strength, agreeing bits and truth of what follows two words most often in training, but for the token's own place."""
    count = {}
    for _, held, w in rows:
        if not held:
            for i, x in enumerate(w):
                c = count.setdefault(tuple((["", ""] + w)[i : i + 2]), Counter())
                c[x] += 1
    out = []
    for _, held, w in rows:
        for i, x in enumerate(w):
            c = Counter(count.get(tuple((["", ""] + w)[i : i + 2]), {}))
            if not held:
                c[x] -= 1
            out.append((max(c.values(), default=0), sum(c.values()), x, {y for y, n in c.items() if n == max(c.values())}))
    return out


@pytest.mark.parametrize("bits", [2, lmpairs.ONE_SORT + 1])
def test_pairs_are_counted_over_the_corpus(bits):
    import pandas as pd

    rng = np.random.default_rng(7)
    rows = [(k, bool(k % 7 == 2), [f"w{x}" for x in rng.integers(0, 4, rng.integers(0, 40))]) for k in range(60)]
    words = sorted({x for _, _, w in rows for x in w})
    ident = {x: np.uint32(0x9E3779B1 * (k + 1) & 0xFFFFFFFF) for k, x in enumerate(words)}
    asked, places = [], []
    for chunk, part in enumerate((rows[:25], rows[25:])):
        code = np.array([ident[x] for _, _, w in part for x in w], np.uint32)
        lens, train = np.array([len(w) for _, _, w in part if w]), np.concatenate([np.full(len(w), 0 if h else 1, np.uint8) for _, h, w in part])
        keys = lmpairs.keys_of((code >> np.uint32(24)).astype(np.uint8), code, code, lens, train, bits)
        key, bucket, count = lmpairs.requests(*keys, bits)
        places.append(lmpairs.places(*keys, bits))
        asked += [(chunk, b, key[bucket == b], count[bucket == b]) for b in np.unique(bucket)]
    said = {}
    for b in {x[1] for x in asked}:
        pdf = pd.DataFrame([{"bucket": b, "chunk": c, "keys": lmpairs.packed(k), "counts": lmwords.press(n.astype("<u4").tobytes())} for c, x, k, n in asked if x == b])
        for r in lmpairs.merge_pairs(pdf).itertuples():
            said[r.chunk, r.bucket] = lmwords.array(r.said, np.uint8)
    got = np.concatenate([np.concatenate([said[c, b] for x, b, _, _ in asked if x == c])[places[c]] for c in (0, 1)])
    for value, (n, all_, x, best) in zip(got, plain_pairs(rows)):
        assert value >> 5 == lmpairs.level_of(np.array([n]), np.array([all_]))[0]
        if n and best == {x}:
            assert value & 1 and value >> 1 & 15 == 8
        if n and x not in best:
            assert not value & 1


def test_local_predictions_match_a_plain_loop():
    rng = np.random.default_rng(8)
    lens = np.array([1, 40, 7, 200])
    t, symbols = rng.integers(0, 9, lens.sum()).astype(np.uint32), rng.integers(0, 256, 9).astype(np.uint8)
    level, agree, hit = lmmixer.local(t, symbols[t], lens)
    a = 0
    for n in lens:
        doc = t[a : a + n].tolist()
        for i in range(n):
            before = [j for j in range(1, i) if doc[j - 1] == doc[i - 1]] if i else []
            assert level[a + i] == min(3, len(before))
            if before:
                said = doc[before[-1]]
                x = int(symbols[said]) ^ int(symbols[doc[i]])
                assert hit[a + i] == (said == doc[i]) and agree[a + i] == 8 - x.bit_length()
        a += n


def test_bits_are_counted_behind_their_first_bits():
    table = np.random.default_rng(9).integers(0, 40, (3, 256)).astype(np.uint32)
    bits = lmmixer.as_bits(table)
    for row in range(3):
        for j in range(8):
            for first in range(1 << j):
                here = [s for s in range(256) if s >> (8 - j) == first]
                assert bits[row, (1 << j) + first].tolist() == [sum(int(table[row, s]) for s in here if s >> (7 - j) & 1 == v) for v in (0, 1)]


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_cost_of_a_bit_is_that_of_its_logit(kind):
    z, bit = np.linspace(-40, 40, 4002).astype(kind), (np.arange(4002) % 2).astype(np.uint32)
    want = np.logaddexp(0, np.where(bit == 1, -z.astype(float), z.astype(float)))
    np.testing.assert_allclose(lmspell.bit_cost(z, bit), want, rtol=2e-6 if kind == np.float32 else 1e-9, atol=1e-7 if kind == np.float32 else 1e-12)


def test_mixer_matches_a_plain_loop():
    """One block of bits, token by token, with start weights; then the weights' step."""
    rng = np.random.default_rng(10)
    n = 300
    table = rng.integers(0, 30, (2, 1 << lmmixer.ROWS, 256)).astype(np.uint32)
    whole = table[0].sum(0, dtype=np.int64)[None]
    m = lmmixer.Mixer(lmmixer.as_bits(whole), np.stack([lmmixer.as_bits(x) for x in table]))
    symbol, rows = rng.integers(0, 256, n).astype(np.uint8), tuple(rng.integers(0, 50, n) for _ in range(2))
    for k in range(2):
        table[k][rows[k], symbol] += 1
    m.pairs = [lmmixer.as_bits(x).view("<u4").reshape(-1) for x in (whole, *table)]
    train = (rng.random(n) < 0.7).astype(np.uint8)
    said = [(rng.integers(0, 8, n).astype(np.uint8), rng.integers(0, 9, n).astype(np.uint8), rng.random(n) < 0.5) for _ in range(2)]
    said[1][0][:] = np.minimum(said[1][0], 3)
    m.held = rng.integers(1, 50, m.held.shape).astype(float)
    held, weight = m.held.copy(), m.weight.copy()
    j = 3
    got = m.step(symbol.astype(np.int32), [np.zeros(n, np.int32), *((r << 8).astype(np.int32) for r in rows)], train.astype(np.uint32), [s[:2] for s in said], j)
    bits = [lmmixer.as_bits(x) for x in (whole, *table)]
    centre, grads, hits = np.linspace(-8, 8, 33), np.zeros((6, 8)), np.zeros(8)
    for i in range(n):
        bit, node = int(symbol[i]) >> 4 & 1, (1 << j) + (int(symbol[i]) >> 5)
        x = []
        for t in (bits[0][0], bits[1][rows[0][i]], bits[2][rows[1][i]]):
            c = [int(v) for v in t[node]]
            c[bit] -= int(train[i])
            x.append(math.log(c[1] + 0.2) - math.log(c[0] + 0.2))
        lives = [int(s[0][i]) if s[1][i] >= j else 0 for s in said]
        for k in range(2):
            v = math.log(held[k, j, lives[k], 1] / held[k, j, lives[k], 0]) if lives[k] else 0.0
            says = bit if said[k][1][i] > j else 1 - bit
            x.append(v if says else -v)
        x.append(0.3)
        g = [0, 1, 2, 3, 2, 1, 1, 1][lives[0]] + 4 * (lives[1] > 0)
        s = max(-8.0, min(8.0, sum(w * v for w, v in zip(weight[j, :, g], x))))
        p = 20 / (1 + math.exp(-centre[int((s + 8) * 2 + 0.5)]))
        z = 0.5 * (s + math.log((p + 1e-3) / (20 - p + 1e-3)))
        assert got[i] == pytest.approx(math.log1p(math.exp(-z if bit else z)), abs=1e-3)
        hits[g] += train[i]
        grads[:, g] += train[i] * (bit - 1 / (1 + math.exp(-s))) * np.array(x)
    assert np.allclose(m.weight[j], weight[j] + 0.02 * grads / np.sqrt(np.maximum(1, hits)), atol=2e-3)


def test_copies_are_scored_apart(spark):
    """Texts that training holds elsewhere cost far less than texts like them that it doesn't."""
    rng = np.random.default_rng(11)
    train = [i for i in range(4000) if crc(i) % 7 != 2][:400]
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, 60)) for _ in train]
    for k in range(20):
        texts[2 * k + 1] = texts[2 * k]
    out = lmscore.op1(spark.createDataFrame(list(zip(train, texts)), "doc_id long, text string").repartition(3)).collect()
    bits = {r.doc_id: r.bits_per_token for r in out}
    copies, others = [bits[i] for i in train[:40]], [bits[i] for i in train[40:]]
    assert max(copies) < 0.5 * min(others)
    assert all(r.bits_per_byte == pytest.approx(r.total_bits / r.n_bytes) and r.n_bytes > 0 and r.score == pytest.approx(-r.total_bits * math.log10(2)) for r in out)


def test_scores_do_not_depend_on_the_split(spark, small, monkeypatch):
    """One, four and sixteen partitions, small chunks or large: the same score for every row, and for equal texts."""
    docs = table(spark, small, "documents").select("doc_id", "text")
    docs = docs.union(docs.filter("doc_id = 3")).union(docs.filter("doc_id % 7 = 0").selectExpr("doc_id + 100000", "text"))
    held = lambda i: crc(i) % 7 == 2
    runs = []
    for n, most in ((1, 1_000_000), (4, 1_000_000), (16, 5_000)):
        runs.append(sorted((r.doc_id, r.score, r.base_score, r.n_bytes) for r in lmscore.score_text(docs.repartition(n), most_tokens=most).collect()))
    for other in runs[1:]:
        assert [r[0] for r in other] == [r[0] for r in runs[0]]
        assert [r[1] for r in other] == pytest.approx([r[1] for r in runs[0]], rel=1e-9, abs=1e-9)
    score = dict((r[0], r[1]) for r in runs[0])
    same = [(i, i + 100000) for i in score if i + 100000 in score and held(i) == held(i + 100000)]
    assert same and all(score[a] == pytest.approx(score[b], rel=1e-9) for a, b in same)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r[3] == len(text[r[0]].encode()) for r in runs[0])


def test_a_documents_weights_move_by_its_own_tokens():
    """A document costs the same beside others and alone, and less than with weights that stay, if it is unlike the sample."""
    rng = np.random.default_rng(3)
    table_ = np.zeros((2, 1 << lmmixer.ROWS, lmmixer.NODES), np.int64)
    table_[0, 5, :64], table_[1, 9, 128:] = 50, 50

    def tokens(n, symbols):
        return rng.choice(symbols, n).astype(np.uint8), np.full(n, 8, np.uint8), (np.full(n, 5), np.full(n, 9))

    def args(parts):
        sym, length = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        rows, n = tuple(np.concatenate([p[2][k] for p in parts]) for k in range(2)), len(sym)
        none = (np.zeros(n, np.uint8), np.zeros(n, np.uint8), np.zeros(n, bool))
        return sym, length, rows, np.zeros(n, np.uint8), [none, none], np.zeros(n), np.zeros(n, bool), np.array([len(p[0]) for p in parts])

    def mixer(rate=0.02):
        return lmmixer.Mixer(lmmixer.as_bits(table_[0].sum(0)[None]), np.stack([lmmixer.as_bits(t) for t in table_]), rate)

    docs = [tokens(900, range(128, 256)), tokens(100, range(64)), tokens(2000, range(64)), tokens(1, range(64))]
    whole = np.add.reduceat(mixer().cost_apart(*args(docs)), np.cumsum([0, 900, 100, 2000]))
    for k, d in enumerate(docs):
        assert mixer().cost_apart(*args([d])).sum() == pytest.approx(whole[k], rel=1e-6)
    still = np.add.reduceat(mixer(0.0).cost_apart(*args(docs)), np.cumsum([0, 900, 100, 2000]))
    assert whole[0] < still[0] and whole[2] < still[2] and whole[1] == still[1]


def test_weights_come_from_all_training_tokens():
    """Sums of parts are those of the whole; the step brings the slopes of all tokens near zero, wherever it began."""
    rng = np.random.default_rng(4)
    n = 20_000
    symbol, length = rng.choice(range(40, 200), n).astype(np.uint8), np.full(n, 8, np.uint8)
    table_ = np.zeros((2, 1 << lmmixer.ROWS, lmmixer.NODES), np.int64)
    rows = (rng.integers(0, 4, n), rng.integers(0, 4, n))
    for k in range(2):
        np.add.at(table_[k], (rows[k], symbol), 1)
    strength = rng.integers(0, 4, n).astype(np.uint8)
    said = [(strength, rng.integers(0, 9, n).astype(np.uint8), rng.random(n) < 0.5) for _ in range(2)]
    shared = np.ones(n, bool)

    def gathered(mixer, *parts):
        sums = lmmixer.no_sums()
        for a, b in parts:
            cut = lambda x: x[a:b]  # noqa: B023, E731
            mixer.gather(sums, cut(symbol), cut(length), tuple(map(cut, rows)), [tuple(map(cut, one)) for one in said], cut(shared))
        return sums

    for start in (0.3, 0.25):
        m = lmmixer.Mixer(lmmixer.as_bits(table_[0].sum(0)[None]), np.stack([lmmixer.as_bits(t) for t in table_]))
        m.weight[:, :-1] = start
        one, two = gathered(m, (0, n)), gathered(m, (0, 7), (7, 9000), (9000, n))
        assert all(np.allclose(one[name], two[name], rtol=1e-9, atol=1e-6) for name in one)
        assert one["seen"].sum() == 8 * n and one["held"].sum() == 16 * n
        before = np.abs(one["slope"]).sum()
        m.settle(one)
        m.held = np.ones_like(m.held)  # as it was when the slopes were taken
        assert np.abs(gathered(m, (0, n))["slope"]).sum() < before / 5


def test_lm_beats_base_on_held_out(spark, medium):
    out = lmscore.op1(table(spark, medium, "documents")).filter("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert out.s > out.b


def test_language_id(spark, medium):
    docs = table(spark, medium, "documents")
    got = langid.op2(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").selectExpr("avg(CAST(lang = lang_pred AS INT)) AS a", "min(score) AS lo", "max(score) AS hi").first()
    assert got.a >= 0.97 and 0 <= got.lo <= got.hi <= 1


@pytest.mark.parametrize("ids", [True, False])
def test_language_id_of_odd_rows(spark, ids):
    rows = cases.rows(2, ids)
    out = langid.op2(cases.frame(spark, 2, ids)).collect()
    assert len(out) == len(rows)
    letterless = {str(r[0]) for r in rows if not any(c.isalpha() for c in r[1] or "")}
    for r in out:
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (str(r.doc_id) in letterless), r
        assert r.lang_pred in ("en", "de", "und") and 0 <= r.score <= 1
    assert langid.op2(cases.empty(spark)).count() == 0
    assert {r.lang_pred for r in langid.op2(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).collect()} == {"und"}


def plain_grams(b):
    b = b"\0" + b + b"\0"
    return {b[i : i + n] for n in (1, 2, 3, 4) for i in range(len(b) - n + 1)}


def test_kernel_and_ridge_match_plain_ones():
    """Kernel by sets of n-grams; ridge regression on Nyström features by a general solver; predictions by the kernel itself."""
    rng = np.random.default_rng(12)
    texts = [bytes(rng.choice(list(b"abcde " if k % 2 else b"cdefg "), rng.integers(0, 300)).astype(np.uint8)) for k in range(60)]
    grams = [plain_grams(t) for t in texts]
    k = np.array([[len(x & y) / math.sqrt(len(x) * len(y)) for y in grams] for x in grams])
    doc, _ = langid.cells(texts, langid.ORDERS, 40)
    assert [len(g) for g in grams] == np.bincount(doc, minlength=60).tolist()
    doc, cell = langid.cells(texts, langid.ORDERS, langid.BITS)
    marks = langid.Landmarks([cell[doc == m] for m in range(0, 60, 4)])
    got = marks.times(texts, marks.rows)
    assert np.allclose(got, k[:, ::4], atol=2e-3) and np.allclose(marks.among(), k[::4, ::4], atol=2e-3)
    labels = ["odd" if m % 2 else "even" for m in range(60)]
    model = langid.solve(marks, labels, got.astype(float))
    values, vectors = np.linalg.eigh(k[::4, ::4])
    whiten = vectors / np.sqrt(values)
    phi = np.hstack([k[:, ::4] @ whiten, np.ones((60, 1))])
    y = np.array([[1.0, -1.0] if m == "even" else [-1.0, 1.0] for m in labels])
    stacked = np.vstack([phi, math.sqrt(langid.RIDGE * 60 * 0.1) * np.eye(phi.shape[1])])
    coef = np.linalg.lstsq(stacked, np.vstack([y, np.zeros((phi.shape[1], 2))]), rcond=None)[0]
    assert np.allclose(marks.times(texts, model["right"]) + model["bias"], phi @ coef, atol=0.03)
    names, score = langid.predict(texts, [t.decode() for t in texts], model)
    assert all(n == model["names"][int((phi @ coef)[m].argmax())] for m, n in enumerate(names) if n != "und" and abs((phi @ coef)[m][0]) > 0.1)


def test_long_texts_have_their_own_ngrams():
    """Steps and the table for long texts give the n-grams that a set gives."""
    rng = np.random.default_rng(13)
    t = bytes(rng.integers(97, 104, 1 << 17).astype(np.uint8))
    doc, cell = langid.cells([b"ab", t, b""], (1, 2, 3, 4), 22)
    assert (np.diff(cell[doc == 1]) > 0).all()
    assert len(cell[doc == 1]) == pytest.approx(len(plain_grams(t)), rel=1e-3)


def test_language_of_long_texts(spark, medium):
    """Texts put end to end to 300 KB are told apart like short ones."""
    docs = table(spark, medium, "documents")
    model = langid.train(docs)
    by = {}
    for r in docs.filter("crc32(CAST(doc_id AS STRING)) % 4 = 2 AND lang IS NOT NULL").select("lang", "text").collect():
        by.setdefault(r.lang, []).append(r.text or "")
    for lang, texts in by.items():
        whole = (" ".join(texts) * 40)[:300_000]
        assert langid.predict([whole.encode().lower()], [whole], model)[0] == [lang]


@pytest.mark.parametrize("text, letters", [("²", False), ("½", False), ("Ⅷ", False), ("12 %", False), ("", False), (None, False), ("1a", True), ("ñ", True), ("中", True)])
def test_letters(text, letters):
    assert langid.has_letter(text) == letters


def test_quality_on_held_out(spark, medium):
    docs, labels = table(spark, medium, "documents"), table(spark, medium, "labels")
    got = quality.op10(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    bad, good = [r for r in got if r.quality == 0], [r for r in got if r.quality == 1]
    assert sum(r.predicted for r in good) >= 0.95 * len(good)
    auc = np.mean([g.score > b.score for g in good for b in bad])
    assert auc > 0.9


@pytest.mark.parametrize("ids", [True, False])
def test_quality_of_odd_rows(spark, ids):
    docs = cases.frame(spark, 3, ids)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (8, 0, 0), (15, None, 1), (None, 1, 1), (22, 1, 0), (22, 1, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.op10(docs, labels).collect()
    assert len(out) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (crc(r.doc_id) % 5 == 0) for r in out)
    assert {r.score for r in quality.op10(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.op10(cases.empty(spark), labels).count() == 0


def test_dual_descent_separates():
    index = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])]
    y = np.array([1.0, 1.0, -1.0, -1.0])
    w = quality.dual_descent(index, np.ones(4), y, np.full(4, 10.0), epochs=100)
    assert all(np.sign(w[i].sum() / np.sqrt(2) + w[-1]) == s for i, s in zip(index, y))


def test_quality_features_and_ratios_match_plain_ones():
    """N-grams by sets, hashed one by one; log-count ratios by counting documents."""
    rng = np.random.default_rng(14)
    docs = [bytes(rng.choice(list(b"abc dEF"), rng.integers(0, 60)).astype(np.uint8)).lower() for _ in range(40)]
    bits, orders = 10, (1, 2, 3, 4)

    def slot(g):
        v = (int.from_bytes(g, "little") + (len(g) << 56)) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        return v >> 64 - bits

    want = []
    for d in docs:
        t = b"\0" + d + b"\0" * 4
        want.append({slot(t[i : i + n]) for n in orders for i in range(len(t) - n + 1)})
    x = quality.presence(docs, orders, bits)
    assert [set(np.flatnonzero(r).tolist()) for r in x] == want
    y = np.where(rng.random(40) < 0.4, 1, -1)
    p, q = ([1 + sum(k in w for w, s in zip(want, y) if s == side) for k in range(1 << bits)] for side in (1, -1))
    ratio = [math.log((a / sum(p)) / (b / sum(q))) for a, b in zip(p, q)]
    assert np.allclose(quality.log_count_ratio(np.packbits(x, axis=1), y), ratio)


def test_dual_descent_reaches_the_optimum():
    """The hinge loss's dual by plain projected gradient steps, to the same weights."""
    rng = np.random.default_rng(15)
    n, m = 24, 10
    index = [np.sort(rng.choice(m, rng.integers(1, 6), replace=False)) for _ in range(n)]
    value, y, c = rng.normal(0, 1, m), np.where(rng.random(n) < 0.5, 1.0, -1.0), np.full(n, 0.7)
    x = np.zeros((n, m + 1))
    for i, k in enumerate(index):
        x[i, k] = value[k] / max(1e-12, np.linalg.norm(value[k]))
    x[:, -1] = 1.0
    q, alpha = (x * y[:, None]) @ (x * y[:, None]).T, np.zeros(n)
    step = 1 / np.linalg.eigvalsh(q).max()
    for _ in range(200_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, c)
    w = quality.dual_descent(index, value, y, c, epochs=5000)
    assert np.allclose(w, (alpha * y) @ x, atol=0.02)


def test_labels_with_clashing_columns(spark):
    rows = cases.rows(3)
    labels = [(r[0], k % 2) for k, r in enumerate(rows)]
    docs = cases.frame(spark, 3)
    plain = spark.createDataFrame(labels, "doc_id long, quality int")
    clash = spark.createDataFrame([(i, q, "t", "x", 0.5, 7, True) for i, q in labels], "doc_id long, quality int, text string, y string, _key double, share int, held_out boolean")
    got = [sorted(map(tuple, quality.op10(docs, t).collect())) for t in (plain, clash)]
    assert got[0] == got[1]


def test_passes_over_coded_chunks_shuffle_nothing(spark):
    out = lmscore.score_text(cases.frame(spark, 1), spell_bits=12, most_words=50, bucket_bytes=1000)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == len(cases.rows(1)) and not [t for t in spark.catalog.listTables() if t.name.startswith("chunks_")]
