"""op4, op5, op8, op9 and the pipeline."""

import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lumenforge.llm import mixing, pii, tokenbin, topk
from lumenforge.llm.common import table

from . import cases


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(tokenbin.default_vocab())


def test_words_give_the_same_ids_as_whole_texts(tok):
    rng = random.Random(1)
    alphabet = "abzAZ019'.,!<|>endoftext \t\n\x1c\x85\xa0　éÀßſİıΣσς́ñ中文🙂\x00\x01_-'s're'LL"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["<|endoftext|> a <|startoftext|>b", "a<|endoftext|>b", "'S 'RE don't DON'T 'll", "", "x" * 20000]
    enc = tokenbin.WordEncoder(tokenbin.default_vocab(), most=500)
    for a in range(0, len(texts), 100):
        for t, got in zip(texts[a : a + 100], enc.encode(texts[a : a + 100])):
            assert np.frombuffer(got, enc.dtype).tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_files_of_other_rules_are_encoded_whole(tok):
    """A tokenizer that cuts otherwise gives its own ids, not those of the known pieces."""
    other = str(Path(tokenbin.default_vocab()).with_name("byte_bpe_50k.json"))
    texts = ["Hello, world's 2 words!", " two  spaces", "Éa 🙂", "a<|endoftext|>b"]
    enc, lib = tokenbin.WordEncoder(other), Tokenizer.from_file(other)
    assert enc.whole and not tokenbin.WordEncoder(tokenbin.default_vocab()).whole
    for t, got in zip(texts, enc.encode(texts)):
        assert np.frombuffer(got, enc.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("plane", ["bit", "byte"])
@pytest.mark.parametrize("width", [2, 4])
def test_planes_round_trip(plane, width):
    for n in (0, 1, 7, 8, 9, 4097):
        ids = np.random.default_rng(n).integers(0, 49000, n).astype(f"<u{width}")
        assert (tokenbin.from_planes(tokenbin.to_planes(ids, width, plane), n, width, plane) == ids).all()


@pytest.mark.parametrize("ids", [True, False])
def test_token_files_round_trip(spark, tok, tmp_path, ids):
    rows = sorted(cases.rows(7, ids), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for r in rows:
        i = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 2]
        want.append((r[0], at, len(i), zlib.crc32(np.array(i, "<u4").tobytes())))
        at += len(i)
    path = str(tmp_path / "tokens")
    tokenbin.write_tokens(cases.frame(spark, 7, ids), path, tokenbin.default_vocab(), segment_ids=700, block_ids=64)
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in tokenbin.read_tokens(spark, path).orderBy("start").collect()]
    assert got == want
    assert spark.read.parquet(path).count() > 3


def test_token_files_of_nothing(spark):
    assert tokenbin.op4(cases.empty(spark)).count() == 0


def plain(text):
    """The contract's words, with nothing made faster."""
    text, out = text or "", []
    pats = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    for k, p in pats:
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == "card" and not (12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0):
                continue
            if k == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))


def test_pii_base_matches_plain_patterns():
    rng = random.Random(3)
    alphabet = "019 .-@+()aZ%_é,"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(20000)]
    texts += ["4111 1111 1111 1111", "4111-1111-1111-1112", "a@b.c@d.e", "x@y z@w.q.", "1.2.3.4.5.6.7.8", "999.1.1.1 1.1.1.1", "+1 (212) 555-0100", "0001.2.3.4", "😀a@b.co 10.0.0.1"]
    for t in texts:
        assert [(k, a, b) for k, a, b, _ in pii.detect(t) if k in pii.BASE] == plain(t), t


def test_pii_added_kinds_need_their_checks():
    kinds = lambda t: [k for k, *_ in pii.detect(t)]
    assert "iban" in kinds("pay DE89 3704 0044 0532 0130 00 now") and "iban" not in kinds("pay DE88 3704 0044 0532 0130 00 now")
    assert kinds("my ssn 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert [x[:3] for x in pii.detect("to DE89370400440532013000 NOW") if x[0] == "iban"] == [("iban", 3, 25)]
    assert [x[:3] for x in pii.detect("to DE89 3704 0044 0532 0130 00 NOW") if x[0] == "iban"] == [("iban", 3, 30)]
    assert "iban" not in kinds("DE89 3704 0044 0532 0130 001") and "iban" not in kinds("ZZ89 3704 0044 0532 0130 00")
    assert kinds("123-45-6789 is my social security number") == ["ssn"]
    assert not any("ssn" in kinds(f"my ssn {x}") for x in ("000-12-3456", "666-12-3456", "912-12-3456", "123-00-4567", "123-45-0000"))
    assert "secret" in kinds('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"') and "secret" not in kinds("04dbebab91ab85687d33eeaaf9ac699e1188f962")


def test_pii_is_linear_on_long_runs():
    for t in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" + " " * 300_000, "a@" * 100_000):
        pii.detect(t)


@pytest.mark.parametrize("ids", [True, False])
def test_pii_query(spark, ids):
    rows = cases.rows(8, ids)
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.op5(cases.frame(spark, 8, ids)).collect())
    want = Counter()
    for r in rows:
        s = plain(r[1])
        want[(r[0], *[sum(x[0] == k for x in s) for k in pii.KINDS[:4]], pii.digest(s))] += 1
    assert got == want and pii.op5(cases.empty(spark)).count() == 0


def water(sizes, weights, repeat=3.0):
    capped, target = set(), {}
    while True:
        free = [s for s in sizes if s not in capped]
        left = sum(sizes.values()) - sum(repeat * sizes[s] for s in capped)
        target = {s: repeat * sizes[s] if s in capped else left * weights[s] / sum(weights[x] for x in free) for s in sizes}
        new = {s for s in free if target[s] > repeat * sizes[s]}
        if not new:
            return target
        capped |= new


@pytest.mark.parametrize("ids", [True, False])
def test_mix_targets_and_shares(spark, ids):
    rows = cases.rows(9, ids)
    plan = mixing.mix(cases.frame(spark, 9, ids), slots=1 << 12)
    out = plan["documents"].collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r.doc_id, r.source, r.size) for r in out) == Counter((r[0], r[3], words(r[1])) for r in rows)
    sizes = defaultdict(int)
    for r in out:
        sizes[r.source] += r.size
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = water(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)})
    block = -(-sum(sizes.values()) // (1 << 12))
    for s in sizes:
        mine = [r for r in out if r.source == s]
        assert all(r.target == pytest.approx(target[s]) and r.source_size == sizes[s] and 0 <= r.taken <= 3 * r.size for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 16 * block
    again = Counter((r.doc_id, r.source, r.size, r.taken) for r in mixing.mix(cases.frame(spark, 9, ids).repartition(5), slots=1 << 12)["documents"].collect())
    assert again == Counter((r.doc_id, r.source, r.size, r.taken) for r in out)


def test_mix_caps_small_sources_and_empties(spark):
    docs = spark.createDataFrame([(1, "a " * 10, "a"), (2, "b " * 1000, "b"), (3, "c " * 500, "c"), (4, None, "d"), (5, "", None)], "doc_id long, text string, source string")
    out = {r.doc_id: r for r in mixing.op8(docs).collect()}
    assert out[1].target == 30 and out[1].taken == 30 and out[4].target == 0 and out[5].taken == 0
    assert sum(r.target for r in out.values()) == pytest.approx(1510)
    assert mixing.op8(cases.empty(spark)).count() == 0
    assert [r.taken for r in mixing.op8(docs.filter("doc_id > 3")).collect()] == [0, 0]


def nearest(rows, k=5):
    fit = [(i, np.floor(256 * np.array(v, np.float64)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for q, v in fit:
        if q % 50 == 0:
            best = sorted(((-int(v @ x), i) for i, x in fit if i != q))[:k]
            out.update((q, r + 1, i, -s) for r, (s, i) in enumerate(best))
    return out


def test_top_k_matches_brute_force(spark, small):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 8)]) for i in range(400)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, None), (1003, [float("nan")] * 8), (1004, [None] * 8), (1050, [float("inf")] * 8), (None, rows[3][1]), (1100, [0.0] * 8), (1150, [])]
    emb = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert Counter(tuple(r) for r in topk.op9(emb).collect()) == nearest(rows)
    v = topk.quantised(emb)
    assert Counter(tuple(r) for r in topk.top_k(v, v.filter("vec_id % 50 = 0"), pivots=3, sample=7, block_bytes=300).collect()) == nearest(rows)
    real = table(spark, small, "embeddings")
    assert Counter(tuple(r) for r in topk.op9(real).collect()) == nearest([(r.vec_id, r.embedding) for r in real.collect()])


def test_top_k_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>, score string, rank string, v string"
    assert topk.op9(spark.createDataFrame([], schema)).count() == 0
    got = topk.op9(spark.createDataFrame([(0, [1.0, 0.0], "", "", ""), (1, [1.0, 0.0], "", "", "")], schema)).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 65536)]


def test_pivot_bounds_leave_candidates_out():
    """Forty groups of vectors of about one length: few groups are evaluated, and nothing is lost; directions without structure leave little out."""
    rng = np.random.default_rng(4)
    centre = rng.normal(0, 1, (40, 16))
    centre *= 4000 / np.linalg.norm(centre, axis=1)[:, None]
    grouped = np.vstack([c + rng.normal(0, 60, (100, 16)) for c in centre]).round()
    plain = (rng.normal(0, 1, (4000, 16)) * 1000).round()
    for x, most in ((grouped, 0.1), (plain, 1.0)):
        ids = np.arange(len(x))
        qs = topk.Queries(ids[::50], x[::50], x[::7], ids[::7], 32, 5)
        best = topk.Best(len(qs.ids), 5)
        evaluated = sum(topk.search(qs, x[a : a + 1000], ids[a : a + 1000], best) for a in range(0, len(x), 1000))
        s = qs.q @ x.T
        s[np.arange(len(qs.ids)), qs.ids] = -np.inf
        want = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :5]
        assert (best.id == want).all() and (best.score == np.take_along_axis(s, want, 1)).all()
        assert evaluated <= most * s.size


def test_products_are_exact_where_floats_are_not(spark):
    big = 2.0**40
    rows = [(0, [big + 1, 3.0]), (1, [big + 1, 1.0]), (2, [big + 1, 2.0]), (3, [big, 9.0]), (4, [1e300, -1e300]), (5, [1.0])]
    got = topk.op9(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    whole = {i: [int(c) * 256 for c in v] for i, v in rows}
    want = {i: max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(whole[0], whole[i])))) for i in (1, 2, 3, 4)}
    assert {r.vec_id: r.score for r in got} == want


def firsts_of_near_copies(rows):
    """The smallest id of each group of texts linked by five-word shingles of similarity 0.8; texts of less than five words are one shingle."""
    shingles, root = {}, {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        shingles[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
        root[i] = i

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(shingles)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = shingles[a], shingles[b]
            if 5 * len(x & y) >= 4 * len(x | y):
                u, v = sorted((top(a), top(b)))
                root[v] = u
    return {top(i) for i in ids}


def test_pipeline_stages(spark, small):
    docs = before = table(spark, small, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
        assert docs.columns == before.columns
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
    assert 0 < len(kept["quality"]) <= before.count()
    from .test_dedup import hits

    want = firsts_of_near_copies(kept["quality"])
    assert {i for i, _ in kept["near_duplicates"]} == want and len(kept["near_duplicates"]) == len(want)
    items = [(str(r.item_id), r.text) for r in table(spark, small, "benchmark").collect()]
    clean = {i for i, _, n, *_ in hits(kept["near_duplicates"], items) if n == 0}
    assert {i for i, _ in kept["decontamination"]} == clean
    assert {i for i, _ in kept["source_mix"]} <= clean and kept["source_mix"]
    out = corpus_pipeline.write_token_files(spark, docs, small).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in kept["source_mix"])


def test_near_duplicates_lose_no_row(spark, small):
    """Texts that aren't alike stay, whatever their ids; of copies one row stays; reruns agree."""
    texts = [" ".join(f"t{k}w{i}" for i in range(30)) for k in range(5)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (None, texts[3]), (None, texts[4]), (1, texts[2]), (7, texts[2] + " more"), (None, texts[0]), (None, texts[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    runs = [sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs.repartition(n), small).collect()), key=str) for n in (1, 4)]
    assert runs[0] == runs[1] == sorted([(1, texts[0]), (1, texts[1]), (1, texts[2]), (None, texts[3]), (None, texts[4])], key=str)


def test_pipeline_of_odd_rows(spark, small):
    docs = cases.frame(spark, 10, ids=False).select(*corpus_pipeline.DOCUMENT)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, small).collect(), docs.schema)
    corpus_pipeline.write_token_files(spark, docs, small).count()
    docs = cases.empty(spark).select(*corpus_pipeline.DOCUMENT)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, small).count() == 0
