"""The pipeline's near-duplicate stage against brute force on edited copies."""

import random

import numpy as np
import pytest

import corpus_pipeline
from lumenforge.llm import nearcopies, simhash


def plain(t):
    w = t.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def edited(rng, words, share):
    return [f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in words]


def roots(texts, similar=0.8):
    sets, root, pairs = [plain(t) for t in texts], list(range(len(texts))), 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common >= similar * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                root[max(a, b)], pairs = min(a, b), pairs + 1
    return [find(i) for i in range(len(texts))], pairs


@pytest.mark.parametrize("copies", [2, 120])
def test_edited_copies_are_found_and_others_stay(spark, copies):
    rng, texts = random.Random(3), []
    for _ in range(150 if copies == 2 else 2):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 300))]
        texts += [" ".join(base), *(" ".join(edited(rng, base, rng.choice([0.005, 0.01, 0.02, 0.03, 0.06]))) for _ in range(copies))]
    want, pairs = roots(texts)
    assert pairs > 50
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs.repartition(4), "").collect())
    assert got == sorted(set(want))


def test_candidates_of_large_groups_grow_with_rows():
    fp = np.zeros((3000, nearcopies.BYTES), np.uint8)
    i, j = nearcopies.alike(fp)
    assert len(i) <= 2 * nearcopies.BEST * len(fp) and set(i.tolist()) == set(range(1, len(fp)))


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    rng = random.Random(6)
    text = [" ".join(f"w{rng.randrange(3000)}" for _ in range(80)) for _ in range(5)]
    near = text[0] + " tail"
    rows = [(None, text[0]), (None, text[1]), (None, text[1]), (7, text[2]), (7, text[3]), (9, text[3]), (9, text[4]), (5, near), (None, None), (3, " "), (4, "")]
    docs = spark.createDataFrame([(i, t, lang, "s", None) for i, t in rows for lang in ("en", None)], "doc_id long, text string, lang string, source string, n_chars long")
    first = sorted((tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs.repartition(3), "").collect()), key=str)
    assert sorted(((i, t) for i, t, *_ in first), key=str) == sorted([(5, near), (None, text[1]), (7, text[2]), (7, text[3]), (9, text[4]), (3, " ")], key=str)
    again = sorted((tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, docs.repartition(5), "").collect()), key=str)
    assert again == first


def unit(rng, n, groups, noise):
    """Shingle sets in groups that are partly alike, with their fingerprints and keys."""
    base = [rng.integers(0, 1 << 62, 120) for _ in range(groups)]
    sets = []
    for k in range(n):
        s = base[k % groups].copy()
        change = rng.random(len(s)) < noise
        s[change] = rng.integers(0, 1 << 62, int(change.sum()))
        sets.append(np.unique(s).astype(np.uint64))
    least = [nearcopies.least(s) for s in sets]
    return sets, np.stack([(m & np.uint64(255)).astype(np.uint8) for m in least]), np.stack([[hash(m[a : a + 4].tobytes()) for a in range(0, 64, 4)] for m in least])


def closed(n, links, root):
    label = list(root)
    for i, j in links:
        old, new = label[j], label[i]
        label = [new if x == old else x for x in label]
    first = {}
    return [first.setdefault(x, k) for k, x in enumerate(label)]


@pytest.mark.parametrize("noise", [0.02, 0.06, 0.1])
@pytest.mark.parametrize("first", [np.ones(300, bool), np.arange(300) < 120])
def test_units_link_what_all_pairs_link(noise, first):
    """Every link of a pair that passes the filter, by a forest: no more links than components less one."""
    sets, fps, keys = unit(np.random.default_rng(7), 300, 9, noise)
    keys[:, 0] = 5  # all share the unit's key
    root = np.arange(300) // 2
    got = nearcopies.across(fps, keys, 0, root, first, sets, 0.8)
    alike = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) and (fps[i] == fps[j]).sum() >= nearcopies.NEED
    want = [(i, j) for i in range(300) for j in range(i) if (first.all() or first[i] != first[j]) and alike(i, j)]
    assert closed(300, got, root) == closed(300, want, root) and all(alike(i, j) for i, j in got)
    assert len(got) == len(set(root)) - len(set(closed(300, got, root)))


def test_pairs_are_verified_in_the_first_band_they_share():
    sets, fps, keys = unit(np.random.default_rng(1), 4, 1, 0.0)
    keys[:] = 1
    every = np.ones(4, bool)
    assert len(nearcopies.across(fps, keys, 0, np.arange(4), every, sets, 0.8)) == 3
    assert nearcopies.across(fps, keys, 3, np.arange(4), every, sets, 0.8) == []


@pytest.mark.parametrize("part", [16, 8192])
def test_large_keys_lose_no_link(spark, monkeypatch, part):
    """Texts that share most of their words under the same keys, alike only in pairs; windows and lists too short to see them."""
    for name, value in (("PART", part), ("DIRECT", 8), ("BLOCK", 8), ("BEST", 1)):
        monkeypatch.setattr(nearcopies, name, value)
    rng, texts = random.Random(4), []
    common = [f"c{k}" for k in range(140)]
    for k in range(60):
        own = [f"o{k}-{i}" for i in range(30)]
        texts += [" ".join(common + own), " ".join([*common, *own[:-6], *(f"x{k}-{i}" for i in range(6))])]
    rng.shuffle(texts)
    want, pairs = roots(texts)
    assert 50 < pairs < 200
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    got = nearcopies.near_copies(docs)
    node = {bytes(r.node): r.text for r in docs.select(nearcopies.node().alias("node"), "text").collect()}
    place = {t: k for k, t in enumerate(texts)}
    groups = {}
    for r in got.collect():
        groups.setdefault(bytes(r.root), set()).add(place[node[bytes(r.node)]])
    expected = {}
    for k, r in enumerate(want):
        expected.setdefault(r, set()).add(k)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1)


def test_links_in_a_key_of_many_texts(spark):
    """Many texts that share most of their words, in pairs that are alike and chains of three: all links of any pair are kept."""
    rng, texts = random.Random(8), []
    common = [f"c{k}" for k in range(60)]
    for k in range(250):
        own = [f"o{k}-{i}" for i in range(24)]
        a = common + own
        texts += [" ".join(a), " ".join([*a[:-3], f"x{k}", "y", "z"])]
        if k % 3 == 0:
            texts.append(" ".join(a[4:]))
    rng.shuffle(texts)
    want, pairs = roots(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs.repartition(4), "").collect())
    assert pairs >= 300 and got == sorted(set(want))


def test_simhash_proposes_and_its_links_are_not_proposed_again(spark, monkeypatch):
    rng = random.Random(11)
    base = [f"w{rng.randrange(3000)}" for _ in range(600)]
    near, far = " ".join([*base, "tail"]), " ".join(f"v{rng.randrange(3000)}" for _ in range(600))
    assert 0 < (simhash.fingerprint(" ".join(base)) ^ simhash.fingerprint(near)).bit_count() <= 3
    again = " ".join(base) + "  "  # other bytes, the same words
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([" ".join(base), near, again, far])], "doc_id long, text string")
    texts = docs.select(nearcopies.node().alias("node"), "text")
    node = {r.text: bytes(r.node) for r in texts.collect()}
    seen, propose = [], nearcopies.candidates

    def only_simhash(held):
        seen.append({frozenset((bytes(r.u), bytes(r.v))) for r in propose(held).collect()})
        return propose(held).limit(0)

    monkeypatch.setattr(nearcopies, "candidates", only_simhash)
    root = {bytes(r.node): bytes(r.root) for r in nearcopies.near_copies(docs).collect()}
    alike = [node[" ".join(base)], node[near], node[again]]
    assert {root.get(n) for n in alike} == {min(alike)} and node[far] not in root
    # links found by then and not to one text are all that the second index has left
    assert len(seen[0]) < 3
