"""Near copies by word shingles: byte-position indexes propose pairs, exact similarity decides.

SimHash comes first, as in ``simhash``: texts of equal fingerprints, and fingerprints that the byte-position
index links within 3 bits, are verified by the exact similarity of their sets. Those that are linked to one
text aren't compared with each other again.

At similarity 0.8 about 15 % of SimHash bits differ, so a second index finds the rest. A text is the set of its five-word shingles' XXH64 values (a shorter text has one
shingle, all its words). Its fingerprint has 64 bytes: byte p is the last byte of
the least value under the p-th of 64 mixings, so two texts agree in a byte with
the probability of their Jaccard similarity. (Signs of summed bits, as in
``simhash``, differ in 15 % of places at similarity 0.8: then no byte is certain
to agree, however long the fingerprint.) The index holds every distinct text
under 16 keys, each of 4 positions' full values. Texts under one key are
candidates; their equal positional bytes are tallied, pairs below ``NEED`` are
dropped, and all others are verified by the exact similarity of their sets.

At similarity 0.8 a pair meets under some key with probability
1 - (1 - 0.8^4)^16 = 0.9998 and passes the count filter with about the same.
Up to ``DIRECT`` texts under a key list every pair. In larger groups each text first lists
its ``BEST`` most alike nearby; what that has linked is one component, and all pairs that would
link different components are compared after that, in units of two parts of the group, and
verified there. So pairs grow with rows, and no link between components is lost. A key of n
texts costs at most n^2 / 2 comparisons of 64 bytes, spread over its units.

Null texts count as empty; texts without words are one group. Copies are one node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import cut, fresh_dir, giving_back, let_go, partitions, remove_dir
from .components import components

WIDTH, SIMILAR, BYTES, ROWS, NEED = 5, 0.8, 64, 4, 38
DIRECT, BEST, BLOCK, PART, PART_BYTES = 64, 8, 2048, 8192, 1 << 24
_RNG = np.random.default_rng(20)
XOR, MUL = (_RNG.integers(0, 1 << 63, BYTES, dtype=np.uint64) for _ in range(2))
MUL = MUL << np.uint64(1) | np.uint64(1)


def node(text: str = "text") -> Column:
    """16 bytes that stand for a text; one value for all texts without words."""
    return F.unhex(F.md5(F.when(F.col(text).rlike("[^\\x20\\x09-\\x0D]"), F.col(text)).otherwise("").cast("binary")))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct values of a text's shingles; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - width + 1)
    begin, end = [0, *ends[: n - 1].tolist()], (ends[min(width, len(words)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[i:j], 42) for i, j in zip(begin, end)], np.uint64))


def least(values: np.ndarray) -> np.ndarray:
    """The least mixed value for each byte of the fingerprint."""
    out = np.full(BYTES, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(values), 512):
        np.minimum(out, ((values[a : a + 512, None] ^ XOR) * MUL).min(0), out=out)
    return out


def fingerprints(texts: DataFrame) -> DataFrame:
    """node, text to node, sim (SimHash), fp (64 bytes), keys, m (number of shingles). Narrow."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fps, keys, sizes = [], [], []
            sims = np.array([simhash.fingerprint(t) for t in pdf["text"].tolist()], np.uint64).view(np.int64)
            for t in pdf["text"].tolist():
                values = shingles(t)
                m = least(values)
                sizes.append(len(values))
                fps.append((m & np.uint64(255)).astype(np.uint8).tobytes())
                keys.append([xxhash.xxh64_intdigest(m[a : a + ROWS].tobytes(), a) - (1 << 63) for a in range(0, BYTES, ROWS)])
            yield pd.DataFrame({"node": pdf["node"], "sim": sims, "fp": fps, "keys": keys, "m": sizes})

    return texts.mapInPandas(giving_back(run), "node binary, sim long, fp binary, keys array<long>, m long")


def simhash_pairs(marked: DataFrame) -> DataFrame:
    """u, v: pairs of nodes that SimHash proposes; marked: node, sim. Of equal fingerprints each text with the least one, of fingerprints that the index links the least texts."""
    first = marked.groupBy("sim").agg(F.min("node").alias("rep"))
    same = marked.join(first, "sim").filter("node <> rep").select(F.col("node").alias("u"), F.col("rep").alias("v"))
    linked = simhash.links(first.select(F.col("sim").alias("fp")))
    of = lambda c: first.select(F.col("sim").alias(c), F.col("rep").alias(f"{c}_rep"))
    two = linked.join(of("u"), "u").join(of("v"), "v").select(F.greatest("u_rep", "v_rep").alias("u"), F.least("u_rep", "v_rep").alias("v"))
    return same.union(two)


def alike(fp: np.ndarray, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs of one key's fingerprints uint8[n, BYTES] by place: all of up to ``DIRECT`` texts; of more, the ``BEST`` of each within windows of ``BLOCK``. Texts of one label are linked already and give none."""
    n, left, right = len(fp), [], []
    for a in range(0, n, BLOCK // 2):
        part = fp[a : a + BLOCK]
        for i in range(1, len(part)):
            same = (part[:i] == part[i]).sum(1)
            hit = np.flatnonzero(same >= NEED)
            if label is not None:
                hit = hit[label[a + hit] != label[a + i]]
            if n > DIRECT and len(hit) > BEST:
                hit = hit[np.argsort(-same[hit], kind="stable")[:BEST]]
            left.append(np.full(len(hit), a + i))
            right.append(a + hit)
        if a + BLOCK >= n:
            break
    return np.concatenate(left), np.concatenate(right)


def across(fp: np.ndarray, keys: np.ndarray, band: int, root: np.ndarray, first: np.ndarray, sets: list[np.ndarray], similar: float) -> list[tuple[int, int]]:
    """Links of a unit by place, as many as bring together what similarity of at least ``similar`` brings together.

    first: whether a row belongs to the first of the unit's two parts; if both kinds are
    there, rows of one part are compared with those of the other, else all with each other.
    Only pairs of different components that pass the count filter are verified, each in the
    first of the bands whose keys they share; a link makes its two components one.
    """
    two, label = first.any() and not first.all(), root.copy()
    a, b = (np.flatnonzero(first), np.flatnonzero(~first)) if two else (np.arange(len(fp)), np.arange(len(fp)))
    out = []
    for i in a.tolist():
        others = b if two else b[:i]
        others = others[label[others] != label[i]]
        if not len(others):
            continue
        same = (fp[others] == fp[i]).sum(1)
        hit = others[same >= NEED][np.argsort(-same[same >= NEED], kind="stable")]
        hit = hit[(keys[hit] == keys[i]).argmax(1) == band]
        for j in hit.tolist():
            if label[j] != label[i]:
                x, y = sets[i], sets[j]
                common = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similar * max(len(x), len(y)) else 0
                if common >= similar * (len(x) + len(y) - common):
                    out.append((i, j))
                    label[label == label[j]] = label[i]
    return out


Group = dict[str, np.ndarray]


def grouped(rows: DataFrame, key: str, pairs: Callable[[Group], dict[str, list]], schema: str) -> DataFrame:
    """``pairs`` of each group of two rows or more, of rows that are dealt and sorted by ``key``; a task holds one group besides a batch."""
    names = [c.split()[0] for c in schema.split(", ")]

    def close(out: dict[str, list], parts: list[Group]) -> None:
        if sum(len(g[key]) for g in parts) > 1:
            whole = parts[0] if len(parts) == 1 else {c: np.concatenate([g[c] for g in parts]) for c in parts[0]}
            for name, values in pairs(whole).items():
                out[name] += values

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: list[Group] = []
        for pdf in batches:
            if not len(pdf):
                continue
            held, out = {c: pdf[c].to_numpy() for c in pdf.columns}, {n: [] for n in names}
            k = held[key]
            cuts = np.r_[0, np.flatnonzero(k[1:] != k[:-1]) + 1, len(k)]
            part = lambda g: {c: v[cuts[g] : cuts[g + 1]] for c, v in held.items()}  # noqa: B023, E731
            if open_ and open_[0][key][0] != k[0]:
                close(out, open_)
                open_ = []
            last = len(cuts) - 2
            if last:
                close(out, [*open_, part(0)])
                for g in np.flatnonzero(np.diff(cuts[1:-1]) > 1).tolist():
                    close(out, [part(g + 1)])
                open_ = []
            open_.append(part(last))
            yield pd.DataFrame(out)
        out = {n: [] for n in names}
        if open_:
            close(out, open_)
        yield pd.DataFrame(out)

    return rows.mapInPandas(giving_back(run), schema)


def _bytes(column: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(len(column), -1)


def _pairs(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> dict[str, list[bytes]]:
    x, y = [bytes(n) for n in nodes[i]], [bytes(n) for n in nodes[j]]
    return {"u": list(map(max, x, y)), "v": list(map(min, x, y))}


def candidates(held: DataFrame) -> DataFrame:
    """u, v: pairs of nodes that the index proposes; held: node, fp, k, label (texts of one label are linked already)."""
    rows = held.repartition(partitions(held.sparkSession), "k").sortWithinPartitions("k", "fp", "node")

    def pairs(group: Group) -> dict[str, list]:
        label = pd.factorize(np.array([bytes(x) for x in group["label"]], dtype=object))[0]
        return _pairs(group["node"], *alike(_bytes(group["fp"]), label))

    return grouped(rows, "k", pairs, "u binary, v binary").distinct()


def remaining(held: DataFrame, roots: DataFrame, texts: DataFrame, similar: float) -> DataFrame:
    """u, v: links between different components under keys of more than ``DIRECT`` texts; held: node, fp, keys, m (shingles), band, k.

    A key is cut into parts of ``PART`` texts and ``PART_BYTES`` of shingles; each two parts (and each
    part itself) are a unit of work, so no task holds a hot key. A component that fills a part has parts
    of its own, which aren't compared with each other. Pairs are verified in their unit and only links
    leave it, fewer than the unit has texts.
    """
    spark = held.sparkSession
    named = held.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = named.groupBy("k", "root").agg(F.count("*").alias("c"), F.sum("m").alias("s"))
    keys = sizes.groupBy(F.col("k").alias("k1")).agg(F.sum("c").alias("n"), F.sum("s").alias("sum"), F.count("*").alias("roots")).filter((F.col("n") > DIRECT) & (F.col("roots") > 1))
    parts_of = lambda n, s: F.greatest(F.lit(1), F.ceil(n / F.lit(PART)), F.ceil(s * 8 / F.lit(PART_BYTES))).cast("int")
    own = sizes.filter(parts_of(F.col("c"), F.col("s")) > 1).select(F.col("k").alias("k2"), F.col("root").alias("root2"), "c", "s")
    rows = named.join(keys, F.col("k") == F.col("k1")).drop("k1", "roots").join(own, (F.col("k") == F.col("k2")) & (F.col("root") == F.col("root2")), "left").drop("k2", "root2")
    # o: 0 where components share parts, else the component's own hash
    o = F.when(F.col("c").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("root"))
    rows = rows.withColumns({"o": o, "p": F.pmod(F.xxhash64("node"), parts_of(F.coalesce("c", "n"), F.coalesce("s", "sum")))})
    rows = cut(rows.select("k", "band", "node", "fp", "keys", "root", "o", "p"))
    parts = rows.select("k", "o", "p").distinct()
    two = parts.alias("a").join(parts.alias("b"), F.col("a.k") == F.col("b.k")).filter("struct(a.o, a.p) <= struct(b.o, b.p) AND (a.o = 0 OR a.o <> b.o)")
    unit = F.xxhash64("a.k", "a.o", "a.p", "b.o", "b.p")
    units = two.select(F.col("a.k").alias("k"), F.col("a.o").alias("o"), F.col("a.p").alias("p"), unit.alias("unit"), F.lit(True).alias("first"))
    units = units.union(two.filter("a.o <> b.o OR a.p <> b.p").select(F.col("b.k"), F.col("b.o"), F.col("b.p"), unit, F.lit(False)))
    own_sets = shingle_sets(texts, rows.select("node").distinct())
    dealt = rows.join(units, ["k", "o", "p"]).join(own_sets, "node").select("unit", "first", "band", "node", "fp", "keys", "root", "s")
    dealt = dealt.repartition(partitions(spark), "unit").sortWithinPartitions("unit", "node")

    def pairs(group: Group) -> dict[str, list]:
        number = pd.factorize(np.array([bytes(r) for r in group["root"]], dtype=object))[0]
        found = across(_bytes(group["fp"]), np.stack(group["keys"]), int(group["band"][0]), number, group["first"].astype(bool), list(group["s"]), similar)
        i, j = np.array(found, np.int64).reshape(-1, 2).T
        return _pairs(group["node"], i, j)

    return grouped(dealt, "unit", pairs, "u binary, v binary").distinct()


def shingle_sets(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """node, s: the shingles of the nodes that are asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["node"], "s": [shingles(t).view(np.int64) for t in pdf["text"].tolist()]})

    return texts.join(asked, "node", "left_semi").dropDuplicates(["node"]).mapInPandas(giving_back(run), "node binary, s array<long>")


def verified(texts: DataFrame, pairs: DataFrame, similar: float) -> DataFrame:
    """The pairs whose sets of shingles are that similar, exactly. The sets lie on disk only until the pairs are verified."""
    spark = texts.sparkSession
    at, pairs = fresh_dir(spark, "sets"), cut(pairs)
    shingle_sets(texts, pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()).write.parquet(at)
    let_go(spark)
    sets = spark.read.schema("node binary, s array<long>").parquet(at)
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("s").alias("b")), "v")
    common = F.size(F.array_intersect("a", "b"))
    links = cut(both.filter(common >= F.lit(similar) * (F.size("a") + F.size("b") - common)).select("u", "v"))
    remove_dir(spark, at)
    del both, sets
    let_go(spark)
    return links


def near_copies(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """node, root for every distinct text that is linked with another, by chains of similarity of at least ``similar``."""
    texts = docs.select(node().alias("node"), "text").filter(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    marked = cut(fingerprints(texts).dropDuplicates(["node"]))
    first = verified(texts, simhash_pairs(marked.select("node", "sim")), similar)
    label = first.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label"))
    named = marked.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    held = cut(named.select("node", "fp", "keys", "m", "label", F.posexplode("keys").alias("band", "k")))
    sure = verified(texts, candidates(held.select("node", "fp", "k", "label")), similar).union(first)
    roots = components(sure)
    # texts under keys in which not all were listed: what is not linked yet is compared
    large = held.groupBy("k").agg(F.count("*").alias("n")).filter(F.col("n") > DIRECT).drop("n")
    more = cut(remaining(held.drop("label").join(large, "k", "left_semi"), roots, texts, similar))
    return roots if more.isEmpty() else components(sure.union(more))
