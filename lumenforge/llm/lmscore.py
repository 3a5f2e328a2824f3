"""LM scoring by online logistic context mixing over word codes.

A text is its lower-cased words, then one end, which counts as a token. As in
compressors that first replace words by codes, the bits that are coded are those of
each token's code; the modules beside this one hold the steps:

1. ``lmwords``: documents as numbers of their chunk's words; every word's count over
   all training texts; a prefix code for words that training holds twice or more.
2. ``lmspell``: the other words are spelled, byte by byte, by bit predictors.
3. ``lmpairs``: which word follows two words, counted exactly over the corpus.
4. ``lmmixer``: every bit of every token of every text is scored by several hashed
   context predictors and predicted words, mixed by gated weights that are refined
   on the way, with an adaptive map behind.

score is the sum over tokens of log10 P(code) + log10 P(word | code); total_bits is
the same in bits, and bits_per_byte relates it to the text's bytes (n_bytes; null for an
empty text). Words of training texts are left out of their own counts.

A null text is empty, so its score is that of one end. An empty table gives no rows.
Ids may be null or repeated: each row has its own result. A null id counts as the
empty text in the split. Columns beside doc_id and text are ignored. Without training
rows N = V = 0 and every word is spelled by predictors that have seen nothing.

Scale: what is known of chunks lies bucketed by chunk, so the passes over it shuffle nothing. Chunks are bounded by words and tokens, the number of buckets follows the
bytes of the input, so that a bucket's part of the vocabulary and of the word pairs
stays the same. The hashed tables alone are bounded, by 2^slot_bits counters a
predictor, which each worker holds; their contexts are few by design (frequent words).
The driver sees class sizes, the hashes of at most 4096 words of a class, and slices
of the tables, and eight sums of what training tokens say of the weights (a few KB each). A
bounded sample of training texts, chosen by hash, is only where the weights' step over all
training texts begins; they move on within each document alone, so a score doesn't depend on how an input is split, and
rows of equal text on one side of the split have equal scores.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lmmixer, lmpairs, lmspell
from .common import by_chunk, fresh_dir, give_back, giving_back, id_crc, let_go, partitions, remove_dir
from .lmwords import CHUNKS, DOCS, MERGED, array, class_of, codebook, codes_of, merge_bucket, open_, press, split_words, write_chunks

SPELL_BITS, SLICES = 20, 64
RUN = 1 << 17  # tokens of documents taken together
SAMPLE, SAMPLE_DOCS = 1 << 18, 4096  # tokens and documents from whose weights the step over all training texts begins
WARM_WORDS = 4000  # spelled words by which a bucket's weights start
LN10, LN2 = np.log(10.0), np.log(2.0)


def summed(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of uint32 tables that tasks sent in slices (slice int, body binary), as uint32. A task adds one slice after the other; sums end at 2^32 - 1."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, table = -1, np.zeros(0, np.uint64)
        done = lambda: pd.DataFrame({"slice": [now], "body": [press(np.minimum(table, 0xFFFFFFFF).astype("<u4").tobytes())]})
        for pdf in batches:
            for k, body in zip(pdf["slice"].tolist(), pdf["body"]):
                part = array(body, "<u4")
                if k != now:
                    if now >= 0:
                        yield done()
                    now, table = k, np.zeros(len(part), np.uint64)
                table += part
        if now >= 0:
            yield done()

    sliced = parts.repartition(SLICES, "slice").sortWithinPartitions("slice")
    table = np.zeros((SLICES, size // SLICES), "<u4")
    for r in sliced.mapInPandas(add, "slice int, body binary").toLocalIterator():
        table[r["slice"]] = array(bytes(r["body"]), "<u4")
    return table.reshape(-1)


def narrow(table: np.ndarray) -> np.ndarray:
    """Counters [..., 2] in 16 bits; where a slot has more, both are scaled alike."""
    scale = np.minimum(1.0, 65535.0 / np.maximum(1, table.max(-1)))
    return np.minimum(65535, np.ceil(table * scale[..., None])).astype("<u2")


def sliced(table: np.ndarray) -> Iterator[pd.DataFrame]:
    for k, part in enumerate(table.reshape(SLICES, -1)):
        yield pd.DataFrame({"slice": [k], "body": [press(part.astype("<u4").tobytes())]})


def sent_out(df: DataFrame, table: np.ndarray) -> tuple:
    """A table as a broadcast of its compressed bytes, since every executor keeps a copy on its disk."""
    return df.sparkSession.sparkContext.broadcast(press(table.tobytes())), table.dtype.str, table.shape


def received(sent: tuple) -> np.ndarray:
    return array(sent[0].value, sent[1]).reshape(sent[2])


def in_few_tasks(df: DataFrame, n_bytes: int) -> DataFrame:
    """Tasks that each send a whole table: as many as run at once, or one for 4 GB of text."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, n_bytes >> 32, 1))


def spell_table(merged: DataFrame, n_bytes: int, slot_bits: int) -> np.ndarray:
    """Counts of the words that training holds once."""

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros((len(lmspell.ORDERS), 2 << slot_bits), np.uint32)
        for pdf in batches:
            for r in pdf.itertuples():
                once = (array(r.counts, "<i8") == 1).tolist()
                lmspell.count_slots([w for w, k in zip(split_words(r.body), once) if k], slot_bits, table)
        yield from sliced(table)

    parts = in_few_tasks(merged.select("body", "counts"), n_bytes).mapInPandas(giving_back(tables), "slice int, body binary")
    n = len(lmspell.ORDERS)
    return narrow(summed(parts, n * (2 << slot_bits)).reshape(n, 1 << slot_bits, 2))


def word_answers(merged: DataFrame, book: dict, table: np.ndarray) -> DataFrame:
    """To each chunk its words' counts, symbols, bits of symbols, codes, log probabilities of the words that are spelled, and hashes."""
    sent = sent_out(merged, table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = received(sent)
        for pdf in batches:
            for r in pdf.itertuples():
                words, count = split_words(r.body), array(r.counts, "<i8")
                symbol, length, code, h = codes_of(words, count, book["book"])
                inner, speller = np.zeros(len(words), "<f4"), lmspell.Speller(counts)
                once, never = np.flatnonzero(count == 1), np.flatnonzero(count == 0)
                if len(once):
                    once = once[np.argsort(h[once], kind="stable")]  # neighbours in the alphabet don't follow each other
                    ws = [words[i] for i in once.tolist()]
                    speller.run(ws[:WARM_WORDS], True)
                    inner[once] = speller.run(ws, True)
                if len(never):
                    inner[never] = speller.run([words[i] for i in never.tolist()], False)
                known = {"seen": count, "symbol": symbol, "length": length, "code": code, "inner": inner, "hash": (h & np.uint64(0xFFFFFFFF)).astype("<u4")}
                places, refs, a = array(r.places, "<u4"), array(r.refs, "<u4"), 0
                out: dict[str, list] = {c: [] for c in ("chunk", "places", *KINDS)}
                for chunk, size in zip(r.chunks, r.sizes):
                    ref = refs[a : a + size]
                    out["chunk"].append(chunk)
                    out["places"].append(press(places[a : a + size].tobytes()))
                    for c in KINDS:
                        out[c].append(press(known[c][ref].tobytes()))
                    a += size
                yield pd.DataFrame(out)

    return merged.mapInPandas(giving_back(run), "chunk long, places binary, " + ", ".join(f"{c} binary" for c in KINDS))


KINDS = {"seen": "<i8", "symbol": "<u1", "length": "<u1", "code": "<u4", "inner": "<f4", "hash": "<u4"}
CODED = "chunk long, doc_ids array<{id}>, held array<boolean>, lens array<int>, sizes array<long>, body binary, " + ", ".join(f"{k} binary" for k in KINDS)


def with_codes(docs: DataFrame, answers: DataFrame, id_type: str) -> DataFrame:
    """Chunks with an array for each thing that is known of their words."""

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        places = [array(b, "<u4") for b in right["places"]]
        top = sum(map(len, places))
        row = left.iloc[0].to_dict()
        for name, kind in KINDS.items():
            whole = np.zeros(top, kind)
            for p, b in zip(places, right[name]):
                whole[p] = array(b, kind)
            row[name] = press(whole.tobytes())
        return pd.DataFrame([row])

    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(run, CODED.format(id=id_type))


class Coded:
    """A chunk's tokens."""

    def __init__(self, r) -> None:
        self.t, self.lens, self.held = array(r.body, "<u4"), np.array(r.lens, np.int64), np.array(r.held, bool)
        self.words = {k: array(getattr(r, k), kind) for k, kind in KINDS.items()}
        self.first = np.cumsum(self.lens) - self.lens

    def of(self, name: str, a: int = 0, b: int | None = None) -> np.ndarray:
        return self.words[name][self.t[a:b]]

    def train(self) -> np.ndarray:
        return np.repeat(~self.held, self.lens).astype(np.uint8)

    def runs(self) -> Iterator[tuple[int, int]]:
        """Documents a to b of about RUN tokens."""
        a, n = 0, 0
        for k, size in enumerate(self.lens.tolist()):
            if k > a and n + size > RUN:
                yield a, k
                a, n = k, 0
            n += size
        yield a, len(self.lens)

    def span(self, a: int, b: int) -> slice:
        return slice(self.first[a], self.first[b - 1] + self.lens[b - 1])


ANSWERS = "chunk long, bucket int, said binary"
ROW = ["chunk", "held", "lens", "body", *KINDS]


def rows_of(c: Coded, s: slice, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return lmmixer.rows_of(c.of("code", s.start, s.stop), c.of("length", s.start, s.stop) >= 128, lens)


def symbol_table(coded: DataFrame, n_bytes: int) -> np.ndarray:
    """How often training has each symbol behind each context: uint32[2, rows, symbols]."""
    shape = (2, 1 << lmmixer.ROWS, lmmixer.NODES)

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(shape, np.uint32)
        for pdf in batches:
            for r in pdf.itertuples():
                if r.chunk < 0:
                    continue
                c = Coded(r)
                train = c.train()
                for a, b in c.runs():
                    s = c.span(a, b)
                    lmmixer.count(c.of("symbol", s.start, s.stop), rows_of(c, s, c.lens[a:b]), train[s], table)
        yield from sliced(table)

    return summed(in_few_tasks(coded.select(*ROW), n_bytes).mapInPandas(giving_back(tables), "slice int, body binary"), 2 << lmmixer.ROWS + lmmixer.SYMBOL).reshape(shape)


def keys_of(c: Coded, bucket_bits: int) -> tuple[np.ndarray, np.ndarray]:
    return lmpairs.keys_of(c.of("symbol"), c.of("code"), c.of("hash"), c.lens, c.train(), bucket_bits)


def pair_answers(coded: DataFrame, bucket_bits: int) -> DataFrame:
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                key, bucket, count = lmpairs.requests(*keys_of(Coded(r), bucket_bits), bucket_bits)
                count = count * (r.chunk >= 0)
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    yield pd.DataFrame({"bucket": [int(bucket[a])], "chunk": [r.chunk], "keys": [lmpairs.packed(key[a:b])], "counts": [press(count[a:b].astype("<u4").tobytes())]})

    asked = coded.select(*ROW).mapInPandas(giving_back(ask), "bucket int, chunk long, keys binary, counts binary")
    return asked.groupBy("bucket").applyInPandas(lmpairs.merge_pairs, ANSWERS)


def scores(coded: DataFrame, answers: DataFrame, table: np.ndarray, book: dict, bucket_bits: int, id_type: str) -> DataFrame:
    whole = lmmixer.as_bits(table[0].sum(0, dtype=np.int64)[None])
    sent = sent_out(coded, np.stack([lmmixer.as_bits(t) for t in table]))
    n, v, mass = book["n"], book["v"], book["mass"]

    class Chunk:
        """A chunk's tokens with all that their bits are scored by."""

        def __init__(self, left: pd.DataFrame, right: pd.DataFrame) -> None:
            self.r = next(left.itertuples())
            self.c = c = Coded(self.r)
            self.train, seen = c.train(), c.words["seen"]
            said = np.concatenate([array(b, np.uint8) for b in right.sort_values("bucket")["said"]])
            self.said = said[lmpairs.places(*keys_of(c, bucket_bits), bucket_bits)]
            # a word's cost behind its symbol, for held-out texts and for training texts, which leave it out once
            all_ = mass[c.words["symbol"]]
            self.behind = np.stack([np.where(seen > 1, np.log(np.maximum(1, all_ - own) / np.maximum(1, seen - own)), -c.words["inner"]) for own in (0, 1)])
            self.shared = (seen < 2) | (all_ > seen)

        def bits(self, a: int, b: int) -> tuple:
            c = self.c
            s, lens = c.span(a, b), c.lens[a:b]
            t, symbol, said = c.t[s], c.of("symbol", s.start, s.stop), self.said[s]
            pair = (said >> np.uint8(5), said >> np.uint8(1) & np.uint8(15), (said & np.uint8(1)) == 1)
            return symbol, c.of("length", s.start, s.stop) & np.uint8(127), rows_of(c, s, lens), self.train[s], [pair, lmmixer.local(t, symbol, lens)], self.behind[self.train[s], t], self.shared[t]

        def trained(self, a: int, b: int) -> tuple:
            """The bits of training tokens alone."""
            symbol, length, rows, train, said, _, shared = self.bits(a, b)
            at = np.flatnonzero(train)
            return symbol[at], length[at], [r[at] for r in rows], [tuple(x[at] for x in one) for one in said], shared[at]

    def fit(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        k, mixer = Chunk(left, right), lmmixer.Mixer(whole, received(sent))
        for _ in range(2):
            mixer.cost(*k.bits(0, len(k.c.lens)))
        give_back()
        return pd.DataFrame({"chunk": [k.r.chunk], "state": [pickle.dumps(mixer.state())]})

    together = lambda which: coded.filter(which).select("doc_ids", "sizes", *ROW).groupBy("chunk").cogroup(answers.filter(which).groupBy("chunk"))
    states = together("chunk < 0").applyInPandas(fit, "chunk long, state binary").collect()
    state = pickle.loads(states[0]["state"]) if states else {}

    def gather(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        k, mixer, sums = Chunk(left, right), lmmixer.Mixer(whole, received(sent)), lmmixer.no_sums()
        mixer.resume(state)
        for a, b in k.c.runs():
            mixer.gather(sums, *k.trained(a, b))
        give_back()
        return pd.DataFrame({"sums": [pickle.dumps(sums)]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = lmmixer.no_sums()
        for pdf in batches:
            for part in map(pickle.loads, pdf["sums"]):
                for name, value in part.items():
                    total[name] += value
        yield pd.DataFrame({"sums": [pickle.dumps(total)]})

    if states:
        gathered = together("chunk >= 0").applyInPandas(gather, "sums binary").mapInPandas(add, "sums binary")
        total, mixer = lmmixer.no_sums(), lmmixer.Mixer(whole, whole[:0])
        mixer.resume(state)
        for r in gathered.repartition(8).mapInPandas(add, "sums binary").collect():
            for name, value in pickle.loads(r["sums"]).items():
                total[name] += value
        mixer.settle(total)
        state = mixer.state()
        del mixer, gathered

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        k, mixer = Chunk(left, right), lmmixer.Mixer(whole, received(sent))
        mixer.resume(state)
        c, seen = k.c, k.c.words["seen"]
        base = np.log10((seen + 1.0) / (n + 1.0 * (v + 1)))
        known = (seen > 0).astype(np.int64)
        nats, sums, knowns = np.empty(len(c.lens)), np.empty(len(c.lens)), np.empty(len(c.lens), np.int64)
        for a, b in c.runs():
            s, at = c.span(a, b), c.first[a:b] - c.first[a]
            nats[a:b] = np.add.reduceat(-mixer.cost_apart(*k.bits(a, b), c.lens[a:b]), at)
            sums[a:b], knowns[a:b] = np.add.reduceat(base[c.t[s]], at), np.add.reduceat(known[c.t[s]], at)
        give_back()
        sizes = np.array(k.r.sizes, np.int64)
        per_byte = np.where(sizes > 0, -nats / LN2 / np.maximum(1, sizes), np.nan)
        return pd.DataFrame({
            "doc_id": pd.Series(list(k.r.doc_ids), dtype="object"), "held_out": c.held, "n_tokens": c.lens, "n_known": knowns, "train_tokens": n, "base_score": sums,
            "score": nats / LN10, "total_bits": -nats / LN2, "n_bytes": sizes, "bits_per_byte": per_byte, "bits_per_token": -nats / LN2 / c.lens,
        })

    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, total_bits double, n_bytes long, bits_per_byte double, bits_per_token double"
    return together("chunk >= 0").applyInPandas(run, schema)


def sampled(docs: DataFrame, tokens: int = SAMPLE) -> DataFrame:
    """Training documents from whose weights the step over all training texts begins: those with the smallest hashes of id and text, of equal rows one, up to ``tokens`` words and at most ``SAMPLE_DOCS``; one at least, if there are any."""
    h = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    train = docs.filter(id_crc() % 7 != 2).select("doc_id", "text", h.alias("h"))
    sizes = train.groupBy("h").agg(F.max(F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)) + 1).alias("n"))
    first = sizes.orderBy("h").limit(SAMPLE_DOCS).collect()
    upto = np.cumsum([r["n"] for r in first])
    last = max(0, int(np.searchsorted(upto, tokens, "right")) - 1)
    which = F.col("h") <= first[last]["h"] if first else F.lit(False)
    return train.filter(which).dropDuplicates(["h"]).coalesce(1).sortWithinPartitions("h").select("doc_id", "text")


def score_text(docs: DataFrame, spell_bits: int = SPELL_BITS, most_words: int = 300_000, most_tokens: int = 1_000_000, bucket_bytes: int = 1 << 22) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, total_bits, n_bytes, bits_per_byte, bits_per_token.

    bucket_bytes: bytes of input for each bucket of words and word pairs.
    """
    spark = docs.sparkSession
    at, id_type = fresh_dir(spark, "lm"), docs.schema["doc_id"].dataType.simpleString()
    n_docs, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    bucket_bits = max(3, (n_bytes // bucket_bytes).bit_length())
    write_chunks(docs, sampled(docs), f"{at}/chunks", bucket_bits, most_words, most_tokens)
    chunks = spark.read.schema(CHUNKS.format(id=id_type)).parquet(f"{at}/chunks")
    asked = chunks.filter("kind = 'word'").select("bucket", "chunk", "body", "places", "counts")
    asked.groupBy("bucket").applyInPandas(merge_bucket, MERGED).write.parquet(f"{at}/merged")
    del asked
    remove_dir(spark, f"{at}/chunks/kind=word")
    let_go(spark)
    merged = spark.read.schema(MERGED).parquet(f"{at}/merged")
    book = codebook(merged)
    spelled = spell_table(merged, n_bytes, spell_bits)
    whole = spark.read.schema(DOCS.format(id=id_type)).parquet(f"{at}/chunks/kind=doc") if n_docs else chunks
    texts = whole.select("chunk", "doc_ids", "held", "lens", "sizes", "body")
    coded = by_chunk(with_codes(texts, word_answers(merged, book, spelled), id_type), f"{at}/coded")
    for done in ("chunks", "merged"):
        remove_dir(spark, f"{at}/{done}")
    del chunks, whole, merged, texts
    let_go(spark)
    answers = by_chunk(pair_answers(coded, bucket_bits).repartition(partitions(spark), "chunk"), f"{at}/pairs")
    let_go(spark)
    return scores(coded, answers, symbol_table(coded, n_bytes), book, bucket_bits, id_type)


def op1(docs: DataFrame) -> DataFrame:
    return score_text(docs)
