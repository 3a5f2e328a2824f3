"""Byte-level BPE by a global shuffle of distinct words.

1. Texts are cut into pre-tokens by the tokenizer's pattern. A chunk (what a task reads,
   up to ``CHUNK_BYTES`` of text, or one longer document) keeps each document's
   pre-tokens in order as numbers of the chunk's own different words, and deals those
   words by hash to buckets; so a word is sent once a chunk, however frequent it is.
2. Words are shuffled by bucket. All chunks' words of a bucket meet in one task, which
   encodes each different word once and gives every chunk the ids of its words back.
3. Ids return to their chunk, are put in the place of the numbers, and documents are
   put together by position.
4. Decoding joins ids with the table of tokens' bytes (as large as the vocabulary,
   which bounds it, so it is broadcast).

Words and numbers are written once to the shared folder (Spark's committer; both come from
one pass, so a repeated task can't number them differently), bucketed by chunk: numbers,
most of the bytes, stay where they are and only words and their ids are shuffled.

Pre-tokens are found with ``regex``; letters and digits are the tokenizer library's own:
characters of which the two libraries think otherwise (Unicode versions) are replaced by
ones of the right kind while a text is cut. Each piece is encoded by the library.

Null texts count as empty and have no ids. Rows are independent of each other: ids may
be null or repeated, extra columns play no part, an empty table gives an empty one.

Scale: per chunk one row for each bucket that it has words in, compressed; buckets follow
``spark.sql.shuffle.partitions``. A task holds one chunk's ids or one bucket's words.
"""

from __future__ import annotations

import base64
import re
import uuid
import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, give_back, giving_back, partitions, remove_dir, shared_dir

CHUNK_BYTES, PIECE_TOKENS = 1 << 23, 1 << 17
#: Characters of a kind on which all versions of Unicode agree, none of them part of a contraction.
_KINDS = {(True, False): "Ж", (False, True): "7", (False, False): "§"}
#: A blank behind white space; a blank behind anything else, where texts may be cut.
_SPACES, _BEFORE_BLANK = re.compile(r"\s "), re.compile(r"(?<=\S) ")


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Cutter:
    """Cuts texts into pre-tokens as the tokenizer library does."""

    def __init__(self, pattern: str) -> None:
        import tiktoken

        single = {bytes([b]): b for b in range(256)}
        self.pattern = regex.compile(pattern)
        self.theirs = [tiktoken.Encoding(c, pat_str=c, mergeable_ranks=single, special_tokens={}) for c in (r"\p{L}", r"\p{N}")]
        self.ours = [regex.compile(c) for c in (r"\p{L}", r"\p{N}")]
        self.known: set[str] = {chr(c) for c in range(128)}
        self.odd: dict[int, str] = {}

    def _learn(self, chars: set[str]) -> None:
        for c in chars:
            theirs = tuple(bool(e.encode_ordinary(c)) for e in self.theirs)
            if theirs != tuple(bool(r.match(c)) for r in self.ours) and not c.isspace():
                self.odd[ord(c)] = _KINDS[theirs]
        self.known |= chars

    def cut(self, text: str) -> list[str]:
        if text.isascii():
            return self.pattern.findall(text)
        chars = set(text)
        if not chars <= self.known:
            self._learn(chars - self.known)
        if not self.odd or not any(chr(c) in chars for c in self.odd):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(text.translate(self.odd))]


def _planes(numbers: np.ndarray, press) -> bytes:
    """Whole numbers, byte plane by byte plane: high planes are nearly all zero."""
    return press(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unplanes(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(raw.T).view("<u4").reshape(-1)


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of all members, of stretches that begin at ``begin`` and have ``size`` members."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


def _lens(items: list[bytes]) -> np.ndarray:
    return np.fromiter(map(len, items), np.uint32, len(items))


def _split(body: bytes, lens: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lens, dtype=np.int64).tolist()
    return [body[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def segments(text: str) -> list:
    """Stretches that no pre-token crosses, each but the first without the blank before it; the first is a tuple.

    Nothing in the pattern goes on from a character that isn't white space to one that is.
    """
    parts = text.split(" ") if not _SPACES.search(text) and text[0] != " " else _BEFORE_BLANK.split(text)
    parts[0] = (parts[0],)
    return parts


def explode(docs: DataFrame, pattern: str, buckets: int, id_col: str = "doc_id") -> DataFrame:
    """kind 0: a chunk's different words of one bucket; kind 1: documents as numbers of their chunk's words.

    Words are numbered bucket by bucket, so a chunk's ids come back in the order of its
    numbers. Stretches between blanks are numbered first and each different one is cut
    into pre-tokens once a chunk.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter, press = Cutter(pattern), zstandard.ZstdCompressor(level=3).compress
        chunk = TaskContext.get().partitionId() << 32
        number: defaultdict = defaultdict()
        number.default_factory = number.__len__
        ids, seqs, held = [], [], 0

        def close() -> Iterator[pd.DataFrame]:
            nonlocal chunk, ids, seqs, held
            word: defaultdict = defaultdict()
            word.default_factory = word.__len__
            counts, flat = array("I"), array("I")
            for part in number:
                pieces = cutter.cut(" " + part if isinstance(part, str) else part[0])
                counts.append(len(pieces))
                flat.extend(map(word.__getitem__, pieces))
            number.clear()
            words = [w.encode("utf-8", "surrogatepass") for w in word]
            del word
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(words), np.uint32)
            place[order] = np.arange(len(words), dtype=np.uint32)
            size = np.frombuffer(counts, np.uint32).astype(np.int64)
            begin, numbers = np.cumsum(size) - size, place[np.frombuffer(flat, np.uint32)] if len(flat) else np.zeros(0, np.uint32)
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0]) if len(words) else np.zeros(0, int)
            out = []
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(words)]):
                mine = [words[k] for k in order[a:b].tolist()]
                out.append({"kind": 0, "chunk": chunk, "bucket": int(bucket[order[a]]), "place": a, "lens": _planes(_lens(mine), press), "body": press(b"".join(mine)), "ids": []})
            yield pd.DataFrame(out, columns=COLUMNS)
            at, n = 0, 0
            for k in range(len(seqs)):
                n += len(seqs[k])
                if n >= PIECE_TOKENS or k + 1 == len(seqs):
                    part = np.concatenate(seqs[at : k + 1])
                    lens = np.add.reduceat(np.r_[size[part], 0], np.cumsum([0, *map(len, seqs[at:k])])) * np.fromiter(map(bool, map(len, seqs[at : k + 1])), np.int64)
                    row = {"kind": 1, "chunk": chunk, "bucket": -1, "place": at, "lens": _planes(lens, press), "body": _planes(numbers[_spread(begin[part], size[part])], press), "ids": ids[at : k + 1]}
                    yield pd.DataFrame([row], columns=COLUMNS)
                    at, n = k + 1, 0
            chunk, held, ids, seqs = chunk + 1, 0, [], []

        for pdf in batches:
            for i, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                t = t or ""
                if ids and held + len(t) > CHUNK_BYTES:
                    yield from close()
                parts = segments(t) if t else []
                seqs.append(np.fromiter(map(number.__getitem__, parts), np.uint32, len(parts)))
                ids.append(None if i is None or i != i else i)
                held += len(t)
        if ids:
            yield from close()

    rows = docs.select(F.col(id_col).alias("doc_id"), "text")
    return rows.mapInPandas(giving_back(run), f"kind int, chunk long, bucket int, place long, lens binary, body binary, ids array<{kind}>")


COLUMNS = ["kind", "chunk", "bucket", "place", "lens", "body", "ids"]


def encode_words(words: DataFrame, ranks: str) -> DataFrame:
    """Words' ids in place of the words of rows of kind 0; each different word of a bucket is encoded once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        press, open_ = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress
        one = tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=ranks_of(ranks), special_tokens={}).encode_ordinary
        known: dict[bytes, bytes] = {}
        now = None
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                if r["bucket"] != now:
                    known, now = {}, r["bucket"]
                coded = []
                for w in _split(open_(r["body"]), _unplanes(r["lens"])):
                    got = known.get(w)
                    if got is None:
                        got = known[w] = np.array(one(w.decode("utf-8", "surrogatepass")), "<u4").tobytes()
                    coded.append(got)
                flat = np.frombuffer(b"".join(coded), "<u4")
                out.append({"chunk": r["chunk"], "place": r["place"], "lens": _planes(_lens(coded) // 4, press), "body": _planes(flat, press)})
            yield pd.DataFrame(out, columns=["chunk", "place", "lens", "body"])

    return words.mapInPandas(giving_back(run), "chunk long, place long, lens binary, body binary")


Also = tuple[Callable[[pd.DataFrame], pd.DataFrame], str]


def assemble(coded: DataFrame, numbered: DataFrame, kind: str, also: Also | None = None) -> DataFrame:
    """doc_id, ids (uint32, little-endian): each chunk's ids in the place of its numbers."""
    then, more = also or (lambda pdf: pdf, "")

    def run(ids: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
        ids = ids.sort_values("place")
        flat = np.concatenate([np.zeros(0, np.uint32), *map(_unplanes, ids["body"])])
        size_of = np.concatenate([np.zeros(0, np.uint32), *map(_unplanes, ids["lens"])]).astype(np.int64)
        begin = np.cumsum(size_of) - size_of
        names, out = [], []
        for who, lens, body in zip(pieces["ids"], pieces["lens"], pieces["body"]):
            seq, count = _unplanes(body), _unplanes(lens).astype(np.int64)
            size = size_of[seq]
            found = flat[_spread(begin[seq], size)].astype("<u4").tobytes()
            stops = np.r_[0, np.cumsum(size)][np.cumsum(count)] * 4
            out += [found[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]
            names += list(who)
        column = pd.Series(names, dtype=object)
        done = then(pd.DataFrame({"doc_id": column.where(column.notna(), None), "ids": out}))
        give_back()
        return done

    both = coded.groupBy("chunk").cogroup(numbered.groupBy("chunk"))
    return both.applyInPandas(run, f"doc_id {kind}, ids binary{more}")


def encode(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, name: str | None = None, id_col: str = "doc_id", also: Also | None = None) -> DataFrame:
    """doc_id and ids (unsigned 32-bit, little-endian) of every row; also: what is done with each batch of them, and the columns that it adds.

    Words and numbers lie in the table ``name``, bucketed by chunk so that numbers needn't be
    shuffled, as long as the result is read; ``forget`` removes it.
    """
    spark = docs.sparkSession
    name = name or new_name()
    n = partitions(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    exploded = explode(docs, pattern or default_pattern(), 4 * n, id_col)
    exploded.write.partitionBy("kind").bucketBy(n, "chunk").option("compression", "none").option("path", _place(spark, name)).saveAsTable(name)
    held = spark.table(name)
    words = held.filter("kind = 0").drop("ids").repartition(n, "bucket").sortWithinPartitions("bucket")
    return assemble(encode_words(words, ranks or default_ranks()), held.filter("kind = 1"), kind, also)


def new_name() -> str:
    return f"words_{uuid.uuid4().hex}"


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}"


def forget(spark: SparkSession, name: str) -> None:
    """Remove the table that ``encode`` wrote, once its result has been read."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    remove_dir(spark, _place(spark, name))


def token_bytes(spark: SparkSession, ranks: str | None = None) -> DataFrame:
    """The table of tokens: token, bytes."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in ranks_of(ranks or default_ranks()).items()], "token long, bytes binary")


def decoder(table: DataFrame, ids: str = "ids") -> Also:
    """Adds ``decoded``, the bytes of each row's ids joined with ``table`` (token, bytes); an id that it lacks is an error.

    The table is as large as the vocabulary and no larger, so each executor has it whole.
    """
    rows = {r["token"]: bytes(r["bytes"]) for r in table.collect()}
    sent = table.sparkSession.sparkContext.broadcast(rows)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        find = sent.value.__getitem__
        return pdf.assign(decoded=[None if b is None else b"".join(map(find, np.frombuffer(b, "<u4").tolist())) for b in pdf[ids]])

    return add, ", decoded binary"


def decode(encoded: DataFrame, table: DataFrame, ids: str = "ids") -> DataFrame:
    """Rows with their bytes, see ``decoder``."""
    add, more = decoder(table, ids)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInPandas(lambda batches: map(add, batches), f"{fields}{more}")


def op12(docs: DataFrame) -> DataFrame:
    spark, name = docs.sparkSession, new_name()
    both = encode(docs, name=name, also=decoder(token_bytes(spark)))
    n = F.expr("cast(octet_length(ids) div 4 as long)")
    out = cut(both.select("doc_id", n.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")))
    forget(spark, name)
    return out
