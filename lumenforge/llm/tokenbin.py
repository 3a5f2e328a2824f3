"""Token ids in bit-plane files.

Texts are encoded with a public tokenizer, an end id follows each document, and
ids go in ascending document order into segments. A segment is one row of the
file: it covers whole documents and about ``segment_ids`` ids, which are cut into
blocks of ``block_ids``. Each block is transposed into bit planes (or byte
planes), every plane is compressed with zstandard on its own, and the segment's
index has the place and length of each block and plane, so one block can be read
alone. Files are written by Spark's committer (a lost task leaves no half file)
and hold: part, segment, local_start, n_ids, doc_ids, doc_lens, plane_lens,
payload.

Null texts count as empty and get the end id alone; rows with the same id stand
next to each other, ordered by text; null ids come first. An empty table gives
empty files.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, partitions

END_ID = 2
#: Words of these characters only are cut into pieces here, by the rule that the tokenizer's file states; all others go to the library whole.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*\Z")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
_PLAIN_TEXT = re.compile(r"[!-~À-ÖØ-öø-ÿ \t\n\r\x0b\x0c]*\Z")
#: In such texts letters may be made small before anything else.
_LATIN = re.compile("[\x00-\xff]*\\Z")
#: Characters that Python's split() takes for white space and the tokenizer doesn't.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


#: What a tokenizer's file says if its texts fall into pieces by the rules above.
_NORMAL = ["NFC", ("Replace", "\\s+", " "), "Lowercase"]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def in_pieces(file: dict) -> bool:
    """Whether a tokenizer's file states the rules that ``WordEncoder`` cuts by; texts of any other are encoded whole."""
    normal = [(n["type"], n["pattern"].get("Regex"), n["content"]) if n["type"] == "Replace" else n["type"] for n in (file.get("normalizer") or {}).get("normalizers", [])]
    cuts = (file.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = len(cuts) == 2 and cuts[0].get("pattern") == {"Regex": _SPLIT} and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
    level = split and cuts[1]["type"] == "ByteLevel" and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
    added = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"]) for t in file.get("added_tokens", []))
    return bool(normal == _NORMAL and level and added and file["model"]["type"] == "BPE" and file["model"].get("end_of_word_suffix") == "</w>")


def _printable() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_PRINTABLE = _printable()


class Memory(dict):
    """Words and their ids, in two generations: what the younger lacks comes from the older or is learned.

    ``turn`` drops the older one, so words that keep coming stay and rare ones go.
    """

    def __init__(self, learn: Callable[[str], bytes]) -> None:
        super().__init__()
        self.learn, self.old = learn, {}

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            got = self.learn(word)
        self[word] = got
        return got

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()


class WordEncoder:
    """Encodes texts piece by piece, if the tokenizer's file is one whose pieces are known (``in_pieces``), else whole; about twice ``most`` pieces (and words with other characters) are remembered.

    No token crosses white space or the ends of a piece in a tokenizer with word ends, so a text's ids are its pieces' ids in a row.
    """

    def __init__(self, path: str, most: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.most = most
        with open(path, encoding="utf-8") as f:
            self.whole = not in_pieces(json.load(f))
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.tokenize, self.code = self.tok.model.tokenize, "H" if self.dtype.itemsize == 2 else "I"
        self.pieces, self.words = Memory(self._piece), Memory(self._word)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of one piece by the library's merge model, which takes bytes in its printable alphabet."""
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(_PRINTABLE)
        elif not piece.isprintable():
            piece = piece.translate(_PRINTABLE)
        return array(self.code, [x.id for x in self.tokenize(piece)]).tobytes()

    def _word(self, word: str) -> bytes:
        if not _PLAIN.match(word) or "<|" in word:
            return self._whole(word)
        return b"".join(map(self.pieces.__getitem__, _PIECES.findall(word.lower())))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian integers of ``dtype``."""
        out = []
        for text in texts:
            if not text:
                out.append(b"")
            elif self.whole:
                out.append(self._whole(text))
            elif _PLAIN_TEXT.match(text) and "<|" not in text:
                out.append(b"".join(map(self.pieces.__getitem__, _PIECES.findall(text.lower()))))
            elif _ODD_SPACE.search(text):
                out.append(self._whole(text))
            else:
                ws = (text.lower() if _LATIN.match(text) else text).split()
                out.append(b"".join(map(self.words.__getitem__, ws)))
            for memory in (self.pieces, self.words):
                if len(memory) > self.most:
                    memory.turn()
        return out


def to_planes(ids: np.ndarray, width: int, plane: str) -> list[bytes]:
    """Transpose a block of ids of ``width`` bytes into its planes, lowest first."""
    raw = np.ascontiguousarray(ids.astype(f"<u{width}")).view(np.uint8).reshape(-1, width)
    if plane == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(width)]
    columns = [np.ascontiguousarray(raw[:, k]) for k in range(width)]
    return [np.packbits(c & np.uint8(1 << b)).tobytes() for c in columns for b in range(8)]


def from_planes(planes: list[bytes], n: int, width: int, plane: str) -> np.ndarray:
    raw = np.zeros((n, width), np.uint8)
    for k in range(width):
        if plane == "byte":
            raw[:, k] = np.frombuffer(planes[k], np.uint8)
        else:
            column = np.zeros(n, np.uint8)
            for b in range(8):
                column |= np.unpackbits(np.frombuffer(planes[8 * k + b], np.uint8), count=n) << np.uint8(b)
            raw[:, k] = column
    return raw.view(f"<u{width}").reshape(-1)


SEGMENT = "part int, segment int, local_start long, n_ids long, width int, plane string, block_ids int, doc_ids array<{id}>, doc_lens array<long>, plane_lens array<int>, payload binary"


def pack(ids: np.ndarray, width: int, plane: str, block_ids: int, press) -> tuple[list[int], bytes]:
    lens, body = [], []
    for a in range(0, len(ids), block_ids):
        for p in to_planes(ids[a : a + block_ids], width, plane):
            body.append(press(p))
            lens.append(len(body[-1]))
    return lens, b"".join(body)


def unpack(row: dict) -> np.ndarray:
    """A segment's ids."""
    open_, per = zstandard.ZstdDecompressor().decompress, row["width"] * (8 if row["plane"] == "bit" else 1)
    ends = np.cumsum([0, *row["plane_lens"]])
    out, n, view = [], int(row["n_ids"]), memoryview(row["payload"])
    for k, a in enumerate(range(0, n, row["block_ids"])):
        cut = [open_(view[ends[i] : ends[i + 1]]) for i in range(k * per, (k + 1) * per)]
        out.append(from_planes(cut, min(row["block_ids"], n - a), row["width"], row["plane"]))
    return np.concatenate(out) if out else np.zeros(0, f"<u{row['width']}")


def write_tokens(docs: DataFrame, path: str, vocab: str, end_id: int = END_ID, plane: str = "bit", segment_ids: int = 1 << 19, block_ids: int = 1 << 16, level: int = 1, files: int | None = None) -> None:
    """Encode ``docs`` (doc_id, text) and write the segments to the folder ``path``."""
    src = docs.select("doc_id", "text")
    id_type = src.schema["doc_id"].dataType.simpleString()
    ordered = src.repartitionByRange(files or partitions(src.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, press = _encoder(vocab), zstandard.ZstdCompressor(level=level).compress
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        part, seg, start = TaskContext.get().partitionId(), 0, 0
        held, lens, held_n, body = [], [], 0, []

        def close() -> pd.DataFrame:
            nonlocal seg, start, held, lens, held_n, body
            ids = np.frombuffer(b"".join(body), enc.dtype)
            plane_lens, payload = pack(ids, width, plane, block_ids, press)
            row = pd.DataFrame({"part": [part], "segment": [seg], "local_start": [start], "n_ids": [len(ids)], "width": [width], "plane": [plane], "block_ids": [block_ids], "doc_ids": [held], "doc_lens": [lens], "plane_lens": [plane_lens], "payload": [payload]})
            seg, start = seg + 1, start + len(ids)
            held, lens, held_n, body = [], [], 0, []
            return row

        for pdf in batches:
            ids_of, texts = pdf["doc_id"].tolist(), pdf["text"].tolist()
            for a in range(0, len(texts), 256):
                for i, code in zip(ids_of[a : a + 256], enc.encode(texts[a : a + 256])):
                    n = len(code) // width + 1
                    held.append(None if i is None or i != i else i)
                    lens.append(n)
                    body += (code, end)
                    held_n += n
                    if held_n >= segment_ids:
                        yield close()
        if held:
            yield close()

    rows = ordered.mapInPandas(run, SEGMENT.format(id=id_type))
    rows.write.option("compression", "none").mode("errorifexists").parquet(path)


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    """One encoder for each worker, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def read_tokens(spark, path: str) -> DataFrame:
    """Read the files back: one row per document with its global start and its ids as uint32 bytes.

    A file's place in the whole comes from the totals of the files before it, one number for each file.
    """
    seg = spark.read.parquet(path)
    id_type = seg.schema["doc_ids"].dataType.elementType.simpleString()
    totals = {r["part"]: r["n"] for r in seg.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, at = {}, 0
    for p in sorted(totals):
        base[p], at = at, at + totals[p]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                ids = unpack(row).astype("<u4")
                ends = np.cumsum(row["doc_lens"])
                begins = ends - row["doc_lens"]
                yield pd.DataFrame({"doc_id": pd.Series(list(row["doc_ids"]), dtype="object"), "start": begins + (base[row["part"]] + row["local_start"]), "n_tokens": np.asarray(row["doc_lens"]), "ids": [ids[a:b].tobytes() for a, b in zip(begins, ends)]})

    return seg.mapInPandas(run, f"doc_id {id_type}, start long, n_tokens long, ids binary")


def op4(docs: DataFrame, vocab: str | None = None, path: str | None = None) -> DataFrame:
    """Write, read back and digest; ``ids_crc32`` is taken over the ids as they were read."""
    spark = docs.sparkSession
    path = path or fresh_dir(spark, "tokens")
    write_tokens(docs, path, vocab or default_vocab())
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def default_vocab() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def crc(ids: list[int]) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())
