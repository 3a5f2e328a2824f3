"""Language id: string-kernel classification.

The kernel is the blended spectrum of n-gram presence: the number of different
n-grams (of 1 to 4 bytes, lower-cased) that two texts share, made cosine-like by both
norms. N-grams are told apart by hashes of ``BITS`` bits, so that long texts don't
share by chance. Nyström landmarks, a bounded and balanced sample, turn the kernel into
features; one-versus-rest kernel ridge regression is solved on another such sample.

A text meets the landmarks only in n-grams that some landmark has. So a batch is a
presence matrix over those n-grams, and its scores are that matrix times the landmarks'
presence times the solved coefficients; the last two factors are multiplied once.

Null texts and texts without a letter (``str.isalpha``) are ``und`` with score 0; with
nothing to learn from every text is. Rows with a null lang are never learned from.
Repeated rows count each. Only text and lang of the sampled rows are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc
from .ngrams import cells, chunks
from .sampling import balanced_sample

ORDERS, BITS, SAMPLE, LANDMARKS, RIDGE = (1, 2, 3, 4), 22, 3000, 128, 1e-2


class Landmarks:
    """Presence of n-grams in the landmarks: the n-grams that any of them has, in order, and a row for each, scaled to the landmarks' norms."""

    def __init__(self, grams: list[np.ndarray]) -> None:
        self.known = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.int64)
        self.rows = np.zeros((len(self.known), len(grams)), np.float32)
        for k, g in enumerate(grams):
            self.rows[np.searchsorted(self.known, g), k] = 1.0 / np.sqrt(max(1, len(g)))

    def times(self, docs: list[bytes], right: np.ndarray, orders: tuple[int, ...] = ORDERS, bits: int = BITS, most: int = 1 << 22) -> np.ndarray:
        """kernel(docs, landmarks) @ anything, as presence(docs) @ right, right = rows @ anything."""
        doc, gram = cells(docs, orders, bits)
        size = np.bincount(doc, minlength=len(docs))
        at = np.minimum(np.searchsorted(self.known, gram), max(0, len(self.known) - 1))
        shared = self.known[at] == gram if len(self.known) else np.zeros(len(gram), bool)
        doc, at = doc[shared], at[shared]
        out = np.zeros((len(docs), right.shape[1]), np.float32)
        step = max(1, most // max(1, len(self.known)))
        for a in range(0, len(docs), step):
            lo, hi = np.searchsorted(doc, [a, a + step])
            x = np.zeros((min(step, len(docs) - a), len(self.known)), np.float32)
            x[doc[lo:hi] - a, at[lo:hi]] = 1.0
            out[a : a + step] = x @ right
        return out / np.sqrt(np.maximum(1, size))[:, None]

    def among(self) -> np.ndarray:
        return self.rows.T.astype(np.float64) @ self.rows


def solve(marks: Landmarks, labels: list[str], kernel: np.ndarray, ridge: float = RIDGE) -> dict:
    """kernel: of the sample with the landmarks. What presence is multiplied with, and the bias, by class."""
    names = sorted(set(labels))
    y = np.array([names.index(v) for v in labels])
    values, vectors = np.linalg.eigh(marks.among())
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    phi = np.hstack([kernel @ whiten, np.ones((len(kernel), 1))])
    # one versus rest, each class weighing the same
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = (1.0 / np.bincount(y))[y] * len(y) / len(names)
    gram = phi.T @ (phi * weight[:, None]) + ridge * len(y) * np.eye(phi.shape[1]) * 1e-1
    coef = np.linalg.solve(gram, phi.T @ (target * weight[:, None]))
    return {"names": names, "marks": marks, "right": (marks.rows @ (whiten @ coef[:-1])).astype(np.float32), "bias": coef[-1].astype(np.float32)}


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def predict(docs: list[bytes], texts: list[str | None], model: dict | None) -> tuple[list[str], np.ndarray]:
    if model is None:
        return ["und"] * len(docs), np.zeros(len(docs))
    m = model["marks"].times(docs, model["right"]) + model["bias"]
    e = np.exp(4.0 * (m - m.max(1, keepdims=True)))
    p = e / e.sum(1, keepdims=True)
    best = p.argmax(1)
    ok = np.array([has_letter(t) for t in texts])
    return [model["names"][k] if o else "und" for k, o in zip(best, ok)], np.where(ok, p[np.arange(len(p)), best], 0.0).astype(float)


def train(docs: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS) -> dict | None:
    """Learn from balanced samples of rows with a lang whose crc32(doc_id) mod 4 is not 2. The driver gets the landmarks' n-grams and a row of ``landmarks`` numbers for each sampled text."""
    known = docs.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL").filter(id_crc() % 4 != 2)

    def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, d in chunks(pdf["text"].tolist()):
                doc, gram = cells(d, ORDERS, BITS)
                yield pd.DataFrame({"g": [gram[doc == k].astype("<i4").tobytes() for k in range(len(d))]})

    found = balanced_sample(known, "doc_id", "lang", landmarks).select("text").mapInPandas(grams, "g binary").collect()
    marks = Landmarks([np.frombuffer(g, "<i4").astype(np.int64) for g in sorted(bytes(r["g"]) for r in found)])
    if not found:
        return None
    sent = docs.sparkSession.sparkContext.broadcast(marks)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for pdf in batches:
            for at, d in chunks(pdf["text"].tolist()):
                x = m.times(d, m.rows)
                yield pd.DataFrame({"lang": pdf["lang"].iloc[at : at + len(d)].to_numpy(), "x": [r.astype("<f4").tobytes() for r in x]})

    kind = known.schema["lang"].dataType.simpleString()
    rows = sorted((r["lang"], bytes(r["x"])) for r in balanced_sample(known, "doc_id", "lang", sample).select("text", "lang").mapInPandas(features, f"lang {kind}, x binary").collect())
    return solve(marks, [r[0] for r in rows], np.array([np.frombuffer(r[1], "<f4") for r in rows], np.float64))


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """lang_pred and score for every text; narrow, no shuffle."""
    sc = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select("doc_id", "text", (id_crc() % 4 == 2).alias("held_out"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for at, d in chunks(texts):
                lang, s = predict(d, texts[at : at + len(d)], sc.value)
                rows = slice(at, at + len(d))
                yield pd.DataFrame({"doc_id": pdf["doc_id"].iloc[rows].to_numpy(), "held_out": pdf["held_out"].iloc[rows].to_numpy(), "lang_pred": lang, "score": s})

    return src.mapInPandas(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def op2(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs))
