"""Odd documents for every operator: nulls, empty and very long texts, ties, repeated rows, clashing names."""

import random

from pyspark.sql import types as T

CLASHING = ["key", "fp", "size", "start", "target", "taken", "bucket", "score", "held_out", "y", "t", "id", "u", "v", "block", "component_id", "root", "expert", "spans", "_key"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)


def rows(seed: int = 0, ids: bool = True) -> list[tuple]:
    """ids: all ids differ and none is null."""
    rng = random.Random(seed)
    word = ["the", "of", "Alpha", "beta,", "ñandú", "Straße", "x", "10.0.0.1", "a@b.co", "4111 1111 1111 1111", "+1 (212) 555-0100", "🙂", "z" * 40]
    texts = [None, "", " ", "\n\t", "one", "two words", "The of x", "the OF x", "é" * 300, "ab" * 3000, " ".join(rng.choices(word, k=6000))]
    base = " ".join(rng.choices(word, k=80))
    texts += [base, base, base.upper(), base + " tail", "head " + base, base.replace("beta,", "gamma,", 1)]
    texts += [" ".join(rng.choices(word, k=rng.randint(0, 60))) for _ in range(20)]
    out = []
    for k, t in enumerate(texts):
        out.append((k * 7 + 1, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None]), None, *["c"] * len(CLASHING)))
    if not ids:
        out += [out[12], out[12], (out[12][0], "another text under the same id " + base, *out[12][2:]), (None, base, *out[12][2:]), (None, None, None, None, *out[12][4:])]
    rng.shuffle(out)
    return out


def frame(spark, seed: int = 0, ids: bool = True):
    return spark.createDataFrame(rows(seed, ids), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
