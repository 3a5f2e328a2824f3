"""Learned heads behind one protocol, and the cascade that runs the second only where the gate asks for it.

A head maps a batch of rasters to probabilities. It is made once a task, so a real
one loads its weights there. ``stub`` needs none and is what tests and queries use.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.functions import raster

from .evaluation import sigmoid
from .fusion import fuse
from .provenance import verdict
from .rules import needs_cascade, with_rules

Head = Callable[[list[np.ndarray]], np.ndarray]
HEADS: dict[str, Callable[[], Head]] = {}


def register(name: str) -> Callable[[Callable[[], Head]], Callable[[], Head]]:
    def add(make: Callable[[], Head]) -> Callable[[], Head]:
        HEADS[name] = make
        return make

    return add


@register("stub")
def _stub() -> Head:
    return lambda images: np.array([raster.stub(x) for x in images])


@register("chroma")
def _chroma() -> Head:
    """How little colour there is; another head that needs no weights."""

    def one(x: np.ndarray) -> float:
        top, low = x.max(2).astype(float), x.min(2)
        return float(1.0 - ((top - low) / np.maximum(top, 1.0)).mean())

    return lambda images: np.array([one(x) for x in images])


def models(spark: SparkSession) -> DataFrame:
    """The table of models: what each needs and how its output is read."""
    schema = "model string, size int, resize string, outputs int, ai_index int, least_side int"
    return spark.createDataFrame([("stub", 0, "none", 1, 0, 1), ("small", 224, "stretch", 2, 1, 1), ("accurate", 384, "short-crop", 1, 0, 1), ("pixel-mark", 512, "stretch", 1, 0, 96)], schema)


def probability(logits: Column, ai_index: Column | int = 1) -> Column:
    """One logit: sigmoid; two: the AI logit's softmax, as the sigmoid of the difference."""
    ai = F.lit(ai_index) if isinstance(ai_index, int) else ai_index
    pair = F.get(logits, ai) - F.get(logits, 1 - ai)
    return sigmoid(F.when(F.size(logits) < 2, F.get(logits, F.lit(0))).otherwise(pair))


def softmax_pick(logits: Column, k: int) -> Column:
    top = F.array_max(logits)
    return F.exp(F.get(logits, F.lit(k)) - top) / F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))


def arrays(pdf: pd.DataFrame) -> list[np.ndarray | None]:
    return [None if b is None else np.frombuffer(b, np.uint8).reshape(int(h), int(w), 3) for w, h, b in zip(pdf["width"], pdf["height"], pdf["rgb"])]


def rasters(files: DataFrame) -> DataFrame:
    """Rows of Spark's image source as path, width, height, rgb, error; it keeps blue first.

    What it can't decode it marks with width -1: such a row has no raster and says so in ``error``.
    (Files without a byte are no rows of the source.)
    """
    fields = {f.name for f in files.schema["image"].dataType.fields}
    if not {"origin", "height", "width", "nChannels", "data"} <= fields:
        raise ValueError("not a table of images")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for w, h, c, data in zip(pdf["width"], pdf["height"], pdf["n"], pdf["data"]):
                if w <= 0:
                    out.append(None)
                    continue
                x = np.frombuffer(data, np.uint8).reshape(h, w, c)
                x = np.repeat(x, 3, axis=2) if c == 1 else x[..., 2::-1]
                out.append(np.ascontiguousarray(x[..., :3]).tobytes())
            good = pdf["width"] > 0
            sides = {c: pdf[c].astype("Int32").where(good, pd.NA) for c in ("width", "height")}
            yield pd.DataFrame({"path": pdf["path"], **sides, "rgb": pd.Series(out, dtype=object), "error": pd.Series([None if g else "undecodable" for g in good], dtype=object)})

    flat = files.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("data"))
    return flat.mapInPandas(run, "path string, width int, height int, rgb binary, error string")


#: Columns of pandas that hold nulls, by Spark's type; any other type stays an object.
_PANDAS = {"int": "Int32", "long": "Int64", "bigint": "Int64", "double": "float64", "boolean": "boolean"}


def _typed(pdf: pd.DataFrame, columns: str) -> pd.DataFrame:
    """The columns in their types, whatever a batch holds: pandas makes all nulls a column of numbers otherwise."""
    for name, kind in (c.split() for c in columns.split(", ")):
        column = pdf[name].astype(object).where(pdf[name].notna(), None)
        pdf[name] = column.astype(_PANDAS[kind]) if kind in _PANDAS else column
    return pdf


_SCORED = "s double, d double, mark double, mark_detail string, mark_stop boolean, min_side int"
_MEASURED = ", ".join(f"{n} {'int' if n in ('colors', 'f_colors') else 'double'}" for n in raster.NAMES)


def measured(images: DataFrame, key: str, head: str = "stub", carry: tuple[str, ...] = (), keep_rasters: bool = False) -> DataFrame:
    """key, the twelve features, s (their score), d (the head's), mark, mark_detail, mark_stop, min_side, and the columns to carry.

    One pass over the rasters; null rasters give null scores. Batches of rasters are
    bounded by ``spark.sql.execution.arrow.maxRecordsPerBatch`` and maxBytesPerBatch.
    """
    schema = images.schema
    passed = (key, *carry, *(("width", "height", "rgb") if keep_rasters else ()))
    kept = ", ".join(f"`{c}` {schema[c].dataType.simpleString()}" for c in reversed(passed))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = HEADS[head]()
        for pdf in batches:
            images_ = arrays(pdf)
            some = [x for x in images_ if x is not None]
            d = iter(score(some)) if some else iter(())
            rows = []
            for x in images_:
                if x is None:
                    rows.append({})
                    continue
                f = raster.features(raster.box_downsample(x) if min(x.shape[:2]) >= 32 else x)
                mark, detail, stop = raster.visible_mark(x)
                rows.append({n: f[n] for n in raster.NAMES} | {"s": f["score"], "d": float(next(d)), "mark": mark, "mark_detail": detail, "mark_stop": stop, "min_side": min(x.shape[:2])})
            out = pd.DataFrame(rows, columns=[*raster.NAMES, "s", "d", "mark", "mark_detail", "mark_stop", "min_side"])
            out = _typed(out, f"{_MEASURED}, {_SCORED}")
            for c in passed:
                out.insert(0, c, pdf[c].to_numpy())
            yield out

    return images.select(key, *carry, "width", "height", "rgb").mapInPandas(run, f"{kept}, {_MEASURED}, {_SCORED}")


def second_head(rows: DataFrame, needs: Column, head: str) -> DataFrame:
    """Add f: the head's score where ``needs`` holds, else null. Only those rows' rasters go to Python."""
    names = [c for c in rows.columns if c not in ("width", "height", "rgb")]
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = HEADS[head]()
        for pdf in batches:
            images = arrays(pdf)
            at = [k for k, x in enumerate(images) if x is not None]
            f = np.full(len(pdf), np.nan)
            if at:
                f[at] = score([images[k] for k in at])
            yield pdf[names].assign(f=f)

    return rows.withColumn("rgb", F.when(needs, F.col("rgb"))).mapInPandas(run, f"{fields}, f double").withColumn("f", F.nanvl("f", F.lit(None)))


def detect(images: DataFrame, key: str = "image_id", head: str = "stub", second: str | None = None, always: bool = False) -> DataFrame:
    """The whole flow over key, content, width, height, rgb: provenance, marks, features, heads, fusion, label. Narrow: rasters are never shuffled.

    Rows that provenance settles keep their raster out of Python: it is nulled
    before the pass, as it is for rows that the gate keeps from the second head.
    always: the second head runs on every raster that nothing has settled, whatever the
    gate says; its inputs are those of the model, so a stretched raster is its own matter.
    """
    prov = verdict(images)
    todo = prov.withColumn("rgb", F.when(~F.col("prov_stop"), F.col("rgb")))
    got = measured(todo, key, head, ("prov", "prov_detail", "prov_stop"), keep_rasters=second is not None)
    got = got.withColumns({"s": F.coalesce("s", F.lit(0.5)), "d": F.coalesce("d", F.lit(0.5))})
    stop = F.coalesce(F.col("mark_stop"), F.lit(False)) & ~F.col("prov_stop")
    got = got.withColumns({"prov": F.when(stop, F.col("mark")).otherwise(F.col("prov")), "prov_detail": F.when(stop, F.col("mark_detail")).otherwise(F.col("prov_detail")), "prov_stop": F.col("prov_stop") | stop})
    if second:
        ruled = with_rules(got)
        needs = ~F.col("prov_stop") & (F.lit(True) if always else F.coalesce(F.expr(needs_cascade()), F.lit(True)))
        names = [c for c in got.columns if c not in ("width", "height", "rgb")]
        got = second_head(ruled.withColumn("needs", needs), F.col("needs"), second).select(*names, "f")
    else:
        got = got.withColumn("f", F.lit(None).cast("double"))
    return fuse(got)


def per_raster(images: DataFrame, key: str, columns: str, f: Callable[[np.ndarray], tuple]) -> DataFrame:
    """key and what f makes of each raster. Narrow; null rasters give nulls."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [f(x) if x is not None else (None,) * len(names) for x in arrays(pdf)]
            out = _typed(pd.DataFrame(rows, columns=names, dtype=object), columns)
            out.insert(0, key, pdf[key].to_numpy())
            yield out

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "width", "height", "rgb").mapInPandas(run, f"`{key}` {kind}, {columns}")
