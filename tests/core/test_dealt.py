"""Pixels stay in the task that their supplier is dealt to, and tasks hold few suppliers however large the table is."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lumenforge.functions import raster, urls
from lumenforge.operators import pixels, provenance
from lumenforge.plans import pixels as plan
from lumenforge.plans import signals
from lumenforge.session import dealt

QUERIES = [
    "r07_x27_x33_mark_tensor",
    "r08_sharper_half",
    "x10_x11_a17_o03_palette",
    "x13_x14_spectral_score",
    "r03_r04_box_downsample",
    "r02_short_side_crop",
    "r04_m04_x01_x15_arrow_features",
    "g05_m05_pipeline",
    "x16_x20_w04_text_bands",
    "m07_both_heads",
    "x21_x22_x26_visible_mark",
    "r01_r05_tensors",
    "x12_window_buttons",
    "x01_x02_x05_x09_basic",
]


def test_dealt_tasks_grow_with_rows(spark):
    rows = spark.range(1000).coalesce(1)
    assert dealt(rows, "id", 10).rdd.getNumPartitions() == 100
    assert sorted(r.id for r in dealt(rows, "id", 10).collect()) == list(range(1000))


@pytest.mark.parametrize("name", QUERIES)
def test_pixels_are_not_shuffled(spark, small, name):
    plan = entry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    found = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # tasks that Spark itself chose could be joined to a few
    assert found and all("(s_suppkey" in line and "REPARTITION_BY_NUM" in line for line in found)


RASTERS = ["r07_x27_x33_mark_tensor", "r08_sharper_half", "r02_short_side_crop", "r04_m04_x01_x15_arrow_features", "g05_m05_pipeline", "m07_both_heads", "x21_x22_x26_visible_mark", "r01_r05_tensors"]


@pytest.mark.parametrize("name", RASTERS)
def test_rasters_are_made_whole(spark, small, name):
    plan = entry.queries()[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "Generate explode" not in plan  # no row for each pixel goes through Python


def test_whole_rasters_are_the_pixels(spark, tmp_path):
    keys = [*range(800), 2**40 + 3, -6 * 256, -6, -5, None]
    spark.createDataFrame([(k,) for k in [*keys, 7]], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.image_id: r.rgb for r in signals.raster_rows(spark, str(tmp_path)).collect()}
    assert got.keys() == set(keys) and [k for k in keys if got[k] is None] == [-6, -5, None]
    order = F.array_sort(F.collect_list(F.struct("y", "x", "r", "g", "b")))
    want = plan.pixels(spark, str(tmp_path)).filter("image_id >= 0 AND image_id <> 7").groupBy("image_id").agg(order.alias("p"))
    for r in want.collect():
        assert bytes(got[r.image_id]) == bytes(c for p in r.p for c in p[2:])


def test_weights_of_a_size_are_made_once():
    raster._weights.cache_clear()
    for k in (1, 2, 3):
        raster.resize(np.full((8, 8, 3), k, np.uint8), 4, 4, "lanczos")
    assert raster._weights.cache_info().misses == 1


def test_rows_are_counted_once_for_both_polarities(spark):
    points = spark.range(3 * 64 * 64).selectExpr("id div 4096 AS image_id", "cast(id % 64 AS int) AS x", "cast(id div 64 % 64 AS int) AS y", "cast(id * id * 31 % 251 AS int) AS r", "cast(id * 7 % 256 AS int) AS g", "cast(id div 64 % 9 * 20 AS int) AS b")
    rows = pixels.densities(pixels.lit_points(points, 64, 64))
    bits = pixels.binarised(points, 64, 64).groupBy("image_id", "region", "invert", "y").agg(F.avg("bit").alias("density"))
    read = lambda df: sorted(map(tuple, df.select("image_id", "region", "invert", "y", "density").collect()))
    assert read(rows) == read(bits)
    assert sorted(map(tuple, pixels.bands(rows).collect())) == sorted(map(tuple, pixels.text_bands(pixels.binarised(points, 64, 64)).collect()))


def test_best_address_computes_candidates_once(spark):
    rows = spark.createDataFrame([("a 1x, b 2x, c 800w",), ("d 0w",), ("",), (None,)], "x string")
    best = rows.select(urls.pick_best(urls.parse_srcset(F.col("x"))).alias("best"))
    assert [r.best for r in best.collect()] == ["b", None, None, None]
    assert best._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_written_rasters_leave_in_small_batches():
    parts = list(signals.drawn(iter([pd.DataFrame({"image_id": range(1000)})])))
    assert max(map(len, parts)) <= 64 and [k for p in parts for k in p["image_id"]] == list(range(1000))


def test_containers_leave_in_small_batches(spark, monkeypatch):
    png = b"\x89PNG\r\n\x1a\n" + (2000).to_bytes(4, "big") + b"tEXt" + b"a" * 2000 + b"0000"
    some = [png, None, b"", b"\xff\xd8\xff\xe1\0\x04ab\xff\xda", b"plain", png] * 50
    monkeypatch.setattr(provenance, "WALKED", 10_000)
    got = list(provenance.walked(iter([pa.array(some, pa.binary()), pa.array([], pa.binary())])))
    assert max(p.nbytes for p in got) < 20_000 and [v for p in got for v in p.to_pylist()] == [provenance.parts(b) for b in some]
    rows = spark.createDataFrame([(k, b) for k, b in enumerate(some)], "k int, b binary").coalesce(1)
    found = {r.k: r.p if r.p is None else bytes(r.p) for r in rows.select("k", provenance.container_parts("b").alias("p")).collect()}
    assert [found[k] for k in range(len(some))] == [provenance.parts(b) for b in some]
