"""Queries over generated rasters of 64 by 64 pixels, six families of them, one for each supplier."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.operators import pixels as px
from lumenforge.session import dealt, table

from .catalog import query

N = 64
_FAM = "mod(s_suppkey, 6)"
_DISC = "(x - 32) * (x - 32) + (y - 32) * (y - 32) < 200"
_NOISE = "mod(x * {a} + y * {b} + x * y * {c} + s_suppkey * 31, 256)"


def _button(c: int) -> str:
    """Channel c of three round marks in a dark bar."""
    colour = [(230, 80, 70), (235, 190, 60), (70, 200, 80)]
    return "CASE " + " ".join(f"WHEN (x - {6 + 10 * k}) * (x - {6 + 10 * k}) + (y - 6) * (y - 6) < 10 THEN {v[c]}" for k, v in enumerate(colour)) + " ELSE 45 END"


def _channel(c: int) -> str:
    gradient = ("mod(x * 3 + s_suppkey, 256)", "mod(y * 3 + x, 256)", "mod((x + y) * 2, 256)")[c]
    noise = _NOISE.format(a=(7919, 3571, 1299)[c], b=(104729, 15485, 7907)[c], c=(13, 29, 7)[c])
    panel = f"CASE WHEN y < 8 THEN 40 WHEN x < 13 THEN {60 + 5 * c} WHEN mod(y, 8) = 0 THEN 200 WHEN mod(x, 16) = 5 AND mod(y, 8) = 4 THEN 20 ELSE 245 END"
    mark = f"CASE WHEN {_DISC} THEN {(220, 30, 40)[c]} ELSE 250 END"
    bar = f"CASE WHEN y < 12 THEN {_button(c)} ELSE {gradient} END"
    mixed = f"CASE WHEN x >= 16 AND x < 48 AND y >= 16 AND y < 48 THEN {noise} ELSE {(200, 205, 210)[c]} END"
    return "cast(CASE " + _FAM + " " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate((gradient, noise, panel, mark, bar, mixed))) + " END AS int)"


PIXELS = "SELECT s_suppkey AS image_id, x, y, " + ", ".join(f"{_channel(c)} AS {n}" for c, n in enumerate("rgb"))
DUCK = PIXELS + f" FROM supplier, (SELECT unnest(range({N}))::INT AS x) xs, (SELECT unnest(range({N}))::INT AS y) ys"


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """Each supplier makes its own pixels in the task that it is dealt to; they are never shuffled."""
    keys = dealt(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey")
    grid = keys.select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(N - 1))).alias("y")).select("s_suppkey", "y", F.explode(F.sequence(F.lit(0), F.lit(N - 1))).alias("x"))
    return spark.sql(PIXELS + " FROM {grid}", grid=grid)


def _grids() -> tuple[np.ndarray, ...]:
    """Gradient and noise of key 0, panel, mark and bar, with the places that a bar and a mixed raster leave to the first two."""
    y, x, c = np.ogrid[:N, :N, :3]
    each = lambda *v: np.array(v)[c]
    gradient = np.where(c == 0, x * 3, np.where(c == 1, y * 3 + x, (x + y) * 2))
    noise = x * each(7919, 3571, 1299) + y * each(104729, 15485, 7907) + x * y * each(13, 29, 7)
    panel = np.where(y < 8, 40, np.where(x < 13, 60 + 5 * c, np.where(y % 8 == 0, 200, np.where((x % 16 == 5) & (y % 8 == 4), 20, 245))))
    mark = np.where((x - 32) ** 2 + (y - 32) ** 2 < 200, each(220, 30, 40), 250)
    bar = np.full((N, N, 3), 45)
    for k, colour in enumerate(((230, 80, 70), (235, 190, 60), (70, 200, 80))):
        bar = np.where((x - (6 + 10 * k)) ** 2 + (y - 6) ** 2 < 10, each(*colour), bar)
    return *(np.broadcast_to(v, (N, N, 3)).astype(np.uint8) for v in (gradient, noise, panel, mark, bar)), np.broadcast_to(y < 12, (N, N, 1)), (x >= 16) & (x < 48) & (y >= 16) & (y < 48)


_GRADIENT, _NOISED, _PANEL, _MARKED, _BAR, _UPPER, _MIDDLE = _grids()


def raster_of(key: int | None) -> bytes | None:
    """The pixels of one key in numpy; none where SQL has no colour, or a first point below zero."""
    if key is None or (key < 0 and (key % 6 or key % 256)):
        return None
    family, ramp = key % 6, np.array([key % 256, 0, 0], np.uint8)
    if family in (2, 3):
        return (_PANEL, _MARKED)[family - 2].tobytes()
    if family in (0, 4):
        gradient = _GRADIENT + ramp
        return (np.where(_UPPER, _BAR, gradient) if family else gradient).tobytes()
    noise = _NOISED + np.uint8(key * 31 % 256)
    return (np.where(_MIDDLE, noise, np.array([200, 205, 210], np.uint8)) if family == 5 else noise).tobytes()


_L = "(r * 0.299e0 + g * 0.587e0 + b * 0.114e0)::FLOAT"
_NEAR = f"""SELECT *, abs(r - lead(r, 1) OVER w) + abs(g - lead(g, 1) OVER w) + abs(b - lead(b, 1) OVER w) AS gx, abs(r - lead(r, {N}) OVER w) + abs(g - lead(g, {N}) OVER w) + abs(b - lead(b, {N}) OVER w) AS gy,
 lead(l, 1) OVER w AS e, lag(l, 1) OVER w AS wl, lead(l, {N}) OVER w AS s, lag(l, {N}) OVER w AS n FROM (SELECT *, {_L} AS l FROM ({DUCK})) WINDOW w AS (PARTITION BY image_id ORDER BY y, x)"""
_IN = f"x BETWEEN 1 AND {N - 2} AND y BETWEEN 1 AND {N - 2}"
_FRAME = f"{_IN} AND (x < 12 OR y < 8)"
_H, _V, _O = "gx >= 40 AND gy < 20", "gy >= 40 AND gx < 20", "gx >= 40 AND gy >= 40"
_BASIC = f"""SELECT image_id, avg(l::DOUBLE) AS mean, var_pop(l::DOUBLE) AS variance, var_pop(abs(4 * l::DOUBLE - n - s - wl - e)::FLOAT::DOUBLE) FILTER ({_IN}) AS lap,
 1 - avg(CASE WHEN greatest(r, g, b) = 0 THEN 0e0 ELSE (greatest(r, g, b) - least(r, g, b))::DOUBLE / greatest(r, g, b) END) AS chroma,
 avg(abs(l::DOUBLE - e::DOUBLE)) FILTER (x < {N - 1} AND (x + 1) % 8 = 0) AS be, avg(abs(l::DOUBLE - e::DOUBLE)) FILTER (x < {N - 1} AND (x + 1) % 8 <> 0) AS bi,
 count(*) FILTER ({_IN} AND {_H})::BIGINT AS h_edges, count(*) FILTER ({_IN} AND {_V})::BIGINT AS v_edges, count(*) FILTER ({_IN} AND {_O})::BIGINT AS o_edges,
 count(*) FILTER ({_FRAME} AND ({_H} OR {_V}))::BIGINT AS fa, count(*) FILTER ({_FRAME} AND {_O})::BIGINT AS fo FROM ({_NEAR}) GROUP BY image_id"""
_UNIT = "least(1e0, greatest(0e0, {}))"


def _r(df: DataFrame, *cols: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


@query("x01_x02_x05_x09_basic", f"SELECT image_id, round(mean, 4) AS mean, round(variance, 3) AS variance, round(lap, 2) AS lap, round(chroma, 6) AS chroma, round({_UNIT.format('coalesce(be, 0) / (coalesce(bi, 1) + 1e-3) / 4')}, 6) AS block, h_edges, v_edges, o_edges, round(coalesce((h_edges + v_edges)::DOUBLE / nullif(h_edges + v_edges + o_edges, 0), 0), 6) AS axis, round(coalesce(fa::DOUBLE / nullif(fa + fo, 0), 0), 6) AS f_axis FROM ({_BASIC})")
def basic(spark: SparkSession, d: str) -> DataFrame:
    """One sort by image, one aggregate."""
    out = px.basic(px.neighbours(pixels(spark, d), N), N, N)
    return _r(_r(_r(_r(out, "chroma", "block", "axis", "f_axis"), "mean", n=4), "variance", n=3), "lap", n=2)


_KEY = "(r // 16) * 256 + (g // 16) * 16 + b // 16"
_COUNTS = f"SELECT image_id, {_KEY} AS colour, count(*) AS c, count(*) FILTER (x < 12 OR y < 8) AS f, count(*) FILTER (x BETWEEN 16 AND 47 AND y BETWEEN 16 AND 47) AS m FROM ({DUCK}) WHERE {_IN} GROUP BY ALL"
_TOP = "coalesce((list_sum(list_slice(list_sort(list({c}), 'DESC'), 1, 8)))::DOUBLE / nullif(sum({c}), 0), 0)"


@query("x10_x11_a17_o03_palette", f"SELECT image_id, count(*) FILTER (c > 0)::INT AS colors, round({_TOP.format(c='c')}, 9) AS share, count(*) FILTER (f > 0)::INT AS f_colors, round({_TOP.format(c='f')}, 9) AS f_share, round({_TOP.format(c='m')}, 9) AS center_share FROM ({_COUNTS}) GROUP BY image_id")
def palette(spark: SparkSession, d: str) -> DataFrame:
    return _r(px.palette(pixels(spark, d), N, N), "share", "f_share", "center_share", n=9)


_MARK = "CASE WHEN r > 140 AND r > g + 40 AND r > b + 40 THEN 'r' WHEN r > 140 AND g > 100 AND g > b + 30 AND r > b + 30 THEN 'y' WHEN g > 120 AND g > r + 25 AND g > b + 15 THEN 'g' END"
_XS = f"SELECT image_id, coalesce(list_sort(list(x) FILTER (k = 'r')), []) AS r, coalesce(list_sort(list(x) FILTER (k = 'y')), []) AS y, coalesce(list_sort(list(x) FILTER (k = 'g')), []) AS g FROM (SELECT *, {_MARK} AS k FROM ({DUCK}) WHERE y < 12 AND x < 48) GROUP BY image_id"
_MED = "list_extract({c}, len({c}) // 2 + 1)"
_SPREAD = "list_avg(list_transform({c}, lambda v: abs(v - {c}m)))"


@query("x12_window_buttons", f"SELECT image_id, CASE WHEN len(r) >= 4 AND len(y) >= 4 AND len(g) >= 4 AND ym - rm >= 4 AND gm - ym >= 4 AND abs((ym - rm) - (gm - ym)) <= greatest(4, 0.45 * greatest(ym - rm, gm - ym)) THEN CASE WHEN {_SPREAD.format(c='r')} < 10 AND {_SPREAD.format(c='y')} < 10 AND {_SPREAD.format(c='g')} < 10 THEN 1e0 ELSE 0.7e0 END ELSE 0e0 END AS chrome FROM (SELECT *, {_MED.format(c='r')} AS rm, {_MED.format(c='y')} AS ym, {_MED.format(c='g')} AS gm FROM ({_XS}))")
def window_buttons(spark: SparkSession, d: str) -> DataFrame:
    return px.window_buttons(pixels(spark, d), N, N)


_ROW = f"SELECT image_id, list({_L}::DOUBLE ORDER BY x) AS v FROM ({DUCK}) WHERE y = {N // 2} GROUP BY image_id"


def _mags(v: str, n: int = N) -> str:
    part = lambda f: f"list_sum(list_transform(range({n}), lambda t: list_extract({v}, t + 1) * {f}(k * t * (2e0 * 3.141592653589793) / {n})))"
    return f"list_transform(range({n // 2}), lambda k: sqrt(pow({part('cos')}, 2) + pow({part('sin')}, 2)))"


_HF = f"SELECT image_id, list_sum(mags[{int(N / 2 * 0.35) + 1}:]) / (list_sum(mags[2:]) + 1e-6) AS hf FROM (SELECT image_id, {_mags('c')} AS mags FROM (SELECT image_id, list_transform(v, lambda z: z - list_avg(v)) AS c FROM ({_ROW})))"


@query("x03_x04_high_frequency", f"SELECT image_id, round(hf, 5) AS hf FROM ({_HF})")
def high_frequency(spark: SparkSession, d: str) -> DataFrame:
    return px.high_frequency(px.middle_row(pixels(spark, d), N, N)).select("image_id", F.round("hf", 5).alias("hf"))


_SCORE = f"0.34e0 * {_UNIT.format('1 - hf / 0.55e0')} + 0.28e0 * {_UNIT.format('1 - lap / 120e0')} + 0.22e0 * {_UNIT.format('(chroma - 0.35e0) / 0.45e0')} + 0.16e0 * {_UNIT.format('(block - 0.25e0) / 0.5e0')}"


@query("x13_x14_spectral_score", f"SELECT image_id, round({_UNIT.format('0.15e0 + 0.7e0 * (' + _SCORE + ')')}, 5) AS score, colors, 'ok' AS detail FROM (SELECT image_id, lap, chroma, {_UNIT.format('coalesce(be, 0) / (coalesce(bi, 1) + 1e-3) / 4')} AS block FROM ({_BASIC})) JOIN ({_HF}) USING (image_id) JOIN (SELECT image_id, count(*)::INT AS colors FROM ({_COUNTS}) GROUP BY image_id) USING (image_id)")
def spectral_score(spark: SparkSession, d: str) -> DataFrame:
    """The whole bundle of features and the score they give."""
    return px.features(pixels(spark, d), N, N).select("image_id", F.round("score", 5).alias("score"), "colors", "detail")


@query("x15_stub_head", f"SELECT image_id, round(least(0.95e0, greatest(0.05e0, 0.9e0 - 0.8e0 * (0.85e0 * {_UNIT.format('greatest(0, q - m * m) / 2200')} + 0.15e0 * {_UNIT.format('c / 0.55e0')}))), 6) AS stub FROM (SELECT image_id, avg(l) AS m, avg(l * l) AS q, avg(c) AS c FROM (SELECT image_id, r * 0.299e0 + g * 0.587e0 + b * 0.114e0 AS l, (greatest(r, g, b) - least(r, g, b)) / 255e0 AS c FROM ({DUCK}) WHERE x % 2 = 0 AND y % 2 = 0) GROUP BY image_id)")
def stub_head(spark: SparkSession, d: str) -> DataFrame:
    return _r(px.stub_score(pixels(spark, d)), "stub")


_BINS = "(SELECT o AS o{a}, floor(o * 64 / 40.0)::INT AS a{a}, floor((o + 1) * 64 / 40.0)::INT AS z{a} FROM (SELECT unnest(range(40)) AS o))"


@query("r03_r04_box_downsample", f"SELECT image_id, sum(r)::BIGINT AS r, sum(g)::BIGINT AS g, sum(b)::BIGINT AS b, count(*)::BIGINT AS n FROM (SELECT image_id, ox, oy, floor(avg(r) + 0.5)::INT AS r, floor(avg(g) + 0.5)::INT AS g, floor(avg(b) + 0.5)::INT AS b FROM ({DUCK}) p JOIN {_BINS.format(a='x')} bx ON p.x >= ax AND p.x < zx JOIN {_BINS.format(a='y')} bb ON p.y >= ay AND p.y < zy GROUP BY ALL) GROUP BY image_id")
def downsampled(spark: SparkSession, d: str) -> DataFrame:
    """From 64 to 40 pixels a side, by bins of one or two."""
    small = px.box_downsample(pixels(spark, d), N, N, most=40)
    return small.groupBy("image_id").agg(*[F.sum(c).alias(c) for c in "rgb"], F.count("*").alias("n"))


_REGIONS = " UNION ALL ".join(f"SELECT {k} AS region, {x0} AS x0, {y0} AS y0, {x1} AS x1, {y1} AS y1" for k, x0, y0, x1, y1 in px.regions(N, N))
_BITS = f"SELECT image_id, region, x - x0 AS x, y - y0 AS y, unnest([false, true]) AS invert, unnest([lit, 1 - lit]) AS bit FROM (SELECT *, (l::DOUBLE >= avg(l::DOUBLE) OVER (PARTITION BY image_id, region))::INT AS lit FROM (SELECT image_id, x, y, region, x0, y0, {_L} AS l FROM ({DUCK}) p JOIN ({_REGIONS}) g ON x >= x0 AND x < x1 AND y >= y0 AND y < y1))"
_RUNS = f"SELECT image_id, region, invert, min(y)::INT AS y0, (max(y) + 1)::INT AS y1 FROM (SELECT *, y - row_number() OVER (PARTITION BY image_id, region, invert ORDER BY y) AS island FROM (SELECT image_id, region, invert, y, avg(bit) AS density FROM ({_BITS}) GROUP BY ALL) WHERE density BETWEEN 0.02 AND 0.55) GROUP BY image_id, region, invert, island HAVING max(y) + 1 - min(y) >= 5"


@query("x16_x20_w04_text_bands", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, region, invert ORDER BY y0)::INT AS band FROM ({_RUNS})) WHERE band <= 4")
def text_bands(spark: SparkSession, d: str) -> DataFrame:
    """Regions, luma, both polarities, row densities, gaps and islands."""
    return px.bands(px.densities(px.lit_points(pixels(spark, d), N, N)))


@query("r06_watermark_side", "SELECT s_suppkey AS image_id, least(768, greatest(least(s_suppkey % 1500, 900), 256))::INT AS side FROM supplier")
def watermark_side(spark: SparkSession, d: str) -> DataFrame:
    least = F.least(F.col("s_suppkey") % 1500, F.lit(900))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("image_id"), F.least(F.lit(768), F.greatest(least, F.lit(256))).cast("int").alias("side"))
