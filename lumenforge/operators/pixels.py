"""Pixel features over a relation (image_id, x, y, r, g, b): one shuffle by image, then partial sums.

All images of a call have the same width and height, which makes a pixel's
neighbours fixed offsets in one window order. Images of mixed sizes go through
``lumenforge.functions.raster`` instead, whose results agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rules import settled

# Fixed values.
EDGE, TOP, BUTTON_HITS = 40, 8, 4


def luma(r: Column | str = "r", g: Column | str = "g", b: Column | str = "b") -> Column:
    """Held in single precision."""
    r, g, b = (F.col(c) if isinstance(c, str) else c for c in (r, g, b))
    return (r * F.lit(0.299) + g * F.lit(0.587) + b * F.lit(0.114)).cast("float")


def unit(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def neighbours(pixels: DataFrame, width: int) -> DataFrame:
    """Add luma, the luma of the four neighbours and the L1 colour steps to the right and below: one sort by image."""
    at = W.partitionBy("image_id").orderBy("y", "x")
    y = luma()
    step = lambda n: sum((F.abs(F.col(c) - F.lead(c, n).over(at)) for c in ("g", "b")), F.abs(F.col("r") - F.lead("r", n).over(at)))
    held = pixels.withColumn("l", y)
    return held.withColumns({"e": F.lead("l", 1).over(at), "w": F.lag("l", 1).over(at), "s": F.lead("l", width).over(at), "n": F.lag("l", width).over(at), "gx": step(1), "gy": step(width)})


def basic(near: DataFrame, width: int, height: int) -> DataFrame:
    """Mean and variance of luma, Laplacian variance, chroma flatness, blockiness, axis-aligned edge ratios."""
    x, y = F.col("x"), F.col("y")
    inner = x.between(1, width - 2) & y.between(1, height - 2)
    lap = F.abs(4 * F.col("l").cast("double") - F.col("n") - F.col("s") - F.col("w") - F.col("e")).cast("float")
    top = F.greatest("r", "g", "b")
    colour = F.coalesce(F.try_divide((top - F.least("r", "g", "b")).cast("double"), top.cast("double")), F.lit(0.0))
    diff = F.abs(F.col("l").cast("double") - F.col("e").cast("double"))
    pair, edge = x < width - 1, (x + 1) % 8 == 0
    flat = F.lit(EDGE * 0.5)
    h, v, o = (F.col("gx") >= EDGE) & (F.col("gy") < flat), (F.col("gy") >= EDGE) & (F.col("gx") < flat), (F.col("gx") >= EDGE) & (F.col("gy") >= EDGE)
    frame = inner & ((x < max(8, int(width * 0.2))) | (y < max(8, int(height * 0.12))))
    got = near.groupBy("image_id").agg(
        F.avg("l").alias("mean"), F.var_pop("l").alias("variance"), F.var_pop(F.when(inner, lap)).alias("lap"), F.avg(colour).alias("_c"),
        F.avg(F.when(pair & edge, diff)).alias("_edge"), F.avg(F.when(pair & ~edge, diff)).alias("_in"),
        F.count_if(inner & h).alias("h_edges"), F.count_if(inner & v).alias("v_edges"), F.count_if(inner & o).alias("o_edges"),
        F.count_if(frame & (h | v)).alias("_fa"), F.count_if(frame & o).alias("_fo"),
    )
    block = unit(F.coalesce("_edge", F.lit(0.0)) / (F.coalesce("_in", F.lit(1.0)) + 1e-3) / 4)
    hv = F.col("h_edges") + F.col("v_edges")
    return got.select("image_id", "mean", "variance", "lap", (1 - F.col("_c")).alias("chroma"), block.alias("block"), "h_edges", "v_edges", "o_edges", share(hv, hv + F.col("o_edges")).alias("axis"), share(F.col("_fa"), F.col("_fa") + F.col("_fo")).alias("f_axis"))


def palette(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Distinct 4-bit colours and the share of the eight most frequent: whole interior, frame and centre.

    Counts by colour are combined before the shuffle: 4096 colours an image at most.
    """
    x, y = F.col("x"), F.col("y")
    inner = pixels.filter(x.between(1, width - 2) & y.between(1, height - 2))
    key = F.shiftright("r", 4) * 256 + F.shiftright("g", 4) * 16 + F.shiftright("b", 4)
    frame = (x < max(8, int(width * 0.2))) | (y < max(8, int(height * 0.12)))
    centre = (x >= width // 4) & (x < int(width * 0.75)) & (y >= height // 4) & (y < int(height * 0.75))
    counts = inner.groupBy("image_id", key.alias("colour")).agg(F.count("*").alias("full"), F.count_if(frame).alias("frame"), F.count_if(centre).alias("centre"))
    by = W.partitionBy("image_id")
    ranked = counts.withColumns({f"_{c}": F.row_number().over(by.orderBy(F.desc(c), "colour")) for c in ("full", "frame", "centre")})
    top = {c: share(F.sum(F.when(F.col(f"_{c}") <= TOP, F.col(c))), F.sum(c)) for c in ("full", "frame", "centre")}
    return ranked.groupBy("image_id").agg(F.count_if(F.col("full") > 0).cast("int").alias("colors"), top["full"].alias("share"), F.count_if(F.col("frame") > 0).cast("int").alias("f_colors"), top["frame"].alias("f_share"), top["centre"].alias("center_share"))


def window_buttons(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """Three colour masks in the top left corner, their upper medians in order and evenly spaced: 1 if compact, 0.7 if not, else 0."""
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    corner = pixels.filter((F.col("y") < min(height, max(12, int(height * 0.1)))) & (F.col("x") < min(width, max(48, int(width * 0.2)))))
    red = (r > 140) & (r > g + 40) & (r > b + 40)
    yellow = (r > 140) & (g > 100) & (g > b + 30) & (r > b + 30)
    green = (g > 120) & (g > r + 25) & (g > b + 15)
    mark = F.when(red, "r").when(yellow, "y").when(green, "g")
    xs = {m: F.sort_array(F.collect_list(F.when(mark == m, F.col("x")))) for m in "ryg"}  # a corner is at most a fiftieth of an image
    got = corner.groupBy("image_id").agg(*[v.alias(m) for m, v in xs.items()])
    mid = {m: F.get(F.col(m), F.floor(F.size(m) / 2).cast("int")) for m in "ryg"}
    got = got.withColumns({f"{m}m": v for m, v in mid.items()})
    spread = lambda m: F.aggregate(F.col(m), F.lit(0.0), lambda acc, v: acc + F.abs(v - F.col(f"{m}m"))) / F.size(m)
    d1, d2 = F.col("ym") - F.col("rm"), F.col("gm") - F.col("ym")
    enough = (F.size("r") >= BUTTON_HITS) & (F.size("y") >= BUTTON_HITS) & (F.size("g") >= BUTTON_HITS)
    ok = enough & (d1 >= 4) & (d2 >= 4) & (F.abs(d1 - d2) <= F.greatest(F.lit(4.0), F.greatest(d1, d2) * 0.45))
    compact = (spread("r") < 10) & (spread("y") < 10) & (spread("g") < 10)
    return got.select("image_id", F.when(F.coalesce(ok, F.lit(False)), F.when(compact, 1.0).otherwise(0.7)).otherwise(0.0).alias("chrome"))


def middle_row(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, v: the luma of the middle row in order."""
    row = pixels.filter(F.col("y") == height // 2).select("image_id", "x", luma().alias("l"))
    return row.groupBy("image_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("x", "l"))), lambda p: p["l"].cast("double")).alias("v"))


def spectrum(v: Column) -> Column:
    """Magnitudes of the first half of the transform of an array, as the plain sum: for short signals, within the engine."""
    n = F.size(v)

    # v must be a column of its own, not an expression
    def bin_(k: Column) -> Column:
        angle = lambda t: k * t * (2.0 * 3.141592653589793) / n
        part = lambda f: F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda acc, t: acc + F.get(v, t) * f(angle(t)))
        return F.sqrt(F.pow(part(F.cos), F.lit(2.0)) + F.pow(part(F.sin), F.lit(2.0)))

    return F.transform(F.sequence(F.lit(0), F.floor(n / 2).cast("int") - 1), bin_)


def high_frequency(signals: DataFrame, key: str = "image_id", v: str = "v") -> DataFrame:
    """key, hf: zero-padded to a power of two, the padded signal's mean taken off, energy of the bins from 35% on over all but the first.

    Each step's array is settled before the next, whose lambda functions would compute it for every element.
    """
    total = lambda a: F.aggregate(F.col(a), F.lit(0.0), lambda acc, x: acc + x)
    n = F.pow(F.lit(2.0), F.ceil(F.log2(F.size(v).cast("double")) - 1e-9)).cast("int")
    out = settled(signals.select(key, F.concat(F.col(v), F.array_repeat(F.lit(0.0), n - F.size(v))).alias("padded")), ["padded"])
    out = settled(out.withColumn("mean", total("padded") / F.size("padded")), ["mean"])
    out = settled(out.select(key, F.transform("padded", lambda x: x - F.col("mean")).alias("centred")), ["centred"])
    out = settled(out.select(key, spectrum(F.col("centred")).alias("mags")), ["mags"])
    cut = F.floor(F.size("mags") * 0.35).cast("int")
    out = out.select(key, F.slice("mags", cut + 1, F.size("mags")).alias("high"), F.slice("mags", 2, F.size("mags")).alias("rest"))
    return out.select(key, (total("high") / (total("rest") + 1e-6)).alias("hf"))


def spectral_score(hf: Column, lap: Column, chroma: Column, block: Column) -> Column:
    raw = 0.34 * unit(1 - hf / 0.55) + 0.28 * unit(1 - lap / 120) + 0.22 * unit((chroma - 0.35) / 0.45) + 0.16 * unit((block - 0.25) / 0.5)
    return unit(0.15 + 0.7 * raw)


def features(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """All twelve features and the score of each image; below 32 pixels a side the score is 0.5 and the features 0.

    Every part is grouped by image, so after one exchange by image_id each the joins need no other.
    """
    zero = ("hf", "lap", "chroma", "block", "axis", "share", "f_axis", "f_share", "center_share", "chrome")
    if width < 32 or height < 32:
        none = {c: F.lit(0.0) for c in zero} | {c: F.lit(0) for c in ("colors", "f_colors")}
        return pixels.select("image_id").distinct().withColumns(none | {"score": F.lit(0.5), "detail": F.lit("too-small")})
    parts = basic(neighbours(pixels, width), width, height).drop("mean", "variance", "h_edges", "v_edges", "o_edges")
    parts = parts.join(palette(pixels, width, height), "image_id").join(window_buttons(pixels, width, height), "image_id", "left")
    parts = parts.join(high_frequency(middle_row(pixels, width, height)), "image_id")
    parts = parts.withColumn("chrome", F.coalesce("chrome", F.lit(0.0)))
    return parts.withColumns({"score": spectral_score(F.col("hf"), F.col("lap"), F.col("chroma"), F.col("block")), "detail": F.lit("ok")})


def stub_score(pixels: DataFrame) -> DataFrame:
    """The reproducible head: every other pixel of every other row; smooth fields score high."""
    y = F.col("r") * 0.299 + F.col("g") * 0.587 + F.col("b") * 0.114
    colour = (F.greatest("r", "g", "b") - F.least("r", "g", "b")) / F.lit(255.0)
    got = pixels.filter("x % 2 = 0 AND y % 2 = 0").groupBy("image_id").agg(F.avg(y).alias("m"), F.avg(y * y).alias("q"), F.avg(colour).alias("c"))
    real = 0.85 * unit(F.greatest(F.lit(0.0), F.col("q") - F.col("m") * F.col("m")) / 2200) + 0.15 * unit(F.col("c") / 0.55)
    return got.select("image_id", F.least(F.lit(0.95), F.greatest(F.lit(0.05), 0.9 - real * 0.8)).alias("stub"))


def box_downsample(pixels: DataFrame, width: int, height: int, most: int = 256, least: int = 32) -> DataFrame:
    """Area average by integer bins; only ever smaller, so bins don't overlap. Rounds half up."""
    scale = min(1.0, most / max(width, height))
    w, h = max(least, int(width * scale + 0.5)), max(least, int(height * scale + 0.5))
    if w > width or h > height:
        raise ValueError("the image is smaller than the least size")
    # the bin of x is the last o with floor(o * width / w) <= x
    bin_ = lambda c, n, m: F.floor(((F.col(c) + 1) * m - 1) / F.lit(float(n))).cast("int")
    mean = lambda c: F.floor(F.avg(c) + 0.5).cast("int").alias(c)
    return pixels.groupBy("image_id", bin_("x", width, w).alias("ox"), bin_("y", height, h).alias("oy")).agg(mean("r"), mean("g"), mean("b")).withColumnsRenamed({"ox": "x", "oy": "y"})


# ---- marks burnt into corners ----------------------------------------------------


def regions(width: int, height: int) -> list[tuple[int, int, int, int, int]]:
    """Number and bounds of the regions where marks stand: four corners, the foot, the lower right."""
    bw, bh, foot = max(32, int(width * 0.4)), max(20, int(height * 0.22)), max(22, int(height * 0.18))
    return [
        (0, 0, 0, bw, bh), (1, width - bw, 0, width, bh), (2, 0, height - bh, bw, height), (3, width - bw, height - bh, width, height),
        (4, int(width * 0.15), height - foot, int(width * 0.85), height), (5, int(width * 0.55), int(height * 0.7), width, height),
    ]


def lit_points(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, region, rw, rh, x, y (within the region), lit: at least the region's mean luma."""
    inside = lambda t: (F.col("x") >= t[1]) & (F.col("x") < t[3]) & (F.col("y") >= t[2]) & (F.col("y") < t[4])
    # a region that a pixel isn't in gives an empty row, dropped behind; a filter of the array would not be compiled
    which = F.array(*[F.when(inside(t), F.struct(F.lit(t[0]).alias("region"), F.lit(t[1]).alias("x0"), F.lit(t[2]).alias("y0"), F.lit(t[3] - t[1]).alias("rw"), F.lit(t[4] - t[2]).alias("rh"))) for t in regions(width, height)])
    cut = pixels.select("image_id", "x", "y", luma().alias("l"), F.inline(which)).filter("region IS NOT NULL").select("image_id", "region", "rw", "rh", (F.col("x") - F.col("x0")).alias("x"), (F.col("y") - F.col("y0")).alias("y"), "l")
    return cut.withColumn("lit", F.col("l") >= F.avg("l").over(W.partitionBy("image_id", "region")))


def _polarities(plain: Column, inverse: Column, name: str) -> Column:
    return F.inline(F.array(F.struct(F.lit(False).alias("invert"), plain.alias(name)), F.struct(F.lit(True).alias("invert"), inverse.alias(name))))


def binarised(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """image_id, region, invert, x, y (within the region), bit: at least the region's mean luma, in both polarities."""
    lit = F.col("lit")
    return lit_points(pixels, width, height).select("image_id", "region", "rw", "rh", "x", "y", _polarities(lit.cast("int"), (~lit).cast("int"), "bit"))


def densities(points: DataFrame) -> DataFrame:
    """image_id, region, invert, y, density: of each row the share of set bits; lit points are counted once for both polarities."""
    rows = points.groupBy("image_id", "region", "y").agg(F.count_if("lit").alias("lit"), F.count("lit").alias("n"))
    share_ = lambda c: F.try_divide(c.cast("double"), F.col("n").cast("double"))
    return rows.select("image_id", "region", "y", _polarities(share_(F.col("lit")), share_(F.col("n") - F.col("lit")), "density"))


_BANDS = ("image_id", "region", "invert")


def text_bands(bits: DataFrame, lo: float = 0.02, hi: float = 0.55, least: int = 5, most: int = 4) -> DataFrame:
    """Runs of rows whose share of set bits is within bounds: gaps and islands; the first ``most`` of at least ``least`` rows."""
    return bands(bits.groupBy(*_BANDS, "y").agg(F.avg("bit").alias("density")), lo, hi, least, most)


def bands(rows: DataFrame, lo: float = 0.02, hi: float = 0.55, least: int = 5, most: int = 4) -> DataFrame:
    """As ``text_bands``, from the densities of rows."""
    key, rows = _BANDS, rows.filter(F.col("density").between(lo, hi))
    island = F.col("y") - F.row_number().over(W.partitionBy(*key).orderBy("y"))
    runs = rows.withColumn("island", island).groupBy(*key, "island").agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1")).filter(F.col("y1") - F.col("y0") >= least)
    return runs.withColumn("band", F.row_number().over(W.partitionBy(*key).orderBy("y0"))).filter(F.col("band") <= most).drop("island")
