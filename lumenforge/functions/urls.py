"""Choosing the address of the largest asset: srcset parsing, embedded full-size addresses, thumbnail hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
BARE_SCORE, PIXELS_PER_DENSITY, ATTR_SCORE, LINK_SCORE = 1.0, 400.0, 1e7, 9e6
PARAM_PATTERNS = [r"(?i)[?&#]imgurl=([^&]+)", r"(?i)[?&#]imgrefurl=([^&]+)", r"(?i)[?&#]mediaurl=([^&]+)", r"(?i)imgurl%3D([^&%]+)", r'(?i)"ou"\s*:\s*"(https?:\\/\\/[^"]+)"', r'(?i)"ou"\s*:\s*"(https?://[^"]+)"']
THUMB_HOSTS = r"(?i)encrypted-tbn|tse\d+\.mm\.bing|th\.bing\.com|gstatic\.com/images"
SMALL_SUFFIX = r"(?i):(?:tiny|small|medium|thumb|120x120|240x240|360x360|900x900)$"
ID_TO_FULL = r'"([A-Za-z0-9_-]{6,32})",\s*\[\s*"https://[^"]*gstatic\.com/images[^"]*"\s*,\s*\d+\s*,\s*\d+\s*\]\s*,\s*\[\s*"(https?://[^"]+)"'
THUMB_TO_FULL = r'"(https://encrypted-tbn[^"]+)"\s*,\s*\d+\s*,\s*\d+\s*\]\s*,\s*\[\s*"(https?://(?!encrypted-tbn)[^"]+)"'
ID_ATTRS = ("data-id", "data-docid", "data-ci", "data-lpage")

CANDIDATES = "array<struct<url:string,score:double>>"


def parse_srcset(x: Column) -> Column:
    """Candidates with a width (w) or density (x) descriptor; bare addresses count least; sizes of 0 are dropped."""
    pattern = r"^(?s)(.+?)\s+(\d+(?:\.\d+)?)([wWxX])$"

    def one(part: Column) -> Column:
        p = F.trim(part)
        value, unit = F.regexp_extract(p, pattern, 2), F.lower(F.regexp_extract(p, pattern, 3))
        size = F.try_to_number(F.when(value != "", value), F.lit("9999999999.999999")).cast("double")
        sized = F.struct(F.trim(F.regexp_extract(p, pattern, 1)).alias("url"), F.when(unit == "w", size).otherwise(size * PIXELS_PER_DENSITY).alias("score"))
        return F.when(p == "", F.lit(None)).when(value == "", F.struct(p.alias("url"), F.lit(BARE_SCORE).alias("score"))).when(size > 0, sized)

    return F.filter(F.transform(F.split(x, ","), one), lambda c: c.isNotNull())


def pick_best(candidates: Column) -> Column:
    """The address with the highest score, the first among equals; null if there is none. One walk over the candidates, which are computed once."""
    better = lambda best, c: F.when(best["score"].isNull() | (c["score"] > best["score"]), c).otherwise(best)
    return F.aggregate(candidates, F.lit(None).cast("struct<url:string,score:double>"), better)["url"]


def decode_escapes(x: Column) -> Column:
    """Three script escapes, then percent escapes; what can't be decoded stays. A plus sign stays one."""
    v = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?i)\\u003d", "="), r"(?i)\\u0026", "&"), r"\\/", "/")
    return F.coalesce(F.try_url_decode(F.replace(v, F.lit("+"), F.lit("%2B"))), v)


def full_url_param(x: Column) -> Column:
    """The first pattern whose value is a web address once decoded."""
    out = []
    for p in PARAM_PATTERNS:
        raw = F.regexp_extract(x, p, 1)
        v = decode_escapes(raw)
        out.append(F.when((raw != "") & v.rlike("(?i)^https?://"), v))
    return F.coalesce(*out)


def is_thumb(x: Column) -> Column:
    return F.coalesce(x.rlike(THUMB_HOSTS), F.lit(False))


def upgraded(x: Column) -> Column:
    """The larger variant of an address of one social image host; all other addresses stay as they are."""
    ours = F.lower(F.try_parse_url(x, F.lit("HOST"))).rlike(r"(?i)\.twimg\.com$")
    name = F.try_parse_url(x, F.lit("QUERY"), F.lit("name"))
    path, rest = F.regexp_extract(x, r"^([^?#]*)", 1), F.regexp_extract(x, r"^[^?#]*(.*)$", 1)
    avatar = F.when(path.rlike("(?i)/profile_images/"), F.regexp_replace(path, r"(?i)_(?:mini|normal|bigger)(\.\w+)$", "_400x400$1")).otherwise(path)
    named = F.when(name.rlike("(?i)^(?:large|orig)$"), x).otherwise(F.regexp_replace(x, r"([?&]name=)[^&#]*", "$1large"))
    out = F.when(name.isNotNull(), named).when(path.rlike(SMALL_SUFFIX), F.concat(F.regexp_replace(path, SMALL_SUFFIX, ":large"), rest)).otherwise(F.concat(avatar, rest))
    return F.when(F.coalesce(ours, F.lit(False)), out).otherwise(x)


def script_map(scripts: DataFrame, key: str, text: str) -> DataFrame:
    """key, id, url: pairs that scripts of a page embed, from both patterns; the last one written wins, thumbs also under their token."""
    keep = scripts.filter(F.contains(text, F.lit("gstatic.com/images")))

    def found(pattern: str, order: int) -> DataFrame:
        both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("id"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("url"))
        return keep.select(key, F.lit(order).alias("o"), F.posexplode(both).alias("pos", "p")).select(key, "o", "pos", F.col("p.id").alias("id"), decode_escapes(F.col("p.url")).alias("url"))

    pairs = found(ID_TO_FULL, 0).union(found(THUMB_TO_FULL, 1)).filter(F.col("url").rlike("(?i)^https?://") & ~F.col("url").rlike(r"(?i)gstatic\.com/images"))
    token = F.regexp_extract("id", r'tbn:[^&\s"]+', 0)
    names = F.when((F.col("o") == 1) & (token != ""), F.array("id", token)).otherwise(F.array("id"))
    return pairs.select(key, F.explode(names).alias("id"), "url", "o", "pos").groupBy(key, "id").agg(F.max_by("url", F.struct("o", "pos")).alias("url"))


def ancestor_lookup(attrs: DataFrame, pairs: DataFrame, img: str, page: str) -> DataFrame:
    """attrs: img, page, depth, attr_ord, value. Of each image the mapped address of its nearest ancestor's first attribute that the map knows, ten levels up."""
    near = attrs.filter("depth < 10").join(pairs.select(page, F.col("id").alias("value"), "url"), [page, "value"])
    return near.groupBy(img).agg(F.min_by("url", F.struct("depth", "attr_ord")).alias("url"))


def resolve(mode: str, attr_url: Column, linked: Column, srcset: Column, current: Column, pixels: Column) -> Column:
    """The address to score: the displayed asset ('fast') or the original ('full')."""
    ok = lambda u: F.coalesce((F.trim(u) != "") & ~F.startswith(F.trim(u), F.lit("data:image/svg")), F.lit(False))
    one = lambda u, s: F.when(ok(u), F.array(F.struct(F.trim(u).alias("url"), s.cast("double").alias("score")))).otherwise(F.array().cast(CANDIDATES))
    natural = F.greatest(F.lit(1.0), F.coalesce(pixels.cast("double"), F.lit(0.0)))
    if mode == "fast":
        natural = F.when(is_thumb(current), F.greatest(natural, F.lit(1000.0))).otherwise(natural)
    parts = [one(attr_url, F.lit(ATTR_SCORE)), one(linked, F.lit(LINK_SCORE))] if mode == "full" else []
    parts += [F.coalesce(parse_srcset(srcset), F.array().cast(CANDIDATES)), one(current, natural)]
    best = F.coalesce(pick_best(F.concat(*parts)), current)
    # bound as an element, since every use of a column in an expression computes it anew
    return F.get(F.transform(F.array(best), upgraded), F.lit(0)) if mode == "full" else best
