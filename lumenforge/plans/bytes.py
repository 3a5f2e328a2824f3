"""Queries of the provenance scan over documents and pages, with planted markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.operators import provenance as pv
from lumenforge.session import table

from .catalog import query

_MARKS = [
    "", "x c2pa.watermarked.unbound y", "Soft Binding", "made in Midjourney!", "a magnificent view", "Magnific upscaler", "Steps: 20, Sampler: Euler", "negative prompt: hands", '"Label": "1"', '"label": "1"',
    "DALL-E 3", "stable_diffusion", "http://ns.adobe.com/xap/1.0/", "jumbf box", "openai", "exai", "generated  with ai", "digitalsourcetype", "xmpMM:History", "softbindings",
]
_MARK = "CASE mod(doc_id, 20) " + " ".join(f"WHEN {k} THEN '{m}'" for k, m in enumerate(_MARKS)) + " END"
ARTIFACTS = f"SELECT doc_id, concat(coalesce(text, ''), ' ', {_MARK}, ' end') AS t FROM {{docs}}"


def artifacts(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.sql(ARTIFACTS.format(docs="{docs}"), docs=table(spark, d, "documents"))
    return rows.select("doc_id", F.encode("t", "UTF-8").alias("content"))


def _duck_match(col: str, pattern: str) -> str:
    flags = "" if pattern in pv.EXACT_CASE else ", 'i'"
    one = lambda p: f"regexp_matches({col}, '{p}'{flags})"
    if "(?!ent)" in pattern:  # the engine has no lookahead; the word is followed by no boundary unless it ends
        return one(r"\bmagnific\b")
    return one(pattern.replace("'", "''").replace(r"\/", "/"))


def _duck_first(col: str, catalog: list[str]) -> str:
    return "CASE " + " ".join(f"WHEN {_duck_match(col, p)} THEN '{p}'" for p in catalog) + " END"


_HITS = f"SELECT doc_id, t, {_duck_first('t', pv.SOFT_BINDING)} AS soft, {_duck_first('t', pv.SOFTWARE)} AS software, {_duck_first('t', pv.PARAMETERS)} AS param, instr(t, '{pv.XMP}') > 0 AND octet_length(encode(t)) - octet_length(encode(split_part(t, '{pv.XMP}', 1))) > {pv.XMP_LEAST} AS xmp FROM ({ARTIFACTS.format(docs='documents')})"


@query("p01_p02_p05_p10_provenance", f"SELECT doc_id, CASE WHEN soft IS NOT NULL THEN 0.99 WHEN software IS NOT NULL THEN 0.98 WHEN param IS NOT NULL THEN 0.93 WHEN xmp THEN 0.62 ELSE 0.5 END::DOUBLE AS prov, CASE WHEN soft IS NOT NULL THEN concat('watermark-synthid-meta:', soft) WHEN software IS NOT NULL THEN concat('watermark-meta:software:', software) WHEN param IS NOT NULL THEN concat('watermark-meta:params:', param) WHEN xmp THEN 'large-xmp' ELSE 'no-provenance' END AS prov_detail, coalesce(soft, software, param) IS NOT NULL AS prov_stop FROM ({_HITS})")
def provenance(spark: SparkSession, d: str) -> DataFrame:
    """Catalogs in order of priority over whole contents."""
    return pv.verdict(artifacts(spark, d), containers=False).select("doc_id", "prov", "prov_detail", "prov_stop")


@query("p02_window", f"SELECT doc_id, n, CASE WHEN n > 400 THEN 401 ELSE n END::INT AS shown, sha256(CASE WHEN n > 400 THEN left(h, 400) || '0A' || right(h, 400) ELSE h END) AS digest FROM (SELECT doc_id, octet_length(encode(t))::INT AS n, hex(encode(t)) AS h FROM ({ARTIFACTS.format(docs='documents')}))")
def window(spark: SparkSession, d: str) -> DataFrame:
    """Here with 200 bytes a side, so that texts are cut; the window's characters are held by digest."""
    rows = artifacts(spark, d).withColumn("w", pv.window_text(F.col("content"), 200))
    return rows.select("doc_id", F.octet_length("content").alias("n"), F.length("w").alias("shown"), F.sha2(F.hex(F.encode("w", "ISO-8859-1")).cast("binary"), 256).alias("digest"))


_T = "encode(coalesce(text, ''))"
_LEN = "(length({x}) // 2)"


def _hex_tail(x: str) -> str:
    return f"right({x}, 32000)"


_PNG = f"concat('89504E470D0A1A0A', lpad(to_hex({_LEN.format(x='t')}), 8, '0'), hex('tEXt'), t, '00000000', '00000003', hex('IDAT'), hex('abc'), '00000000', '00000000', hex('IEND'), '00000000')"
#: a JPEG segment holds 65533 bytes at most: the text in segments of 60000, each with its marker and length
_JPEG = f"concat('FFD8', array_to_string(list_transform(parts, lambda p: concat('FFE1', lpad(to_hex({_LEN.format(x='p')} + 2), 4, '0'), p)), ''), 'FFDA', t)"
_PARTS = f"list_transform(range(0, greatest(1, ({_LEN.format(x='t')} + 59999) // 60000)), lambda i: substr(t, i * 120000 + 1, 120000))"


@query("p03_p04_containers", f"SELECT doc_id, sha256(lower(CASE WHEN doc_id % 2 = 0 THEN concat(t, '0A', {_hex_tail('png')}) ELSE concat(array_to_string(parts, '0A'), '0A', {_hex_tail('jpeg')}) END)) AS kept FROM (SELECT doc_id, t, parts, {_PNG} AS png, {_JPEG} AS jpeg FROM (SELECT doc_id, t, {_PARTS} AS parts FROM (SELECT doc_id, hex({_T}) AS t FROM documents)))")
def containers(spark: SparkSession, d: str) -> DataFrame:
    """Texts as chunks of PNG files (even ids) and segments of JPEG files (odd ids): a digest of the bytes that the walkers keep, in hex."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    size = F.octet_length(text)
    four = lambda n: F.unhex(F.lpad(F.hex(n), 8, "0"))
    chunk = lambda kind, data, n: F.concat(four(n), F.lit(kind), data, F.lit(b"\0\0\0\0"))
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A")), chunk(b"tEXt", text, size), chunk(b"IDAT", F.lit(b"abc"), F.lit(3)), chunk(b"IEND", F.lit(b""), F.lit(0)))
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(size / 60000).cast("int") - 1))
    part = lambda i: F.hex(F.substring(text, i * 60000 + 1, F.lit(60000)))
    segment = lambda i: F.concat(F.lit("FFE1"), F.lpad(F.hex((F.length(part(i)) / 2).cast("int") + 2), 4, "0"), part(i))
    jpeg = F.unhex(F.concat(F.lit("FFD8"), F.array_join(F.transform(starts, segment), ""), F.lit("FFDA"), F.hex(text)))
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, png).otherwise(jpeg).alias("content"))
    return rows.select("doc_id", F.sha2(F.lower(F.hex(pv.container_parts("content"))).cast("binary"), 256).alias("kept"))
