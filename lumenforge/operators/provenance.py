"""Scan of image bytes for provenance markers.

Bytes are read as Latin-1, one character each. A catalog is an ordered list of
patterns of which the first that matches names the verdict.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import settled

HEAD, TAIL, XMP_LEAST, WALKED = 512_000, 16_000, 8_000, 1 << 22

# Patterns in order of priority; the text of a pattern is part of the verdict.
SOFT_BINDING = [
    r"c2pa\.watermarked\.unbound", r"c2pa\.watermarked", r"c2pa\.softbinding", r"soft[\s_-]?binding", r"\bsynthid\b", r"deepmind\.google\/.*synthid", r"ai\.google\.dev\/.*synthid",
    r"watermarked\.unbound", r'"action"\s*:\s*"c2pa\.watermarked', r"softBinding(s|Algorithms?)?", r"watermark\.softbinding", r"com\.google\.synthid", r"org\.c2pa\.softbinding",
]
SOFTWARE = [
    r"\bmidjourney\b", r"\bstable[\s_-]?diffusion\b", r"\bstability[\s_-]?ai\b", r"\bdall[\s.·-]?e\b", r"\bchatgpt\b", r"\bopenai\b", r"\bgpt[\s_-]?image\b", r"\bsora\b", r"\badobe\s*firefly\b", r"\bfirefly\b",
    r"\bcontentcredentials\b", r"\bflux(\.1|[_\s-]?dev|[_\s-]?pro|[_\s-]?schnell)?\b", r"\bblack[\s_-]?forest[\s_-]?labs\b", r"\bcomfyui\b", r"\bautomatic1111\b", r"\ba1111\b", r"\binvokeai\b", r"\bnightcafe\b", r"\bleonardo\.?ai\b", r"\bideogram\b",
    r"\bgrok\b", r"\bxai\b", r"\bgrok[\s_-]?imagine\b", r"\bgemini\b", r"\bimagen\b", r"\bimagefx\b", r"\bvertexai\b", r"\bdeepmind\b", r"\bsynthid\b", r"\breve\b",
    r"\bcivitai\b", r"\brecraft\b", r"\brunway\b", r"\bluma[\s_-]?ai\b", r"\bdreamstudio\b", r"\bcraiyon\b", r"\bwombo\b", r"\bstarryai\b", r"\bclipdrop\b", r"\bphotoleap\b",
    r"\bcanva\b", r"\bmagic[\s_-]?studio\b", r"\bcopilot\b", r"\bbing[\s_-]?image[\s_-]?creator\b", r"\bmicrosoft[\s_-]?designer\b", r"\bdesigner\.microsoft\b", r"\bpicas\b", r"\bperchance\b", r"\bnovelai\b", r"\bwaifu[\s_-]?diffusion\b",
    r"\byandexart\b", r"\bkandinsky\b", r"\bfusion[\s_-]?brain\b", r"\balibaba\b", r"\btongyi\b", r"\bqwen[\s_-]?vl\b", r"\bbai[\s_-]?du\b", r"\bernie\b", r"\bwenxin\b", r"\bhuggingface\b",
    r"\bdiffusers\b", r"\bmagnific(?!ent)\b", r"\blucidpic\b", r"\bimagineme\b", r"\blogoai\b", r"\bgenerated\.photos\b", r"\bthispersondoesnotexist\b", r"\bartbreeder\b", r"\bpromptbase\b", r"\blexica\b",
    r"\bcraiyon\b", r"\bai[\s_-]?generated\b", r"\bgenerated\s+with\s+ai\b", r"\bcreated\s+with\s+ai\b", r"\bmade\s+with\s+ai\b", r"\bgenerated\s+by\s+ai\b", r"\bartificial\s+intelligence\b", r"\btrainedalgorithmicmedia\b", r"\bcompositedwithtrainedalgorithmicmedia\b", r"\balgorithmic[\s_-]?media\b",
]
PARAMETERS = [
    *SOFT_BINDING, r"\bsampler\s*[:=]", r"\bcfg\s*scale\s*[:=]", r"\bsteps\s*[:=]\s*\d+", r"\bnegative\s*prompt\s*[:=]", r"\btxt2img\b", r"\bimg2img\b", r"\binpaint(ing)?\b", r"\bmodel\s*hash\s*[:=]", r"\bclip\s*skip\s*[:=]", r"\bvae\s*[:=]",
    r"\blora\b", r"\bcontrolnet\b", r"digitalSourceType", r"c2pa\.actions(\.v2)?", r"\bc2pa\b", r"\bjumb(f)?\b", r"claim_generator", r"claimGenerator", r"http:\/\/cv\.iptc\.org\/newscodes\/digitalsourcetype\/", r"trainedAlgorithmicMedia",
    r"compositeWithTrainedAlgorithmicMedia", r"algorithmicEnhancement", r"ptEXtAIGC", r"AIGCLabel", r"ContentProducer", r"ProduceID", r"ReservedCode1", r"ai_generated", r'"Label"\s*:\s*"1"', r"dcterms:provenance",
    r"xmpMM:History", r"instanceID.*firefly", r"cai:Assertion(s)?", r"contentcredentials", r"contentauthenticity",
]
#: Patterns of the parameter catalog that heed case.
EXACT_CASE = {r'"Label"\s*:\s*"1"'}
XMP = "http://ns.adobe.com/xap/1.0/"
PNG_KEPT, JPEG_KEPT = frozenset({b"tEXt", b"iTXt", b"zTXt", b"eXIf", b"caBX", b"vpAd"}), frozenset([*range(0xE0, 0xF0), 0xFE])

_WORD = "[A-Za-z0-9_]"
_EDGE = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def java(pattern: str) -> str:
    """The pattern for Java, with boundaries over ASCII letters, white space as scripts know it and a dot that stops at line ends only."""
    out = re.sub(r"\\b", lambda _: _EDGE, pattern)
    out = re.sub(r"\[\\s", lambda _: r"[\\s\\u00A0".replace(r"\\", "\\"), out)
    out = re.sub(r"(?<!\[)\\s", lambda _: r"[\s ]", out)
    out = re.sub(r"(?<!\\)\.(?=\*)", lambda _: r"[^\n\r]", out)
    return out if pattern in EXACT_CASE else f"(?i:{out})"


def needed(pattern: str) -> str:
    """The longest run of letters and digits, in lower case, that any match of the pattern holds."""
    bare = re.sub(r"\\[bsd][*+?]?|\[[^]]*\][*+?]?|\(\?![^)]*\)|\([^)]*\)\?|\.\*|\w\?", " ", pattern)
    return max(re.findall(r"[A-Za-z0-9_]+", bare), key=len).lower()


def first_match(text: str, low: str, catalog: list[str]) -> Column:
    """The first pattern of the catalog that column ``text`` holds, or null. low: the text in lower case.

    A plain search for what a pattern needs comes before its regular expression,
    which so runs on few rows.
    """
    return F.coalesce(*[F.when(F.contains(low, F.lit(needed(p))) & F.col(text).rlike(java(p)), F.lit(p)) for p in catalog])


def latin1(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def window_text(content: Column, most: int = HEAD) -> Column:
    """All bytes, or the first and last ``most`` of them, a line feed between."""
    ends = F.concat(F.substring(content, 1, most), F.lit(b"\n"), content.substr(F.octet_length(content) - (most - 1), F.lit(most)))
    return latin1(F.when(F.octet_length(content) <= 2 * most, content).otherwise(ends))


def png_parts(b: bytes) -> list[bytes]:
    out, i = [], 8
    while i + 12 < len(b):
        size, kind = int.from_bytes(b[i : i + 4], "big", signed=True), b[i + 4 : i + 8]
        end = min(len(b), i + 8 + max(0, size))
        if kind in PNG_KEPT:
            out.append(b[i + 8 : end])
        i = end + 4
        if kind == b"IEND":
            break
    return [*out, b[-TAIL:]]


def jpeg_parts(b: bytes) -> list[bytes]:
    out, i = [], 2
    while i + 4 < len(b) and b[i] == 0xFF and b[i + 1] not in (0xD9, 0xDA):
        size = int.from_bytes(b[i + 2 : i + 4], "big")
        if size < 2:
            break
        if b[i + 1] in JPEG_KEPT:
            out.append(b[i + 4 : i + 2 + size])
        i += 2 + size
    return [*out, b[-TAIL:]]


def parts(b: bytes | None) -> bytes | None:
    if b is None:
        return None
    if b[:4] == b"\x89PNG" and len(b) >= 8:
        return b"\n".join(png_parts(b))
    return b"\n".join(jpeg_parts(b)) if b[:2] == b"\xff\xd8" else None


def walked(contents: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Containers one by one; what they give leaves when it has ``WALKED`` bytes, however large a batch is."""
    for batch in contents:
        out, held = [], 0
        for value in batch:
            out.append(parts(value.as_py()))
            held += len(out[-1] or b"")
            if held >= WALKED:
                yield pa.array(out, pa.binary())
                out, held = [], 0
        if out:
            yield pa.array(out, pa.binary())
    pa.default_memory_pool().release_unused()


@F.arrow_udf(T.BinaryType())
def container_parts(contents: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Metadata of PNG and JPEG containers, whose strides depend on the data; null for others."""
    return walked(contents)


def meta_text(content: Column, container: Column | None = None) -> Column:
    """Text of the metadata alone; containers of other kinds give the window."""
    return window_text(content) if container is None else F.coalesce(latin1(container), window_text(content))


def verdict(df: DataFrame, content: str = "content", containers: bool = True) -> DataFrame:
    """Add prov, prov_detail, prov_stop. Null and empty contents are 'empty-bytes' with score 0.5.

    The Python walk runs over PNG and JPEG rows without a soft binding alone.
    """
    c = F.col(content)
    out = settled(df.withColumn("_full", window_text(c)), ["_full"])
    out = settled(out.withColumn("_low", F.lower("_full")), ["_low"])
    out = settled(out.withColumn("_soft", first_match("_full", "_low", SOFT_BINDING)), ["_soft"])
    if containers:
        walk = (F.substring(c, 1, 4) == F.unhex(F.lit("89504E47"))) | (F.substring(c, 1, 2) == F.unhex(F.lit("FFD8")))
        # one pass: rows that are not walked send no content
        out = out.withColumn("_parts", container_parts(F.when(walk & F.col("_soft").isNull(), c)))
        out = settled(out.withColumn("_meta", F.coalesce(latin1(F.col("_parts")), F.col("_full"))).drop("_parts"), ["_meta"])
        out = settled(out.withColumn("_mlow", F.lower("_meta")), ["_mlow"])
    else:
        out = out.withColumns({"_meta": F.col("_full"), "_mlow": F.col("_low")})
    at = F.locate(XMP, F.col("_meta"))
    out = out.withColumns({"_software": first_match("_meta", "_mlow", SOFTWARE), "_param": first_match("_meta", "_mlow", PARAMETERS), "_xmp": (at > 0) & (F.length("_meta") - at + 1 > XMP_LEAST)})
    empty = F.coalesce(F.octet_length(c), F.lit(0)) == 0
    out = settled(out, ["_software", "_param", "_xmp"])
    rows = [
        (empty, 0.5, F.lit("empty-bytes"), False),
        (F.col("_soft").isNotNull(), 0.99, F.concat(F.lit("watermark-synthid-meta:"), "_soft"), True),
        (F.col("_software").isNotNull(), 0.98, F.concat(F.lit("watermark-meta:software:"), "_software"), True),
        (F.col("_param").isNotNull(), 0.93, F.concat(F.lit("watermark-meta:params:"), "_param"), True),
        (F.col("_xmp"), 0.62, F.lit("large-xmp"), False),
        (F.lit(True), 0.5, F.lit("no-provenance"), False),
    ]
    pick = lambda k: F.coalesce(*[F.when(r[0], r[k] if isinstance(r[k], Column) else F.lit(r[k])) for r in rows])
    return out.withColumns({"prov": pick(1), "prov_detail": pick(2), "prov_stop": pick(3)}).drop("_full", "_low", "_soft", "_meta", "_mlow", "_software", "_param", "_xmp")


def scan_files(paths: Iterator[str] | list[str], spark) -> DataFrame:
    """Files as path, content: the source that ``verdict`` reads."""
    return spark.read.format("binaryFile").load(list(paths)).select("path", "content")
