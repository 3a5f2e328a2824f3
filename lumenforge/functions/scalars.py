"""Scalar rules as columns: names, acceptance, eligibility, messages, options, magic bytes."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def slugify(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), "[^a-zA-Z0-9._-]+", "__")


def domain_name(x: Column | str, most: int | None = None) -> Column:
    out = F.regexp_replace(F.lower(_c(x)), "[^a-z0-9._-]+", "-")
    return F.substring(out, 1, most) if most else out


def is_vector_model(id_: Column | str, name: Column | str) -> Column:
    holds = lambda c: F.coalesce(F.contains(F.lower(_c(c)), F.lit("vector")), F.lit(False))
    return holds(id_) | holds(name)


def first_acceptable(values: Column | str, preferred: list[str], else_first: bool = False) -> Column:
    """The first preferred value that the array holds; otherwise null, or the array's first."""
    out = F.coalesce(*[F.when(F.array_contains(_c(values), p), F.lit(p)) for p in preferred])
    return F.coalesce(out, F.get(_c(values), F.lit(0))) if else_first else out


def accepted_image(n_bytes: Column | str, width: Column | str, height: Column | str) -> Column:
    side = F.least(_c(width), _c(height))
    return F.coalesce(_c(n_bytes).between(1000, 25_000_000) & (_c(width) > 0) & (_c(height) > 0) & (side >= 96), F.lit(False))


def eligible(src: Column | str, width: Column | str, height: Column | str, attached: Column, least: int = 48) -> Column:
    """Unknown sizes (null or 0) are allowed; vector data URLs and detached images aren't."""
    ok = lambda side: F.coalesce(_c(side), F.lit(0)) <= 0
    fits = (ok(width) | (_c(width) >= least)) & (ok(height) | (_c(height) >= least))
    named = F.coalesce((F.length(_c(src)) > 0) & ~F.startswith(_c(src), F.lit("data:image/svg")), F.lit(False))
    return attached & named & fits


#: Parts of messages after which there is no use in trying again.
FATAL = ("wasm", "ort", "onnx", "aborted", "session", "offscreen", "both async and sync", "instantiate", "visual inference unavailable", "distilled visual", "missing from cache")


def fatal_message(x: Column | str) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(F.lower(_c(x)), F.lit(p)) for p in FATAL]), F.lit(False))


def cache_mode(src: Column | str) -> Column:
    """Sources that change from one request to the next are not cached."""
    return F.when(_c(src).rlike("(?i)thispersondoesnotexist|random|uuid=|timestamp=|nocache"), "no-cache").otherwise("force-cache")


def migrated_thresholds(ai: Column | str, real: Column | str, new_ai: float = 0.6951, new_real: float = 0.4099) -> tuple[Column, Column]:
    """Options from before there were two thresholds get the new pair; missing ones get the defaults."""
    old = _c(real).isNull() & (_c(ai).isNull() | (_c(ai) == 0.65))
    return F.when(old, new_ai).otherwise(F.coalesce(_c(ai), F.lit(new_ai))), F.when(old, new_real).otherwise(F.coalesce(_c(real), F.lit(new_real)))


def conceal_mode(x: Column | str, modes: tuple[str, ...] = ("blur", "blank", "none"), default: str = "blur") -> Column:
    return F.when(_c(x).isin(*modes), _c(x)).otherwise(default)


def viewport_priority(top: Column | str, bottom: Column | str, left: Column | str, right: Column | str, view_h: Column | str, view_w: Column | str, attached: Column) -> Column:
    """Three bands that don't overlap: visible (nearest the centre first), below (nearest first), above; detached last."""
    top, bottom, left, right, view_h, view_w = map(_c, (top, bottom, left, right, view_h, view_w))
    visible = (bottom > 0) & (top < view_h) & (right > 0) & (left < view_w) & (right > left) & (bottom > top)
    centre = F.abs((top + bottom) / 2.0 - view_h / 2.0)
    below = 500_000.0 - F.least(F.lit(500_000.0), (top - view_h).cast("double"))
    above = 250_000.0 - F.least(F.lit(250_000.0), F.greatest(F.lit(0.0), -bottom.cast("double")))
    return F.when(~attached, -1e9).when(visible, 1_000_000.0 - centre).when(top >= view_h, below).otherwise(above)


def _starts(content: Column, hexed: str, at: int = 1) -> Column:
    n = len(hexed) // 2
    return F.coalesce(F.substring(content, at, n) == F.unhex(F.lit(hexed)), F.lit(False))


def sniff_mime(content: Column | str) -> Column:
    """Five outcomes by magic bytes."""
    c = _c(content)
    webp = _starts(c, "52494646") & _starts(c, "57454250", 9)
    png, gif = _starts(c, "89504E47") & (F.octet_length(c) >= 8), _starts(c, "474946") & (F.octet_length(c) >= 6)
    return F.when(_starts(c, "FFD8FF"), "image/jpeg").when(png, "image/png").when(webp, "image/webp").when(gif, "image/gif").otherwise("application/octet-stream")


def sniff_extension(content: Column | str) -> Column:
    """Five outcomes; markup counts as a vector image by its first 64 bytes."""
    c = _c(content)
    head = F.decode(F.substring(c, 1, 64), "ISO-8859-1")
    long = lambda n: F.octet_length(c) >= n
    out = F.when(_starts(c, "FFD8FF"), "jpg").when(_starts(c, "89504E47") & long(8), "png").when(_starts(c, "52494646") & long(12), "webp")
    return out.when(F.contains(head, F.lit("<svg")) | F.contains(head, F.lit("<?xml")), "svg").otherwise("bin")


def first_phrase(text: Column, phrases: list[str]) -> Column:
    """The first phrase, in order, that a normalised text of three letters or more holds, or nearly holds: a stretch as long as the phrase or one longer is within one slip (phrases of up to five letters) or two. Stretches at the text's end may be shorter."""
    bare = [re.sub("[·_ -]", "", p).lower() for p in phrases]
    rows = F.array(*[F.struct(F.lit(p).alias("phrase"), F.lit(b).alias("p"), F.lit(len(b)).alias("n"), F.lit(1 if len(b) <= 5 else 2).alias("slips")) for p, b in zip(phrases, bare)])

    def held(x: Column) -> Column:
        last = F.length(text) - x["n"] + x["slips"]

        def near(i: Column) -> Column:
            more = F.substring(text, i + 1, x["n"] + 1)
            return (F.levenshtein(F.substring(text, i + 1, x["n"]), x["p"]) <= x["slips"]) | ((F.length(more) > x["n"]) & (F.levenshtein(more, x["p"]) <= x["slips"]))

        return F.contains(text, x["p"]) | ((last >= 0) & F.exists(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), near))

    return F.when(F.length(text) >= 3, F.get(F.filter(rows, held), F.lit(0))["phrase"])
