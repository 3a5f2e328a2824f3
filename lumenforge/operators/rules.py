"""Rule predicates over the pixel features of an image, as boolean columns.

A predicate is a list of bands; a band is a conjunction of bounds, written as SQL
text that Spark and the oracle both read. Predicates that others build on become
columns first, so each is computed once a row and the fusion chain stays small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("axis", "colors", "share", "center_share", "chroma", "hf", "lap", "block", "chrome", "f_axis", "f_share", "f_colors")
#: A missing optional feature counts as this, in every predicate.
DEFAULTS = {"center_share": 0.0, "block": 0.0, "chrome": 0.0, "f_axis": 0.0, "f_share": 0.0, "f_colors": 999, "axis": 0.0}

# The bounds of every band.
TOAST = "share >= 0.74 AND chroma >= 0.55 AND hf <= 0.35 AND lap >= 500 AND colors <= 120"

#: In the interface predicate alone, a missing hf counts as 1, lap and chroma as 0.
DIGITAL_UI = [
    "chrome >= 0.7",
    "axis >= 0.78 AND colors BETWEEN 1 AND 96 AND share >= 0.75",
    "axis >= 0.72 AND colors BETWEEN 1 AND 180 AND share >= 0.65 AND chroma0 >= 0.55 AND hf1 <= 0.4",
    "axis >= 0.62 AND colors BETWEEN 1 AND 48 AND share >= 0.78 AND chroma0 >= 0.65 AND hf1 <= 0.35",
    "share >= 0.74 AND colors BETWEEN 1 AND 120 AND chroma0 >= 0.55 AND hf1 <= 0.35 AND lap0 BETWEEN 500 AND 8000 AND axis BETWEEN 0.32 AND 0.72",
    "axis >= 0.6 AND colors BETWEEN 1 AND 100 AND share >= 0.68 AND chroma0 >= 0.45 AND hf1 <= 0.38 AND lap0 BETWEEN 300 AND 6000",
    "center_share >= 0.72 AND axis >= 0.38 AND colors BETWEEN 1 AND 220 AND chroma0 >= 0.45 AND hf1 <= 0.5 AND lap0 BETWEEN 55 AND 8000",
    "share >= 0.88 AND colors BETWEEN 1 AND 80 AND chroma0 >= 0.55 AND hf1 <= 0.58 AND lap0 BETWEEN 60 AND 8000 AND axis BETWEEN 0.45 AND 0.82",
    "f_axis >= 0.82 AND f_colors BETWEEN 1 AND 64 AND f_share >= 0.8",
]
FLAT_GRAPHIC = [
    "colors BETWEEN 1 AND 48 AND share >= 0.88 AND chroma >= 0.8 AND lap BETWEEN 60 AND 12000 AND hf <= 0.42",
    "axis >= 0.58 AND colors BETWEEN 1 AND 72 AND share >= 0.5 AND chroma >= 0.45 AND lap BETWEEN 80 AND 14000 AND hf <= 0.5",
]
CHART_VETO = ["colors <= 0", "block > 0.72"]
CHART = [
    "axis >= 0.55 AND colors <= 90 AND share >= 0.5 AND chroma >= 0.42 AND hf <= 0.5 AND lap BETWEEN 60 AND 18000 AND block <= 0.65",
    "axis >= 0.55 AND colors <= 220 AND share >= 0.85 AND chroma >= 0.7 AND hf <= 0.55 AND lap BETWEEN 80 AND 14000 AND block <= 0.45",
    "axis >= 0.58 AND colors <= 80 AND share >= 0.22 AND share < 0.5 AND chroma >= 0.4 AND hf <= 0.45 AND lap BETWEEN 150 AND 16000 AND block <= 0.55",
    "f_axis >= 0.7 AND f_share >= 0.55 AND axis >= 0.5 AND colors <= 100 AND chroma >= 0.42 AND hf <= 0.5 AND lap BETWEEN 80 AND 16000 AND block <= 0.55",
]
PHOTO_VETO = ["chroma >= 0.48"]
PHOTO = ["hf >= 0.38 AND lap >= 800 AND chroma <= 0.47 AND colors >= 100 AND block BETWEEN 0.2 AND 0.55"]
NEON_VETO = [
    "chrome >= 0.7",
    "center_share >= 0.72 AND share < 0.72",
    "axis >= 0.72",
    "axis >= 0.62 AND colors <= 48",
    "colors <= 40 AND share >= 0.78",
    "axis >= 0.58 AND share >= 0.68 AND colors <= 80",
    TOAST,
    "is_chart",
]
NEON = ["chroma >= 0.55 AND (colors >= 36 OR chroma >= 0.54 AND colors >= 24) AND share <= 0.55 AND hf <= 0.78 AND lap BETWEEN 80 AND 40000 AND block <= 0.62"]
CGI_VETO = ["chrome >= 0.7", "axis >= 0.78", "axis >= 0.62 AND colors <= 56 AND share >= 0.55", TOAST, "is_chart"]
CGI = ["is_neon", "colors >= 16 AND share <= 0.94 AND lap BETWEEN 60 AND 40000 AND chroma >= 0.55 AND hf <= 0.72 AND block <= 0.55 AND (share <= 0.55 OR chroma >= 0.65)"]
CAMERA_VETO = ["chrome >= 0.7", "is_neon", "is_cgi"]
CAMERA = [
    "block BETWEEN 0.18 AND 0.42 AND lap BETWEEN 600 AND 12000 AND colors >= 70 AND share <= 0.82 AND chroma < 0.9",
    "colors >= 80 AND lap >= 350 AND hf >= 0.22 AND chroma < 0.62 AND share <= 0.88 AND axis < 0.78 AND block BETWEEN 0.12 AND 0.7",
]
NON_PHOTO_CARD = ["center_share >= 0.7 AND axis >= 0.36 AND chroma >= 0.42 AND colors <= 240 AND hf <= 0.55 AND lap BETWEEN 50 AND 10000 AND block <= 0.85"]
NON_PHOTO_VETO = ["share < 0.72 AND colors >= 36 AND axis < 0.72"]
NON_PHOTO = [
    "f_axis >= 0.65 AND f_share >= 0.5 AND axis >= 0.5 AND share >= 0.5 AND chroma >= 0.5 AND colors <= 280 AND hf <= 0.65 AND lap BETWEEN 60 AND 25000",
    "share >= 0.82 AND chroma >= 0.65 AND axis >= 0.48 AND colors <= 280 AND hf <= 0.65 AND lap BETWEEN 60 AND 25000 AND block <= 0.9",
    "axis >= 0.72 AND chroma >= 0.5 AND share >= 0.5 AND colors <= 260 AND hf <= 0.6 AND lap BETWEEN 80 AND 25000",
]


def any_of(bands: list[str]) -> str:
    return "(" + " OR ".join(f"({b})" for b in bands) + ")"


def rule_levels() -> list[dict[str, str]]:
    """The predicates in order of dependency: each level's text may name columns of the levels before."""
    return [
        {"chroma0": "coalesce(chroma, 0e0)", "hf1": "coalesce(hf, 1e0)", "lap0": "coalesce(lap, 0e0)"},
        {
            "is_ui": any_of(DIGITAL_UI),
            "is_flat": any_of(FLAT_GRAPHIC),
            "is_chart": f"NOT {any_of(CHART_VETO)} AND {any_of(CHART)}",
            "is_photo": f"NOT {any_of(PHOTO_VETO)} AND {any_of(PHOTO)}",
        },
        {"is_neon": f"NOT {any_of(NEON_VETO)} AND {any_of(NEON)}"},
        {
            "is_cgi": f"NOT {any_of(CGI_VETO)} AND {any_of(CGI)}",
            "is_non_photo": f"is_ui OR is_flat OR is_chart OR colors > 0 AND ({any_of(NON_PHOTO_CARD)} OR NOT {any_of(NON_PHOTO_VETO)} AND {any_of(NON_PHOTO)})",
        },
        {"is_camera": f"is_photo OR NOT {any_of(CAMERA_VETO)} AND {any_of(CAMERA)}"},
    ]


PREDICATES = ("is_ui", "is_flat", "is_chart", "is_photo", "is_camera", "is_neon", "is_cgi", "is_non_photo")


def settled(df: DataFrame, names: list[str]) -> DataFrame:
    """The same rows, with ``names`` computed here once.

    The optimizer copies a column's definition into every filter that it pushes
    down; through columns built on columns those copies multiply. It doesn't push
    filters through a generator, and this one gives one row for each row.
    """
    return df.select(*[c for c in df.columns if c not in names], F.inline(F.array(F.struct(*names))))


def with_rules(df: DataFrame) -> DataFrame:
    """Add ``feats`` (whether features are there at all) and the eight predicates.

    Features are absent when ``colors`` is null; then every predicate is false. A
    missing optional feature takes its default inside the predicates only, and a
    missing required one makes the bands that name it false.
    """
    named = {c: F.coalesce(F.col(c), F.lit(v)) if (v := DEFAULTS.get(c)) is not None else F.col(c) for c in FEATURES}
    kept = {f"_{c}": F.col(c) for c in FEATURES}
    out = df.withColumns(kept | {"feats": F.col("colors").isNotNull()}).withColumns(named)
    for level in rule_levels():
        out = out.withColumns({k: F.coalesce(F.expr(v), F.lit(False)) if k.startswith("is_") else F.expr(v) for k, v in level.items()})
    out = out.drop(*FEATURES, "chroma0", "hf1", "lap0").withColumnsRenamed({f"_{c}": c for c in FEATURES})
    return settled(out, ["feats", *PREDICATES])


def needs_cascade(threshold_d: float = 0.88, threshold_s: float = 0.4, least_side: int = 256) -> str:
    """SQL text of the gate: run the expensive head unless the cheap one is decisive and the image looks photographic."""
    cheap = f"NOT (d >= {threshold_d} AND s <= {threshold_s})"
    return f"({cheap} OR coalesce(min_side, 4096) < {least_side} OR NOT is_photo OR is_non_photo)"
