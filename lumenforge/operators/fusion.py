"""Fusion of the signals of an image into one calibrated score and a label.

The decision list is data: ordered branches with a condition, a confidence and
the floor that the label is held against, all SQL text over columns. The first
branch whose condition holds wins; three later passes then lift scores that would
call an image real without photographic evidence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rules import settled, with_rules

# Fixed values.
AI_FLOOR, REAL_CEILING, EVAL_CUT, HOLD_CAP, MOST_FLOOR, SMALL_SIDE, UNKNOWN_SIDE = 0.6951, 0.4099, 0.65, 0.69, 0.97, 224, 4096
SIDE_BUMPS = ((384, 0.0), (256, 0.04), (160, 0.10), (96, 0.16))
SMALLEST_BUMP = 0.22


@dataclass(frozen=True)
class Branch:
    name: str
    when: str
    confidence: str
    floor: str = "ai_floor"
    detail: str | None = None


def fixed2(x: str) -> str:
    """Two decimals, half up."""
    return f"cast(cast(cast({x} AS decimal(18,6)) AS decimal(18,2)) AS string)"


_OTHER_LOW = "(f IS NULL OR f < base)"
_SMALL = f"small AND d < 0.92 AND {_OTHER_LOW}"
_HOLD = "least(baseline, 0.69e0)"
_SIDE = "coalesce(cast(min_side AS string), 'undefined')"

BRANCHES = [
    Branch("provenance-short-circuit", "prov_stop", "prov"),
    Branch("small-cgi-ai", f"{_SMALL} AND feats AND (is_neon OR is_cgi)", "greatest(base, least(0.95e0, 0.7e0 + 0.2e0 * peak))", "base", f"concat('small-cgi-ai(side=', {_SIDE}, ')')"),
    Branch("small-nonphoto-ai", f"{_SMALL} AND feats AND NOT is_photo AND NOT is_non_photo AND peak >= 0.28 AND chroma >= 0.55 AND hf <= 0.5", "greatest(base, least(0.93e0, greatest(0.72e0, peak + 0.2e0)))", "base", f"concat('small-nonphoto-ai(side=', {_SIDE}, ')')"),
    Branch("small-source-hold", _SMALL, f"CASE WHEN {_HOLD} <= real_max THEN least(0.69e0, real_max + 0.02e0) ELSE {_HOLD} END", detail=f"concat('small-source-hold(side=', {_SIDE}, ',thr=', {fixed2('ai_floor')}, ')')"),
    Branch("photo-evidence-hold", "feats AND NOT small AND d < 0.55 AND s < 0.55 AND is_camera AND NOT is_neon AND NOT is_cgi", _HOLD),
    Branch("digital-graphic-hold", "feats AND is_non_photo", f"CASE WHEN {_HOLD} <= real_max THEN least(0.69e0, real_max + 0.05e0) ELSE {_HOLD} END", detail=f"concat('digital-graphic-hold(axis=', {fixed2('axis')}, ',colors=', cast(colors AS string), ',flat=', {fixed2('chroma')}, ',share=', {fixed2('share')}, ')')"),
    Branch("neon-ai-subject", f"feats AND is_neon AND NOT is_photo AND d < 0.92 AND {_OTHER_LOW}", "greatest(base, least(0.95e0, greatest(0.72e0, peak)))", "base"),
    Branch("dual-mild-hold", "d >= 0.6 AND d < 0.88 AND f >= 0.55 AND f < 0.88 AND feats AND is_photo AND NOT is_cgi AND chroma < 0.54", _HOLD),
    Branch("busy-scene-hold", "feats AND is_photo AND lap >= 900 AND d >= 0.6 AND d < 0.9 AND (f IS NULL OR f < 0.88) AND NOT is_cgi AND chroma < 0.54", _HOLD),
    Branch("distilled-near-threshold", "d >= 0.88 AND s <= 0.4 AND NOT is_non_photo", "greatest(d, ai_floor)"),
    Branch("photo-evidence-hold", "feats AND NOT small AND f >= 0.92 AND d < 0.4 AND s < 0.4 AND is_camera", _HOLD),
    Branch("accurate-head", "f >= base AND d < 0.88 AND NOT is_non_photo AND NOT is_camera", "greatest(f, base)", "base"),
    Branch("accurate-near-floor", "f >= 0.58 AND f < base AND d < 0.88 AND feats AND NOT is_camera AND NOT is_non_photo", "base", "base"),
    Branch("forensics-flatness-band", "feats AND f >= 0.88 AND d >= 0.3 AND lap >= 580 AND chroma BETWEEN 0.34 AND 0.7 AND NOT is_non_photo", "greatest(f, ai_floor)"),
    Branch("distilled-forensics-flatness", "feats AND d >= 0.62 AND f >= 0.88 AND chroma >= 0.74 AND lap >= 700 AND NOT is_non_photo", "greatest(0.7e0, ai_floor)"),
    Branch("forensics-high-flat-texture", "feats AND f >= 0.88 AND d >= 0.4 AND lap >= 800 AND chroma BETWEEN 0.6 AND 0.72 AND s <= 0.38 AND NOT is_non_photo", "greatest(f, ai_floor)"),
    Branch("forensics-ambiguous-distilled", "feats AND d >= 0.5 AND d < 0.6 AND f >= 0.88 AND f >= d + 0.25e0 AND lap >= 600 AND chroma <= 0.58 AND NOT is_non_photo", "greatest(f, ai_floor)"),
    Branch("cgi-spectral-boost", f"feats AND is_cgi AND NOT is_non_photo AND d < 0.92 AND {_OTHER_LOW}", "greatest(base, least(0.95e0, 0.7e0 + 0.2e0 * greatest(s, d)))", "base"),
    Branch("baseline", "true", "baseline", detail=f"CASE WHEN bump > 0 THEN concat('threshold=', {fixed2('ai_floor')}, '(+', {fixed2('bump')}, ' small-src)') ELSE concat('threshold=', cast(ai_floor AS string)) END"),
]


def case(pairs: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {otherwise} END"


def side_bump(side: str = "min_side") -> str:
    return case([(f"coalesce({side}, {UNKNOWN_SIDE}) >= {n}", f"{b}e0") for n, b in SIDE_BUMPS], f"{SMALLEST_BUMP}e0")


def calibrate(x: str) -> str:
    return f"(0.5e0 + tanh(({x} - 0.5e0) * 2.1e0) / 2e0)"


def unit(x: str) -> str:
    """Clamp to [0, 1]. Non-finite scores are the caller's to reject, see ``valid_scores``."""
    return f"least(1e0, greatest(0e0, {x}))"


def fusion_levels() -> list[dict[str, str]]:
    at = [(f"branch = {k}", b) for k, b in enumerate(BRANCHES)]
    lift = case([("NOT (feats AND conf1 <= real_max AND NOT is_photo)", "CASE WHEN small AND conf1 <= real_max THEN 4 ELSE 0 END"), ("is_non_photo", "1"), ("is_neon OR is_cgi", "2")], "3")
    return [
        {"bump": side_bump(), "small": f"coalesce(min_side, {UNKNOWN_SIDE}) < {SMALL_SIDE}", "peak": "greatest(s, d, coalesce(f, 0e0))", "baseline": calibrate(unit("0.78e0 * d + 0.22e0 * s"))},
        {"ai_floor": f"least({MOST_FLOOR}e0, base + bump)"},
        {"branch": case([(f"coalesce({b.when}, false)", str(k)) for k, b in enumerate(BRANCHES)])},
        {
            "conf0": unit(case([(w, b.confidence) for w, b in at])),
            "floor0": case([("branch IN (" + ", ".join(str(k) for k, b in enumerate(BRANCHES) if b.floor == "base") + ")", "base")], "ai_floor"),
            "detail0": case([(w, b.detail or f"'{b.name}'") for w, b in at]),
        },
        {"rescued": "branch > 0 AND feats AND NOT is_photo AND (is_neon OR is_cgi) AND conf0 < base AND branch <> " + str([b.name for b in BRANCHES].index("digital-graphic-hold"))},
        {"conf1": "CASE WHEN rescued THEN greatest(base, least(0.95e0, greatest(conf0, 0.72e0))) ELSE conf0 END"},
        {"lift": f"CASE WHEN branch = 0 THEN 0 ELSE {lift} END"},
        {
            "confidence": case([("lift = 1", "least(0.69e0, greatest(real_max + 0.05e0, conf1 + 0.12e0))"), ("lift = 2", "greatest(base, least(0.95e0, greatest(conf1, 0.72e0)))"), ("lift IN (3, 4)", "least(0.69e0, greatest(real_max + 0.05e0, conf1 + 0.08e0))")], "conf1"),
            "label_floor": "CASE WHEN rescued OR lift = 2 THEN base ELSE floor0 END",
            "detail": "concat(detail0, CASE WHEN rescued THEN '|cgi-floor' ELSE '' END, " + case([("lift = 1", "'|ui-no-real'"), ("lift = 2", "'|stock-ai-floor'"), ("lift = 3", "'|nonphoto-no-real'"), ("lift = 4", "'|small-no-real'")], "''") + ")",
        },
        {"label": case([("confidence >= label_floor", "'ai'"), ("confidence <= real_max", "'real'")], "'uncertain'")},
        {"label_confidence": "CASE WHEN label = 'real' THEN 1e0 - confidence ELSE confidence END"},
    ]


WORKING = ("bump", "small", "peak", "baseline", "ai_floor", "conf0", "floor0", "detail0", "rescued", "conf1", "lift")


def valid_scores(df: DataFrame, *cols: str) -> tuple[DataFrame, DataFrame]:
    """Split off rows whose scores aren't finite numbers; comparisons with NaN would call them AI."""
    bad = F.lit(False)
    for c in cols:
        bad = bad | F.coalesce(F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf"))), F.lit(False))
    return df.filter(~bad), df.filter(bad)


def fuse(df: DataFrame, base: float = AI_FLOOR, real_max: float = REAL_CEILING) -> DataFrame:
    """df: d, s, f (nullable), min_side (nullable), features (nullable), and optionally prov, prov_stop, base, real_max.

    Adds the predicates, branch, confidence, label_floor, detail, label and
    label_confidence. Narrow.
    """
    given = {"prov": F.lit(0.5), "prov_stop": F.lit(False), "base": F.lit(base), "real_max": F.lit(real_max)}
    out = df.withColumns({k: v for k, v in given.items() if k not in df.columns})
    out = with_rules(out)
    since: list[str] = []
    for level in fusion_levels():
        out = out.withColumns({k: F.expr(v) for k, v in level.items()})
        since += level
        if {"branch", "conf1", "confidence"} & {*level}:
            out, since = settled(out, since), []
    return out.drop(*WORKING)


def relabel(confidence: str, ai_floor: str, real_max: str) -> str:
    """Label at new thresholds; no bump is applied."""
    return case([(f"{confidence} >= {ai_floor}", "'ai'"), (f"{confidence} <= {real_max}", "'real'")], "'uncertain'")
