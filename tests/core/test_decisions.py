"""Fusion by literal features, bands at their edges, and rates."""

import pytest
from pyspark.sql import functions as F

from lumenforge.operators import evaluation as ev
from lumenforge.operators import fusion as fu
from lumenforge.operators import rules

COLUMNS = "name, s, d, f, hf, lap, chroma, axis, colors, share, block, center_share, f_axis, f_share, f_colors, chrome, min_side"
SCHEMA = ", ".join(f"{c} {'string' if c == 'name' else 'int' if c in ('colors', 'f_colors', 'min_side') else 'double'}" for c in COLUMNS.split(", "))
N = None
#: s, d, f, then hf, lap, chroma, axis, colors, share, block, then optional features, then the least side; expected label and detail.
CASES = [
    ("low", 0.3, 0.2, N, N, N, N, N, N, N, N, N, N, N, N, N, N, "real", "threshold=0.6951"),
    ("second-alone", 0.3, 0.12, 0.78, N, N, N, N, N, N, N, N, N, N, N, N, N, "ai", "accurate-head"),
    ("second-low", 0.39, 0.45, 0.64, 0.44, 1200.0, 0.4, 0.4, 200, 0.4, 0.32, N, N, N, N, N, N, "not-ai", "photo-evidence-hold"),
    ("second-strong", 0.5, 0.55, 0.9, 0.28, 480.0, 0.7, 0.32, 55, 0.5, 0.14, N, N, N, N, N, N, "ai", "accurate-head"),
    ("macro", 0.32, 0.28, 0.98, 0.44, 1800.0, 0.42, 0.55, 180, 0.35, 0.35, N, N, N, N, N, N, "not-ai", "photo-evidence-hold"),
    ("device", 0.48, 0.45, 0.99, 0.15, 821.0, 0.81, 0.91, 89, 0.73, 0.255, 0.89, 0.89, 0.85, 55, 0.0, N, "not-ai", "photo-evidence-hold"),
    ("not-photographic", 0.3, 0.12, 0.78, 0.22, 420.0, 0.72, 0.3, 60, 0.55, 0.15, N, N, N, N, N, N, "ai", "accurate-head"),
    ("dual-mild", 0.42, 0.72, 0.81, 0.42, 1600.0, 0.42, 0.4, 200, 0.4, 0.3, N, N, N, N, N, N, "not-ai", "dual-mild-hold"),
    ("busy", 0.4, 0.81, N, 0.42, 1400.0, 0.42, 0.4, 200, 0.4, 0.3, N, N, N, N, N, N, "not-ai", "busy-scene-hold"),
    ("kitchen", 0.423, 0.644, 0.727, 0.4, 900.0, 0.42, 0.4, 200, 0.4, 0.28, N, N, N, N, N, N, "not-ai", "dual-mild-hold"),
    ("small-blue", 0.28, 0.22, N, 0.44, 2200.0, 0.58, 0.28, 140, 0.38, 0.22, N, N, N, N, N, 180, "ai", "small-cgi-ai(side=180)"),
    ("small-circuit", 0.35, 0.25, N, 0.3, 400.0, 0.72, 0.45, 40, 0.7, 0.1, N, N, N, N, N, 200, "ai", "small-cgi-ai(side=200)"),
]


def test_literal_cases(spark):
    rows = spark.createDataFrame([c[:17] for c in CASES], SCHEMA)
    got = {r["name"]: r for r in fu.fuse(rows).collect()}
    for c in CASES:
        r = got[c[0]]
        assert (r.label == c[17] if c[17] != "not-ai" else r.label != "ai"), (c[0], r.label, r.detail)
        assert r.detail == c[18], (c[0], r.detail)
        if r.label == "ai":
            assert r.confidence >= fu.AI_FLOOR
        if r.label == "real":
            assert r.label_confidence == pytest.approx(1 - r.confidence)


def test_provenance_stops_everything(spark):
    row = spark.createDataFrame([("p", 0.2, 0.2, *[N] * 14)], SCHEMA).withColumns({"prov": F.lit(0.98), "prov_stop": F.lit(True)})
    r = fu.fuse(row).first()
    assert (r.label, r.detail, r.confidence) == ("ai", "provenance-short-circuit", 0.98)


def test_filters_on_fused_columns_stay_small(spark):
    """A filter on a column built on columns must not copy its definition over and over."""
    rows = spark.createDataFrame([c[:17] for c in CASES], SCHEMA)
    assert fu.fuse(rows).filter("label = 'ai' AND is_neon IS NOT NULL AND confidence > 0.5").count() == 5


def test_absent_features_make_every_predicate_false(spark):
    r = rules.with_rules(spark.createDataFrame([("x", 0.3, 0.2, *[N] * 14)], SCHEMA)).first()
    assert not r.feats and not any(r[p] for p in rules.PREDICATES)


def test_bands_are_inclusive(spark):
    at = [(c,) for c in (0.6951, 0.695, 0.5, 0.4099, 0.41)]
    got = [r[0] for r in spark.createDataFrame(at, "c double").select(F.expr(fu.relabel("c", "0.6951D", "0.4099D"))).collect()]
    assert got == ["ai", "uncertain", "uncertain", "real", "uncertain"]


def test_side_bumps_fall(spark):
    got = [r[0] for r in spark.createDataFrame([(s,) for s in (64, 96, 160, 256, 384, None)], "min_side int").select(F.expr(fu.side_bump())).collect()]
    assert got == [0.22, 0.16, 0.10, 0.04, 0.0, 0.0]


def test_scores_that_are_no_numbers_are_split_off(spark):
    rows = spark.createDataFrame([(0.5,), (float("nan"),), (float("inf"),), (None,)], "d double")
    good, bad = fu.valid_scores(rows, "d")
    assert good.count() == 2 and bad.count() == 2


def test_rates_of_empty_classes_and_errors(spark):
    rows = spark.createDataFrame([("ai", 0.9, False), ("ai", 0.1, False), ("ai", 0.9, True)], "truth string, confidence double, err boolean")
    r = ev.confusion(rows, err=True).first()
    assert (r.tp, r.fn, r.tn, r.fp, r.tnr) == (1, 2, 0, 0, 0.0) and r.ba == pytest.approx(1 / 6)
    none = ev.confusion(rows.filter("false")).first()
    assert (none.tp, none.ba) == (0, 0.0)


def test_nearest_rank(spark):
    rows = spark.range(1, 11).select(F.col("id").cast("double").alias("v"))
    assert tuple(ev.nearest_ranks(rows.withColumn("g", F.lit(None).cast("string")), ["g"], "v", (50, 90)).first()) == (None, 5.0, 9.0)


def test_sweep_equals_the_grid(spark):
    import random

    rng = random.Random(3)
    data = [(rng.choice(["ai", "real"]), rng.choice([0.35, 0.6, 0.94, rng.random()])) for _ in range(200)]
    rows = spark.createDataFrame(data, "truth string, confidence double")
    got = {round(r.threshold, 2): r for r in ev.sweep(rows, F.col("truth") == "ai", F.col("truth") == "real").collect()}
    assert len(got) == 60 and sum(r.picked for r in got.values()) == 1
    ai, real = [p for t, p in data if t == "ai"], [p for t, p in data if t == "real"]
    for k in range(35, 95):
        t = k / 100
        assert got[t].tpr == pytest.approx(sum(p >= t for p in ai) / len(ai)) and got[t].hard_tnr == pytest.approx(sum(p < t for p in real) / len(real))


CGI = (0.32, 900.0, 0.62, 0.35, 120, 0.4, 0.12)


def test_smooth_colourful_images(spark):
    soft = (0.36, 700.0, 0.6, 0.32, 90, 0.45, 0.18)
    data = [("boost", 0.55, 0.32, N, *CGI, N, N, N, N, N, N), ("low", 0.5, 0.28, N, *CGI, N, N, N, N, N, N), ("small", 0.4, 0.35, N, *CGI, N, N, N, N, N, 140), ("soft", 0.45, 0.38, N, *soft, N, N, N, N, N, 160)]
    got = {r["name"]: r for r in fu.fuse(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got["boost"].is_cgi and all(r.label == "ai" and r.confidence >= fu.AI_FLOOR for r in got.values())
    assert got["boost"].detail.split("|")[0] in ("cgi-spectral-boost", "neon-ai-subject") and got["small"].detail.startswith("small-cgi-ai") and got["soft"].detail.startswith(("small-nonphoto-ai", "small-cgi-ai"))


def test_gate(spark):
    """Only a decisive first head on a large photographic image goes without the second."""
    photo = (0.45, 1500.0, 0.4, 0.3, 180, 0.4, 0.3)
    data = [("decisive", 0.4, 0.88, N, *photo, N, N, N, N, N, 512), ("elevated", 0.42, 0.81, N, *photo, N, N, N, N, N, 512), ("low", 0.55, 0.12, N, *photo, N, N, N, N, N, 512), ("small", 0.4, 0.9, N, *photo, N, N, N, N, N, 200), ("drawn", 0.4, 0.9, N, *CGI, N, N, N, N, N, 512)]
    rows = rules.with_rules(spark.createDataFrame(data, SCHEMA))
    got = {r[0]: r[1] for r in rows.select("name", F.expr(rules.needs_cascade())).collect()}
    assert got == {"decisive": False, "elevated": True, "low": True, "small": True, "drawn": True}


def test_percentiles_match_a_sort(spark):
    """Nearest ranks of groups with ties, one value, nulls and negative values."""
    import random

    rng = random.Random(6)
    rows = [(g, rng.choice([None, rng.gauss(0, 30), float(rng.randint(-3, 3)), 7.25])) for g in ("a", "b", None) for _ in range(rng.randint(1, 200))] + [("one", 4.5), ("none", None)]
    got = {r[0]: tuple(r)[1:] for r in ev.nearest_ranks(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", (1, 50, 90, 100)).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        v = sorted(x for y, x in rows if y == g and x is not None)
        if v:
            want[g] = tuple(v[max(1, -(-p * len(v) // 100)) - 1] for p in (1, 50, 90, 100))
    assert got == want
