"""Queries over scored images: predicates, gate, fusion, labels and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenforge.operators import evaluation as ev
from lumenforge.operators import fusion as fu
from lumenforge.operators import rules
from lumenforge.sources.substrate import SCORED_DUCK, scored

from .catalog import query


def _levels(source: str, levels: list[dict[str, str]]) -> str:
    """Nested selects that add each level's columns, null predicates as false."""
    sql = source
    for k, level in enumerate(levels):
        fields = ", ".join((f"coalesce({v}, false) AS {c}" if c.startswith("is_") else f"{v} AS {c}") for c, v in level.items())
        sql = f"SELECT *, {fields} FROM ({sql}) l{k}"
    return sql


_KEPT = ", ".join(f"{c} AS raw_{c}" for c in rules.FEATURES)
_REPLACED = ", ".join(f"coalesce({c}, {v}) AS {c}" for c, v in rules.DEFAULTS.items())
_RULES = _levels(f"SELECT * REPLACE ({_REPLACED}), {_KEPT}, colors IS NOT NULL AS feats FROM ({SCORED_DUCK}) v", rules.rule_levels())


def _fused(base: str = "0.6951e0", extra: str = "0.5e0 AS prov, false AS prov_stop") -> str:
    return _levels(f"SELECT *, {extra}, {base} AS base, 0.4099e0 AS real_max FROM ({_RULES}) r", fu.fusion_levels())


_FUSED = _fused()
_SCORED = f"SELECT image_id, truth, model, file, hard_case, is_error, infer_ms, prep_ms, d, f, s, confidence, label FROM ({_FUSED}) x"
_COUNTS = "count(*) FILTER (truth = 'ai' AND confidence >= {c})::BIGINT AS tp, count(*) FILTER (truth <> 'ai' AND confidence < {c})::BIGINT AS tn, count(*) FILTER (truth <> 'ai' AND confidence >= {c})::BIGINT AS fp, count(*) FILTER (truth = 'ai' AND confidence < {c})::BIGINT AS fn"


def _rates(sql: str) -> str:
    """tp, tn, fp, fn with rates; rounded."""
    return f"SELECT *, round(tpr, 9) AS tpr_, round(tnr, 9) AS tnr_, round((tpr + tnr) / 2, 9) AS ba FROM (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS tpr, coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS tnr FROM ({sql}) c) q"


def fused(spark: SparkSession, d: str) -> DataFrame:
    return fu.fuse(scored(spark, d))


def _rounded(df: DataFrame, *cols: str, n: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


@query("fuse_and_score", _rates(f"SELECT * FROM (SELECT 'eval' AS point, 0.65::DOUBLE AS threshold, {_COUNTS.format(c=0.65)} FROM ({_SCORED}) UNION ALL SELECT 'product', 0.6951::DOUBLE, {_COUNTS.format(c=0.6951)} FROM ({_SCORED}))").replace("SELECT *, round(tpr, 9) AS tpr_, round(tnr, 9) AS tnr_,", "SELECT point, threshold, tp, tn, fp, fn, round(tpr, 9) AS tpr, round(tnr, 9) AS tnr,"))
def fuse_and_score(spark: SparkSession, d: str) -> DataFrame:
    """Predicates, gate, fusion and label, then rates at both operating points in one pass."""
    return _rounded(ev.at_points(fused(spark, d), {"eval": fu.EVAL_CUT, "product": fu.AI_FLOOR}), "tpr", "tnr", "ba")


@query("d01p_d08p_rules", f"SELECT image_id, {', '.join(rules.PREDICATES)} FROM ({_RULES}) r")
def rule_predicates(spark: SparkSession, d: str) -> DataFrame:
    return rules.with_rules(scored(spark, d)).select("image_id", *rules.PREDICATES)


@query("g01_gate", f"SELECT truth, coalesce({rules.needs_cascade()}, true) AS needs, count(*)::BIGINT AS n FROM ({_RULES}) r GROUP BY ALL")
def gate(spark: SparkSession, d: str) -> DataFrame:
    needs = F.coalesce(F.expr(rules.needs_cascade()), F.lit(True)).alias("needs")
    return rules.with_rules(scored(spark, d)).groupBy("truth", needs).agg(F.count("*").alias("n"))


@query("g02_g03_fusion", f"SELECT image_id, branch, round(confidence, 9) AS confidence, label, round(label_confidence, 9) AS label_confidence, detail FROM ({_FUSED}) x")
def fusion_rows(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fused(spark, d).select("image_id", "branch", "confidence", "label", "label_confidence", "detail"), "confidence", "label_confidence")


@query("g02_branches", f"SELECT branch, label, count(*)::BIGINT AS n FROM ({_FUSED}) x GROUP BY ALL")
def fusion_branches(spark: SparkSession, d: str) -> DataFrame:
    return fused(spark, d).groupBy("branch", "label").agg(F.count("*").alias("n"))


@query("g06_no_second_head", f"SELECT label, count(*)::BIGINT AS n, round(sum(confidence), 6) AS total FROM ({_levels(f'SELECT * REPLACE (NULL::DOUBLE AS f, NULL::INT AS min_side), 0.5e0 AS prov, false AS prov_stop, 0.6951e0 AS base, 0.4099e0 AS real_max FROM ({_RULES}) r', fu.fusion_levels())}) x GROUP BY label")
def stub_only(spark: SparkSession, d: str) -> DataFrame:
    """The pipeline without heads beyond the first, and without sizes."""
    bare = scored(spark, d).withColumns({"f": F.lit(None).cast("double"), "min_side": F.lit(None).cast("int")})
    return fu.fuse(bare).groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 6).alias("total"))


@query("g07_j10_modes", _rates(f"SELECT mode, {_COUNTS.format(c=0.65)} FROM (SELECT 'first' AS mode, truth, confidence FROM ({_levels(f'SELECT * REPLACE (NULL::DOUBLE AS f, NULL::INT AS min_side), 0.5e0 AS prov, false AS prov_stop, 0.65e0 AS base, 0.4099e0 AS real_max FROM ({_RULES}) r', fu.fusion_levels())}) UNION ALL SELECT 'both', truth, confidence FROM ({_levels(f'SELECT * REPLACE (NULL::INT AS min_side), 0.5e0 AS prov, false AS prov_stop, 0.65e0 AS base, 0.4099e0 AS real_max FROM ({_RULES}) r', fu.fusion_levels())})) m GROUP BY mode").replace("SELECT *, round(tpr, 9) AS tpr_, round(tnr, 9) AS tnr_,", "SELECT mode, tp, tn, fp, fn, round(tpr, 9) AS tpr, round(tnr, 9) AS tnr,"))
def modes(spark: SparkSession, d: str) -> DataFrame:
    """Every image in both modes of the evaluation harness, which fuses at its own cut and knows no sizes."""
    rows = scored(spark, d).withColumn("min_side", F.lit(None).cast("int"))
    both = rows.withColumn("mode", F.explode(F.array(F.lit("first"), F.lit("both"))))
    both = both.withColumn("f", F.when(F.col("mode") == "both", F.col("f")))
    return _rounded(ev.confusion(fu.fuse(both, base=fu.EVAL_CUT), ["mode"]), "tpr", "tnr", "ba")


@query("g04_f04_relabel", f"SELECT label AS label_fused, {fu.relabel('confidence', '0.8e0', '0.3e0')} AS label_final, count(*)::BIGINT AS n, count(*) FILTER (confidence >= 0.65)::BIGINT AS ai_at_eval FROM ({_SCORED}) GROUP BY ALL")
def relabelled(spark: SparkSession, d: str) -> DataFrame:
    """Labels at a user's thresholds, without the bump; the fused label stays beside them."""
    out = fused(spark, d).withColumnRenamed("label", "label_fused").withColumn("label_final", F.expr(fu.relabel("confidence", "0.8D", "0.3D")))
    return out.groupBy("label_fused", "label_final").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.65).alias("ai_at_eval"))


_SUMMARY = f"SELECT model, {_COUNTS.format(c=0.65)}, count(*)::BIGINT AS n, count(*) FILTER (hard_case AND confidence >= 0.65)::BIGINT AS hard_fp, count(*) FILTER (hard_case)::BIGINT AS hard_n, count(*) FILTER (contains(file, 'feed/') AND confidence >= 0.65)::BIGINT AS subset_tp, count(*) FILTER (contains(file, 'feed/'))::BIGINT AS subset_n, coalesce(avg(infer_ms + prep_ms), 0) AS a, coalesce(sum(infer_ms + prep_ms), 0) AS t FROM ({_SCORED}) GROUP BY model"
_RANKED = f"SELECT *, (tpr + tnr) / 2 AS ba_, row_number() OVER (ORDER BY (tpr + tnr) / 2 DESC, a, model)::INT AS rank FROM (SELECT *, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS tpr, coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS tnr FROM ({_SUMMARY}) c) q"
_RANKED_OUT = "model, tp, tn, fp, fn, n, hard_fp, hard_n, subset_tp, subset_n, round(tpr, 9) AS tpr, round(tnr, 9) AS tnr, round(ba_, 9) AS ba, round(a, 6) AS avg_ms, round(t, 4) AS total_ms, round(subset_tp::DOUBLE / nullif(subset_n, 0), 9) AS subset_tpr, rank"


@query("a04_w01_o01_model_ranking", f"SELECT {_RANKED_OUT} FROM ({_RANKED}) z")
def model_ranking(spark: SparkSession, d: str) -> DataFrame:
    """A04, A05, W01, O01."""
    out = ev.ranking(ev.summary(fused(spark, d), ["model"]), "model")
    return _rounded(_rounded(out, "tpr", "tnr", "ba", "subset_tpr"), "avg_ms", n=6).withColumn("total_ms", F.round("total_ms", 4))


@query("o02_best_picks", f"SELECT 'fastest' AS pick, (SELECT model FROM ({_RANKED}) ORDER BY a, model LIMIT 1) AS model UNION ALL SELECT 'hard', (SELECT model FROM ({_RANKED}) ORDER BY hard_fp, ba_ DESC, model LIMIT 1)")
def best_picks(spark: SparkSession, d: str) -> DataFrame:
    out = ev.rates(ev.summary(fused(spark, d), ["model"]))
    return out.agg(F.min_by("model", F.struct("avg_ms", "model")).alias("fastest"), F.min_by("model", F.struct("hard_fp", -F.col("ba"), "model")).alias("hard")).select(F.expr("stack(2, 'fastest', fastest, 'hard', hard) AS (pick, model)"))


@query("a06_errors_are_wrong", "SELECT tp, tn, fp, fn, round((coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) + coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0)) / 2, 9) AS ba FROM (SELECT count(*) FILTER (truth = 'ai' AND NOT is_error AND confidence >= 0.65)::BIGINT AS tp, count(*) FILTER (truth = 'real' AND NOT is_error AND confidence < 0.65)::BIGINT AS tn, count(*) FILTER (truth = 'real' AND (is_error OR confidence >= 0.65))::BIGINT AS fp, count(*) FILTER (truth = 'ai' AND (is_error OR confidence < 0.65))::BIGINT AS fn FROM (" + _SCORED + "))")
def errors_are_wrong(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(ev.confusion(fused(spark, d).withColumn("err", F.col("is_error")), err=True).select("tp", "tn", "fp", "fn", "ba"), "ba")


_TIMED = "SELECT user_id % 4 AS lane, event_type, value AS total_ms, value * 0.25e0 AS first_ms, value * 0.5e0 AS second_ms, event_id % 3 = 0 AS ran_second, event_id % 7 <> 0 AS has_timing FROM events"


@query("a07_a08_timing", f"SELECT lane, round(avg(total_ms), 6) AS avg_total_ms, quantile_disc(total_ms, 0.5) AS p50_total_ms, quantile_disc(total_ms, 0.9) AS p90_total_ms, count(*)::BIGINT AS n, count(*) FILTER (has_timing AND ran_second)::BIGINT AS second_n, round(coalesce(avg(first_ms) FILTER (has_timing), 0), 6) AS avg_first_ms, round(coalesce(avg(second_ms) FILTER (has_timing AND ran_second), 0), 6) AS avg_second_ms FROM ({_TIMED}) GROUP BY lane")
def timing(spark: SparkSession, d: str) -> DataFrame:
    from lumenforge.session import table

    rows = spark.sql(_TIMED.replace("FROM events", "FROM {ev}"), ev=table(spark, d, "events"))
    return _rounded(ev.timing(rows, ["lane"]), "avg_total_ms", "avg_first_ms", "avg_second_ms", n=6)


@query("a09_model_recall", f"SELECT model, count(*)::BIGINT AS n, count(*) FILTER (confidence >= 0.65)::BIGINT AS hit FROM ({_SCORED}) WHERE truth = 'ai' AND model <> 'm1' GROUP BY model")
def model_recall(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose model isn't known stay out (here: those of m1)."""
    rows = fused(spark, d).withColumn("model", F.when(F.col("model") != "m1", F.col("model")))
    return rows.filter("truth = 'ai' AND model IS NOT NULL").groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= 0.65).alias("hit"))


@query("a12_m02_vector_rates", "SELECT round(coalesce(avg((p >= 0.65)::INT) FILTER (truth = 'ai'), 0), 9) AS tpr, round(coalesce(avg((p < 0.65)::INT) FILTER (truth <> 'ai'), 0), 9) AS tnr, round(sum(p), 6) AS total, count(*)::BIGINT AS n FROM (SELECT truth, 1 / (1 + exp(-least(30, greatest(-30, (d - 0.5e0) * 80e0)))) AS p FROM (" + SCORED_DUCK + "))")
def vector_rates(spark: SparkSession, d: str) -> DataFrame:
    """Logits are clipped to ±30, then a stable sigmoid."""
    z = F.least(F.lit(30.0), F.greatest(F.lit(-30.0), (F.col("d") - 0.5) * 80.0))
    p, ai = ev.sigmoid(z), F.col("truth") == "ai"
    rows = scored(spark, d).select("truth", p.alias("p"))
    mean = lambda hit, when: F.round(F.coalesce(F.avg(F.when(when, hit.cast("int"))), F.lit(0.0)), 9)
    return rows.agg(mean(F.col("p") >= 0.65, ai).alias("tpr"), mean(F.col("p") < 0.65, ~ai).alias("tnr"), F.round(F.sum("p"), 6).alias("total"), F.count("*").alias("n"))


_GRID = f"SELECT t.i / 100e0 AS threshold, count(*) FILTER (truth = 'ai' AND confidence >= t.i / 100e0)::DOUBLE / nullif(count(*) FILTER (truth = 'ai'), 0) AS tpr, count(*) FILTER (truth <> 'ai' AND hard_case AND confidence < t.i / 100e0)::DOUBLE / nullif(count(*) FILTER (truth <> 'ai' AND hard_case), 0) AS tnr FROM ({_SCORED}) s CROSS JOIN (SELECT unnest(range(35, 95)) AS i) t GROUP BY t.i"


@query("a13_j09_threshold_sweep", f"SELECT threshold, round(tpr, 9) AS tpr, round(hard_tnr, 9) AS hard_tnr, ok, round(gate_ba, 9) AS gate_ba, round(score, 6) AS score, row_number() OVER (ORDER BY ok DESC, round(score, 9) DESC, threshold) = 1 AS picked FROM (SELECT *, hard_tnr >= 0.95 AND tpr >= 0.75 AS ok, 0.5 * (tpr + hard_tnr) AS gate_ba, 100 * tpr + 20 * (tpr + hard_tnr) + 20 * hard_tnr AS score FROM (SELECT threshold, coalesce(tpr, 0) AS tpr, coalesce(tnr, 1) AS hard_tnr FROM ({_GRID})))")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    ai = F.col("truth") == "ai"
    return _rounded(ev.sweep(fused(spark, d), ai, ~ai & F.col("hard_case")), "tpr", "hard_tnr", "gate_ba").withColumn("score", F.round("score", 6))


_ROUNDS = f"SELECT model, n, tpr, tnr, (tpr + tnr) / 2 AS ba, a AS avg_ms, 100 * tpr + 40 * (tpr + tnr) / 2 + 20 * tnr - 0.05 * a AS score, tpr >= 0.5 AND tnr >= 0.3 AND (tpr + tnr) / 2 >= 0.4 AND a <= 130 AND n >= 40 AS pass FROM ({_RANKED})"


@query("a14_a15_a19_rounds", f"SELECT model, n, round(ba, 9) AS ba, round(score, 6) AS score, pass, row_number() OVER (ORDER BY score DESC, model) = 1 AS best FROM ({_ROUNDS})")
def rounds(spark: SparkSession, d: str) -> DataFrame:
    """Composite score, gates of which all must hold, and the best round, the first among equals."""
    out = ev.summary(fused(spark, d), ["model"])
    out = out.withColumn("score", 100.0 * F.col("tpr") + 40.0 * F.col("ba") + 20.0 * F.col("tnr") - 0.05 * F.col("avg_ms"))
    out = out.withColumn("pass", (F.col("tpr") >= 0.5) & (F.col("tnr") >= 0.3) & (F.col("ba") >= 0.4) & (F.col("avg_ms") <= 130.0) & (F.col("n") >= 40))
    best = F.row_number().over(W.orderBy(F.desc("score"), "model")) == 1
    return out.select("model", "n", F.round("ba", 9).alias("ba"), F.round("score", 6).alias("score"), "pass", best.alias("best"))


@query("a18_best_epoch", f"SELECT model, arg_max(image_id, (d, -image_id)) AS best_epoch, max(d) AS best_ba FROM ({SCORED_DUCK}) GROUP BY model")
def best_epoch(spark: SparkSession, d: str) -> DataFrame:
    """The running best of a measure, the first that reached it."""
    return scored(spark, d).groupBy("model").agg(F.max_by("image_id", F.struct("d", -F.col("image_id"))).alias("best_epoch"), F.max("d").alias("best_ba"))


_BALANCED = "SELECT image_id, truth, hard_case FROM ((SELECT image_id, truth, hard_case FROM ({s}) WHERE truth = 'ai' ORDER BY image_id LIMIT 20) UNION ALL (SELECT image_id, truth, hard_case FROM ({s}) WHERE truth = 'real' ORDER BY {o} image_id LIMIT 20))"


@query("w02_o05_balanced_head", _BALANCED.format(s=SCORED_DUCK, o=""))
def balanced_head(spark: SparkSession, d: str) -> DataFrame:
    return ev.balanced_head(scored(spark, d).select("image_id", "truth", "hard_case"), 40)


@query("w03_hard_cases_first", _BALANCED.format(s=SCORED_DUCK, o="hard_case DESC,"))
def hard_cases_first(spark: SparkSession, d: str) -> DataFrame:
    return ev.balanced_head(scored(spark, d).select("image_id", "truth", "hard_case"), 40, hard="hard_case")


@query("f03_side_bump", f"SELECT image_id, min_side, {fu.side_bump()} AS bump FROM ({SCORED_DUCK})")
def side_bump(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("image_id", "min_side", F.expr(fu.side_bump()).alias("bump"))


@query("f01_f02_calibrate", f"SELECT image_id, round({fu.calibrate(fu.unit('d * 1.6e0 - 0.3e0'))}, 9) AS calibrated FROM ({SCORED_DUCK})")
def calibrated(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("image_id", F.round(F.expr(fu.calibrate(fu.unit("d * 1.6e0 - 0.3e0"))), 9).alias("calibrated"))


@query("f22_f23_refine_percent", f"SELECT image_id, NOT is_error AND f IS NULL AND confidence < 0.6951 AS refine, CASE WHEN label = 'uncertain' THEN floor(confidence * 100 + 1e-9) ELSE floor(confidence * 100 + 0.5) END::INT AS percent FROM ({_SCORED})")
def refine_percent(spark: SparkSession, d: str) -> DataFrame:
    """F22, F23."""
    percent = F.when(F.col("label") == "uncertain", F.floor(F.col("confidence") * 100 + 1e-9)).otherwise(F.floor(F.col("confidence") * 100 + 0.5))
    refine = ~F.col("is_error") & F.col("f").isNull() & (F.col("confidence") < fu.AI_FLOOR)
    return fused(spark, d).select("image_id", refine.alias("refine"), percent.cast("int").alias("percent"))


_TIERS = "concat('provenance:0.500|spectral:', {s}, '|visual:', {d}, '[ep=', model, ' side=', coalesce(cast(min_side AS string), '?'), ']', CASE WHEN f IS NULL THEN '' ELSE concat('|accurate:', {f}) END)"
_THREE = {c: f"cast(cast(cast({c} AS decimal(18,6)) AS decimal(18,3)) AS string)" for c in "dfs"}


@query("f24_f25_tier_strings", f"SELECT image_id, tiers, regexp_extract(tiers, 'ep=([a-z0-9-]+)', 1) AS ep, regexp_extract(tiers, 'side=([0-9]+)', 1) AS side FROM (SELECT image_id, {_TIERS.format(**_THREE)} AS tiers FROM ({SCORED_DUCK}))")
def tier_strings(spark: SparkSession, d: str) -> DataFrame:
    """the string of tiers from an array of structs, and tags taken out of it again."""
    three = lambda c: F.col(c).cast("decimal(18,6)").cast("decimal(18,3)").cast("string")
    tier = lambda name, score, detail=None: F.struct(F.lit(name).alias("tier"), score.alias("score"), (detail if detail is not None else F.lit(None).cast("string")).alias("detail"))
    visual = F.concat(F.lit("ep="), "model", F.lit(" side="), F.coalesce(F.col("min_side").cast("string"), F.lit("?")))
    tiers = F.array(tier("provenance", F.lit("0.500")), tier("spectral", three("s")), tier("visual", three("d"), visual), tier("accurate", three("f")))
    text = F.array_join(F.transform(F.filter(tiers, lambda t: t["score"].isNotNull()), lambda t: F.concat(t["tier"], F.lit(":"), t["score"], F.when(t["detail"].isNotNull(), F.concat(F.lit("["), t["detail"], F.lit("]"))).otherwise(""))), "|")
    return scored(spark, d).select("image_id", text.alias("tiers")).select("image_id", "tiers", F.regexp_extract("tiers", "ep=([a-z0-9-]+)", 1).alias("ep"), F.regexp_extract("tiers", "side=([0-9]+)", 1).alias("side"))
