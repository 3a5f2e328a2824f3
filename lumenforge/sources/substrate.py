"""Reference-shaped inputs, derived from the driver's tables by integer arithmetic.

Every view is written once as SQL text; where the engines spell a function
differently, the text has a placeholder (``{at}`` takes list and 1-based place).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenforge.session import table

SPARK = {"at": "element_at", "finite": "forall(e, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('infinity'))", "list": "array<double>", "size": "size"}
DUCK = {"at": "list_extract", "finite": "len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0", "list": "DOUBLE[]", "size": "len"}

#: Ranges of each feature, times 10000 (colour counts times 1), for five families of images: photo, interface, neon, chart, any.
RANGES = {
    "axis": [(2000, 6500), (5500, 9500), (2000, 7500), (5000, 8000), (0, 10000)],
    "share": [(2000, 7000), (6000, 9900), (1000, 7500), (2000, 9500), (500, 10000)],
    "center_share": [(1000, 7400), (5000, 9900), (1000, 7600), (1000, 8000), (0, 10000)],
    "chroma": [(2000, 5000), (4000, 9500), (5000, 9500), (4000, 9000), (0, 10000)],
    "hf": [(3000, 7000), (1000, 5000), (2000, 8000), (2000, 6000), (0, 10000)],
    "lap": [(4000000, 60000000), (400000, 70000000), (600000, 50000000), (500000, 60000000), (100000, 450000000)],
    "block": [(1500, 6000), (0, 4500), (0, 6500), (0, 6000), (0, 9000)],
    "f_axis": [(2000, 7000), (5000, 9500), (2000, 7000), (5000, 9000), (0, 10000)],
    "f_share": [(2000, 7000), (4000, 9500), (2000, 7000), (4000, 9000), (0, 10000)],
    "d": [(0, 10000), (2000, 10000), (0, 9500), (4000, 10000), (0, 10000)],
    "f": [(3000, 10000)] * 5,
    "s": [(0, 7000)] * 5,
}
COUNTS = {"colors": [(80, 280), (4, 200), (16, 200), (10, 230), (0, 300)], "f_colors": [(20, 200), (4, 100), (20, 200), (4, 150), (0, 300)]}


def _ranged(k: int, ranges: list[tuple[int, int]], scale: str) -> str:
    lo = "CASE fam " + " ".join(f"WHEN {i} THEN {a}" for i, (a, _) in enumerate(ranges)) + " END"
    span = "CASE fam " + " ".join(f"WHEN {i} THEN {b - a}" for i, (a, b) in enumerate(ranges)) + " END"
    return f"({lo} + floor(h{k} * ({span}) / 1000e0)){scale}"


def scored_sql(at: str, finite: str, list: str, size: str, source: str = "embeddings") -> str:  # noqa: A002
    """V3: one image a row, with truth, scores, features and sizes."""
    n = len(RANGES) + len(COUNTS)
    hashes = ", ".join(f"mod(mod(cast(floor({at}(e, {k + 1}) * 100000e0) AS bigint) * 2654435 + vec_id * 40503 + {k * 97}, 1000) + 1000, 1000) AS h{k}" for k in range(n + 1))
    fields = [f"{_ranged(k, r, ' / 10000e0')} AS {c}" if c != "f" else f"CASE WHEN mod(vec_id, 4) <> 1 THEN {_ranged(k, r, ' / 10000e0')} END AS f" for k, (c, r) in enumerate(RANGES.items())]
    fields += [f"cast({_ranged(len(RANGES) + k, r, '')} AS int) AS {c}" for k, (c, r) in enumerate(COUNTS.items())]
    sides = " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate((80, 120, 200, 240, 300, 512, 1024)))
    return f"""
SELECT vec_id AS image_id, CASE WHEN label < 5 THEN 'ai' ELSE 'real' END AS truth, concat('m', cast(mod(vec_id, 3) AS string)) AS model,
  mod(vec_id, 11) = 0 AS hard_case, mod(vec_id, 13) = 5 AS is_error, concat(CASE WHEN mod(vec_id, 5) = 2 THEN 'feed/' ELSE 'plain/' END, cast(vec_id AS string)) AS file,
  20e0 + h0 / 10e0 AS infer_ms, 5e0 + h1 / 100e0 AS prep_ms, {', '.join(fields)}, CASE WHEN h{n} >= 950 THEN 1e0 WHEN h{n} >= 900 THEN 0.7e0 ELSE 0e0 END AS chrome,
  CASE mod(h{n}, 10) {sides} END AS min_side
FROM (SELECT vec_id, label, mod(vec_id, 5) AS fam, {hashes} FROM (SELECT vec_id, label, cast(embedding AS {list}) AS e FROM {source}) t WHERE {size}(e) > {n} AND {finite}) u"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(scored_sql(**SPARK, source="{emb}"), emb=table(spark, d, "embeddings"))


SCORED_DUCK = scored_sql(**DUCK)
