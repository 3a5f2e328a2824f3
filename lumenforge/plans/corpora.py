"""Queries of corpus building over a manifest that is made of documents, and of scalar rules over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenforge.functions import scalars as sc
from lumenforge.functions import seeded
from lumenforge.operators import corpus as co
from lumenforge.session import removed, scratch, table
from lumenforge.sources import feeds, feedsource

from .catalog import query

MANIFEST = "SELECT doc_id, concat(CASE WHEN mod(doc_id, 2) = 0 THEN 'ai' ELSE 'real' END, '/', source, '/', cast(doc_id AS string), '.jpg') AS file, CASE WHEN mod(doc_id, 2) = 0 THEN 'ai' ELSE 'real' END AS label, source, {sha} AS sha256, n_chars, {size} AS bytes, cast(64 + mod(doc_id, 400) AS int) AS width, cast(90 + mod(doc_id, 37) AS int) AS height, mod(doc_id, 10) AS part FROM {docs}"
DUCK = MANIFEST.format(sha="sha256(text)", size="octet_length(encode(text))", docs="documents")
SPLITS = {"holdout": "part = 0", "train": "part IN (1, 2)", "failed": "part = 3", "pending": "part = 4"}
_REGISTRY = "CASE WHEN part = 0 THEN 'holdout' WHEN part IN (1, 2) THEN 'train' WHEN part = 3 THEN 'failed' END"


def manifest(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(MANIFEST.format(sha="sha2(text, 256)", size="octet_length(text)", docs="{docs}"), docs=table(spark, d, "documents"))


def running_number(rows: DataFrame, key: str, order: str, out: str, width: int = 1 << 16) -> DataFrame:
    """Number each key's rows from 0 in an order of whole numbers, bucket by bucket."""
    held = rows.withColumn("_b", F.floor(F.col(order) / F.lit(width)))
    sizes = held.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_kb")).agg(F.count("*").alias("_n"))
    sizes = sizes.withColumn("_base", F.sum("_n").over(W.partitionBy("_k").orderBy("_kb")) - F.col("_n"))
    inside = held.withColumn("_in", F.row_number().over(W.partitionBy(key, "_b").orderBy(order)) - 1)
    joined = inside.join(sizes, F.col(key).eqNullSafe(F.col("_k")) & F.col("_b").eqNullSafe(F.col("_kb")))
    return joined.withColumn(out, F.col("_base") + F.col("_in")).drop("_b", "_k", "_kb", "_n", "_base", "_in")


@query("u04_first_by_hash", f"SELECT sha256, arg_min(file, doc_id) AS file, min(doc_id) AS doc_id FROM ({DUCK}) WHERE sha256 IS NOT NULL GROUP BY sha256")
def first_by_hash(spark: SparkSession, d: str) -> DataFrame:
    """Of equal contents the first stays; null contents have no digest and are left out."""
    return co.first_by_hash(manifest(spark, d).select("sha256", "doc_id", "file").filter("sha256 IS NOT NULL"), "sha256", "doc_id")


@query("f19_s24_accepted_images", f"SELECT label, count(*)::BIGINT AS n, sum(bytes)::BIGINT AS bytes FROM (SELECT sha256, arg_min(label, doc_id) AS label, min(bytes) AS bytes FROM ({DUCK}) WHERE bytes BETWEEN 1000 AND 25000000 AND least(width, height) >= 96 GROUP BY sha256) GROUP BY label")
def accepted_images(spark: SparkSession, d: str) -> DataFrame:
    """size bounds, least side, then new digests alone."""
    ok = manifest(spark, d).filter(sc.accepted_image("bytes", "width", "height")).select("sha256", "doc_id", "label", "bytes")
    return co.first_by_hash(ok, "sha256", "doc_id").groupBy("label").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


@query("j03_existing_files", f"SELECT m.doc_id, m.file FROM ({DUCK}) m WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = m.doc_id)")
def existing_files(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose file is there (here: is labelled)."""
    return manifest(spark, d).join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", "file")


@query("j04_u03_gate_out_of_train", f"SELECT m.doc_id FROM ({DUCK}) m WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = m.doc_id AND l.quality = 1)")
def gate_out_of_train(spark: SparkSession, d: str) -> DataFrame:
    return co.exclude(manifest(spark, d).select("doc_id"), "doc_id", table(spark, d, "labels").filter("quality = 1").select("doc_id"))


@query("j05_j07_u03_fresh_ids", f"SELECT doc_id FROM ({DUCK}) WHERE part >= 5")
def fresh_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids in none of four sets, by one anti-join."""
    m = manifest(spark, d).select("doc_id", "part")
    return co.exclude(m.select("doc_id"), "doc_id", *[m.filter(where).select("doc_id") for where in SPLITS.values()])


@query("j06_u05_to_process", "SELECT source AS model, n FROM (SELECT source, count(*)::BIGINT AS n, min(doc_id) AS first FROM documents WHERE source IS NOT NULL GROUP BY source) WHERE first % 3 <> 0 OR first % 2 = 1")
def to_process(spark: SparkSession, d: str) -> DataFrame:
    """Models that are new (first % 3 is 1), or failed (odd); done ones don't come again."""
    models = table(spark, d, "documents").filter("source IS NOT NULL").groupBy(F.col("source").alias("model")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
    status = F.when(F.col("first") % 2 == 1, "failed").when(F.col("first") % 3 == 0, "ok").otherwise("retry")
    registry = models.filter("first % 3 <> 1").select("model", status.alias("status"))
    return co.to_process(models, registry, "model").select("model", "n")


@query("j11_exclude_substrings", f"SELECT doc_id, file FROM ({DUCK}) WHERE NOT (contains(file, '7.jpg') OR contains(file, 'real/s1'))")
def exclude_substrings(spark: SparkSession, d: str) -> DataFrame:
    return co.matching_none(manifest(spark, d).select("doc_id", "file"), "file", ["7.jpg", "real/s1"])


@query("j12_prompt_lookup", "SELECT d.doc_id, coalesce(l.quality, -1)::INT AS quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def prompt_lookup(spark: SparkSession, d: str) -> DataFrame:
    out = manifest(spark, d).select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("quality", F.lit(-1)).cast("int").alias("quality"), "toxic")


@query("j01_j02_result_lookup", "SELECT c_mktsegment AS segment, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def result_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Rows to the table that describes them, by id; the optimizer broadcasts a side that its statistics call small."""
    joined = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("j08_engines_providers", "SELECT e.engine, p.provider FROM (VALUES ('cascade'), ('dual'), ('stub')) e(engine) CROSS JOIN (VALUES ('auto'), ('wasm'), ('webgpu')) p(provider)")
def engines_providers(spark: SparkSession, d: str) -> DataFrame:
    """The product of two fixed lists, written as arrays."""
    lists = spark.range(1).select(F.explode(F.array(*map(F.lit, ("cascade", "dual", "stub")))).alias("engine"))
    return lists.select("engine", F.explode(F.array(*map(F.lit, ("auto", "wasm", "webgpu")))).alias("provider"))


@query("u01_u02_unions", "SELECT origin, count(*)::BIGINT AS n, count(turn)::BIGINT AS turns FROM (SELECT 'host' AS origin, NULL AS turn FROM documents UNION ALL SELECT 'browser', turn FROM conversations) GROUP BY origin")
def unions(spark: SparkSession, d: str) -> DataFrame:
    """Results of two harnesses one below the other; columns that one lacks are null."""
    host = manifest(spark, d).select(F.lit("host").alias("origin"))
    browser = table(spark, d, "conversations").select(F.lit("browser").alias("origin"), "turn")
    return browser.unionByName(host, allowMissingColumns=True).groupBy("origin").agg(F.count("*").alias("n"), F.count("turn").alias("turns"))


@query("u05_upsert", "SELECT doc_id, coalesce(l.quality, m.quality) AS quality, m.source FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN -1 END::INT AS quality, source FROM documents) m FULL OUTER JOIN (SELECT doc_id, quality FROM labels) l USING (doc_id)")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    base = manifest(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.lit(-1)).cast("int").alias("quality"), "source")
    return co.upsert(base, table(spark, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id").select("doc_id", "quality", "source")


@query("u06_s15_append_absent", f"SELECT label, count(*)::BIGINT AS n FROM (SELECT label, file FROM ({DUCK}) WHERE part < 6 UNION ALL SELECT label, file FROM ({DUCK}) WHERE part >= 6) GROUP BY label")
def append_absent(spark: SparkSession, d: str) -> DataFrame:
    """Of what arrives, only files that aren't there yet."""
    m = manifest(spark, d).select("label", "file", "part")
    base, rows = m.filter("part < 6").drop("part"), m.filter("part >= 3").drop("part")
    return co.append_absent(base, rows, "file").groupBy("label").agg(F.count("*").alias("n"))


@query("u07_tag_union", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat(source, ',holdout') ELSE concat('holdout,', source) END AS tags FROM documents WHERE source IS NOT NULL AND source <> 'holdout'")
def tag_union(spark: SparkSession, d: str) -> DataFrame:
    m = manifest(spark, d).filter("source IS NOT NULL AND source <> 'holdout'")
    have = F.when(F.col("doc_id") % 3 == 0, F.array("source")).otherwise(F.array(F.lit("holdout"), "source"))
    return m.select("doc_id", F.array_join(F.array_union(have, F.array(F.lit("holdout"), "source")), ",").alias("tags"))


@query("w07_stratified_split", f"SELECT doc_id, label, CASE WHEN r <= CASE WHEN n > 4 THEN greatest(1, round_even(n * 0.1e0, 0)::INT) ELSE 0 END THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256(doc_id::VARCHAR), doc_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM ({DUCK}))")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return co.stratified(manifest(spark, d).select("doc_id", "label"), "label", F.sha2(F.col("doc_id").cast("string"), 256), "doc_id", 0.1)


@query("w05_s12_ordered_distinct", "SELECT page_id, match, min(pos)::INT AS pos FROM (SELECT page_id, lower(unnest(m)) AS match, generate_subscripts(m, 1) - 1 AS pos FROM (SELECT page_id, regexp_extract_all(html, '[A-Za-z]{7,}') AS m FROM pages)) GROUP BY page_id, match")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    """What a pattern finds in a page, each once, in order of first sight."""
    return co.ordered_distinct(table(spark, d, "pages"), "page_id", "html", "[A-Za-z]{7,}")


@query("o06_random_cap", "SELECT doc_id FROM documents ORDER BY sha256(concat('cap', doc_id::VARCHAR)), doc_id LIMIT 100")
def random_cap(spark: SparkSession, d: str) -> DataFrame:
    return co.capped(manifest(spark, d).select("doc_id"), F.sha2(F.concat(F.lit("cap"), F.col("doc_id").cast("string")), 256), "doc_id", 100)


def _duck_bits(seed: str, n: str) -> str:
    """The n-th 32 bits in the oracle's words: the same definition in wide whole numbers."""
    m = "4294967296::HUGEINT"
    t = f"((({seed})::HUGEINT + (({n})::HUGEINT + 1) * {seeded.STEP}) % {m})::BIGINT"
    r = f"((xor({t}, {t} >> 15)::HUGEINT * ({t} | {seeded.ODD})) % {m})::BIGINT"
    q = f"xor({r}, (({r}::HUGEINT + xor({r}, {r} >> 7)::HUGEINT * ({r} | {seeded.LATE})) % {m})::BIGINT)"
    return f"xor({q}, {q} >> 14)"


def _duck_walk(x: str, size: str, bits: str, seed: int, order: str) -> str:
    low, high = f"(1::BIGINT << ({bits} - {bits} // 2)) - 1", f"(1::BIGINT << ({bits} // 2)) - 1"
    left, right = f"(v >> ({bits} - {bits} // 2))", f"(v & ({low}))"
    odd = f"(({left} << ({bits} - {bits} // 2)) | xor({right}, {_duck_bits(f'{seed} + 7919 * (k + 1)', left)} & ({low})))"
    even = f"((xor({left}, {_duck_bits(f'{seed} + 7919 * (k + 1)', right)} & ({high})) << ({bits} - {bits} // 2)) | {right})"
    turn = f"list_reduce(list_prepend({{v}}, {order}), lambda v, k: CASE WHEN k % 2 = 1 THEN {odd} ELSE {even} END)"
    again = f"CASE WHEN i = 0 OR w >= {size} THEN {turn.format(v='w')} ELSE w END"
    return f"list_reduce(list_prepend({x}, range(0, {seeded.TURNS + 1})::BIGINT[]), lambda w, i: {again})"


_SIZED = "SELECT vec_id, (max(vec_id) OVER ()) + 1 AS size, greatest(2, length(ltrim(bin(max(vec_id) OVER ()), '0'))) AS bits FROM embeddings WHERE vec_id >= 0"


@query("s01_s13_t16_feed_source", """
WITH e AS (SELECT event_id // 100 AS page, event_id, event_type FROM events),
run AS (SELECT max(page) AS last FROM (SELECT page, row_number() OVER (ORDER BY page) - 1 AS k FROM (SELECT DISTINCT page FROM e)) WHERE page = k)
SELECT page, (row_number() OVER (PARTITION BY page ORDER BY event_id) - 1)::INT AS place, event_id::VARCHAR AS id, event_type AS src, 1 AS attempts FROM e, run WHERE page <= last""")
def feed_source(spark: SparkSession, d: str) -> DataFrame:
    """Events land as pages of 100, many pages to a file, and are fetched, page by page, by the data source; a scan stops before the first page that is missing."""
    at = scratch(spark, "feed")
    e = table(spark, d, "events").select(F.expr("event_id div 100").alias("page"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("src"), "event_id")
    feedsource.land_bundles(e, at, "event_id")
    spark.dataSource.register(feedsource.FeedSource)
    rows = spark.read.format("feed").options(path=at, transport="lumenforge.sources.feedsource:Bundled", pagesPerPartition=2 * feedsource.BUNDLE).load()
    out = rows.select("page", "place", "id", "src", "attempts").checkpoint()
    removed(spark, at)
    return out


@query("f30_o06_seeded_shuffle", f"""
SELECT vec_id, {_duck_bits('2024', 'vec_id')} AS drawn, place, {_duck_walk('place', 'size', 'bits', 77, '[5, 4, 3, 2, 1, 0]::BIGINT[]')} AS back, place < 100 AS kept
FROM (SELECT vec_id, size, bits, {_duck_walk('vec_id', 'size', 'bits', 77, '[0, 1, 2, 3, 4, 5]::BIGINT[]')} AS place FROM ({_SIZED}))""")
def seeded_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """A row's value by its number, its place after a shuffle and back, and a cap of 100 rows without a sort."""
    rows = table(spark, d, "embeddings").filter("vec_id >= 0").select("vec_id")
    size = (rows.agg(F.max("vec_id")).first()[0] or 0) + 1
    out = rows.select("vec_id", seeded.bits32(F.lit(2024), F.col("vec_id")).alias("drawn"), seeded.shuffled_place(F.col("vec_id"), size, 77).alias("place"))
    return out.select("vec_id", "drawn", "place", seeded.row_at(F.col("place"), size, 77).alias("back"), (F.col("place") < 100).alias("kept"))


@query("o07_s10_paged_rows", "SELECT label, count(*)::BIGINT AS n, count(DISTINCT doc_id)::BIGINT AS ids FROM (SELECT DISTINCT doc_id, doc_id % 2 AS label FROM documents, (SELECT greatest(1, (SELECT max(doc_id) + 1 FROM documents) - 100) * k // 4 AS a FROM range(5) o(k)) WHERE doc_id >= a AND doc_id < a + 100) GROUP BY label")
def paged_rows(spark: SparkSession, d: str) -> DataFrame:
    """A sample of pages of 100 at evenly spaced offsets of the whole table; where pages overlap, rows count once. Landed pages are filtered, not fetched."""
    docs = table(spark, d, "documents")
    inside = F.lit(False)
    for a in co.spaced_offsets(0, (docs.agg(F.max("doc_id")).first()[0] or 0) + 1, 5):
        inside = inside | ((F.col("doc_id") >= a) & (F.col("doc_id") < a + 100))
    rows = docs.filter(inside).dropDuplicates(["doc_id"])
    return rows.groupBy((F.col("doc_id") % 2).alias("label")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"))


@query("o08_round_robin", "SELECT doc_id, ((doc_id + 1) % 5 + 5) % 5 AS prompt FROM documents")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return manifest(spark, d).select("doc_id", F.pmod(F.col("doc_id") + 1, F.lit(5)).alias("prompt"))


@query("a10_s23_manifest_counts", f"SELECT label, source AS domain, count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS chars FROM ({DUCK}) GROUP BY ALL")
def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    return manifest(spark, d).groupBy("label", F.col("source").alias("domain")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("a11_prefix_count", f"SELECT count(*) FILTER (starts_with(file, 'ai/'))::BIGINT AS ai, count(*) FILTER (starts_with(file, 'real/src1'))::BIGINT AS real1 FROM ({DUCK})")
def prefix_count(spark: SparkSession, d: str) -> DataFrame:
    m = manifest(spark, d)
    return m.agg(F.count_if(F.startswith("file", F.lit("ai/"))).alias("ai"), F.count_if(F.startswith("file", F.lit("real/src1"))).alias("real1"))


@query("a20_registry_counts", f"SELECT coalesce({_REGISTRY}, 'none') AS split, count(*)::BIGINT AS n FROM ({DUCK}) GROUP BY 1")
def registry_counts(spark: SparkSession, d: str) -> DataFrame:
    return manifest(spark, d).groupBy(F.coalesce(F.expr(_REGISTRY), F.lit("none")).alias("split")).agg(F.count("*").alias("n"))


@query("f15_f16_names", "SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9._-]+', '__', 'g') AS slug, substr(regexp_replace(lower(url), '[^a-z0-9._-]+', '-', 'g'), 1, 48) AS domain FROM pages")
def names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", sc.slugify("url").alias("slug"), sc.domain_name("url", 48).alias("domain"))


@query("f17_s14_vector_models", "SELECT p_partkey, contains(lower(p_name), 'vector') OR contains(lower(p_type), 'vector') AS is_vector FROM part")
def vector_models(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", sc.is_vector_model("p_name", "p_type").alias("is_vector"))


_VALUES = "CASE p_size % 5 WHEN 0 THEN {l}'512', '2K'{r} WHEN 1 THEN {l}'2K', '1K'{r} WHEN 2 THEN {l}'4K', '8K'{r} WHEN 3 THEN {l}'2K', '4K'{r} ELSE {l}'1K'{r} END"


@query("f18_parameter_choice", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '512' WHEN 1 THEN '1K' WHEN 2 THEN '4K' WHEN 3 THEN '2K' ELSE '1K' END AS resolution FROM part")
def parameter_choice(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.expr(_VALUES.format(l="array(", r=")")).alias("v"))
    return rows.select("p_partkey", sc.first_acceptable("v", ["1K", "512", "2K"], else_first=True).alias("resolution"))


_REQUEST = "SELECT event_id, mod(event_id, 900) - 200 AS top, mod(event_id, 900) - 200 + mod(event_id, 7) * 20 AS bottom, mod(event_id, 11) * 90 - 100 AS x0, mod(event_id, 11) * 90 AS x1, mod(event_id, 13) <> 0 AS attached, CASE WHEN mod(event_id, 5) = 0 THEN NULL ELSE cast(mod(event_id, 97) AS int) END AS w, cast(mod(event_id, 89) AS int) AS h, CASE mod(event_id, 17) WHEN 3 THEN 'data:image/svg+xml' WHEN 4 THEN '' WHEN 5 THEN 'https://x/random?id=1' WHEN 6 THEN 'https://x/a?UUID=9' ELSE concat('https://x/', cast(user_id AS string), '.jpg') END AS src FROM {ev}"
_REQUEST_DUCK = _REQUEST.format(ev="events")


def requests(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_REQUEST, ev=table(spark, d, "events"))


@query("f29_o04_viewport_priority", f"SELECT event_id, CASE WHEN NOT attached THEN -1e9 WHEN bottom > 0 AND top < 480 AND x1 > 0 AND x0 < 800 AND bottom > top THEN 1e6 - abs((top + bottom) / 2e0 - 240) WHEN top >= 480 THEN 5e5 - least(5e5, top - 480) ELSE 25e4 - least(25e4, greatest(0, -bottom)) END::DOUBLE AS priority FROM ({_REQUEST_DUCK})")
def viewport_priority(spark: SparkSession, d: str) -> DataFrame:
    p = sc.viewport_priority("top", "bottom", "x0", "x1", F.lit(480), F.lit(800), F.col("attached"))
    return requests(spark, d).select("event_id", p.cast("double").alias("priority"))


@query("f20_s02_eligible_cache_mode", f"SELECT event_id, attached AND src <> '' AND NOT starts_with(src, 'data:image/svg') AND (coalesce(w, 0) <= 0 OR w >= 48) AND (coalesce(h, 0) <= 0 OR h >= 48) AS eligible, CASE WHEN regexp_matches(src, 'thispersondoesnotexist|random|uuid=|timestamp=|nocache', 'i') THEN 'no-cache' ELSE 'force-cache' END AS cache FROM ({_REQUEST_DUCK})")
def eligible(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).select("event_id", sc.eligible("src", "w", "h", F.col("attached")).alias("eligible"), sc.cache_mode("src").alias("cache"))


_MESSAGE = "CASE mod(event_id, 6) WHEN 0 THEN 'WASM trap' WHEN 1 THEN 'Network timeout' WHEN 2 THEN 'Model missing from cache' WHEN 3 THEN 'decode failed' WHEN 4 THEN 'Request ABORTED' ELSE NULL END"


@query("f21_f28_f31_messages", "SELECT event_id, mod(event_id, 6) IN (0, 2, 4) AS fatal, CASE event_type WHEN 'click' THEN 'blank' ELSE 'blur' END AS conceal, mod(event_id, 4) = 1 AS answers FROM events")
def messages(spark: SparkSession, d: str) -> DataFrame:
    """fatal messages, modes with a default, and whether an answer's kind and id are those of its request."""
    mode = F.when(F.col("event_type") == "click", "blank").otherwise(F.col("event_type"))
    answers = (F.lit("result") == F.when(F.col("event_id") % 2 == 1, "result").otherwise("status")) & (F.col("event_id") % 4 == 1)
    return table(spark, d, "events").select("event_id", sc.fatal_message(F.expr(_MESSAGE)).alias("fatal"), sc.conceal_mode(mode).alias("conceal"), answers.alias("answers"))


@query("f27_options_migration", "SELECT event_id, CASE WHEN r IS NULL AND (a IS NULL OR a = 0.65) THEN 0.6951 ELSE coalesce(a, 0.6951) END::DOUBLE AS ai, CASE WHEN r IS NULL AND (a IS NULL OR a = 0.65) THEN 0.4099 ELSE coalesce(r, 0.4099) END::DOUBLE AS real FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 0.65e0 WHEN 1 THEN 0.8e0 END AS a, CASE WHEN event_id % 4 = 0 THEN 0.3e0 END AS r FROM events)")
def options_migration(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "events").selectExpr("event_id", "CASE event_id % 3 WHEN 0 THEN 0.65D WHEN 1 THEN 0.8D END AS a", "CASE WHEN event_id % 4 = 0 THEN 0.3D END AS r")
    ai, real = sc.migrated_thresholds("a", "r")
    return old.select("event_id", ai.alias("ai"), real.alias("real"))


_BYTES = "CASE mod(doc_id, 8) WHEN 0 THEN {x}('FFD8FFE000104A46') WHEN 1 THEN {x}('89504E470D0A1A0A') WHEN 2 THEN {x}('524946460000000057454250') WHEN 3 THEN {x}('474946383961') WHEN 4 THEN {x}('3C73766720') WHEN 5 THEN {x}('89504E47') WHEN 6 THEN {x}('52494646000000004A4B4C4D') ELSE {x}('00') END"


@query("s25_s26_s27_f26_bytes", "SELECT doc_id, ['image/jpeg', 'image/png', 'image/webp', 'image/gif', 'application/octet-stream', 'application/octet-stream', 'application/octet-stream', 'application/octet-stream'][doc_id % 8 + 1] AS mime, ['jpg', 'png', 'webp', 'bin', 'svg', 'bin', 'webp', 'bin'][doc_id % 8 + 1] AS ext, to_base64(b) AS b64, sha256(b) AS sha256, octet_length(b)::INT AS n FROM (SELECT doc_id, " + _BYTES.format(x="unhex") + " AS b FROM documents)")
def byte_rules(spark: SparkSession, d: str) -> DataFrame:
    """Magic bytes to type and extension, base64 both ways, digest."""
    rows = table(spark, d, "documents").selectExpr("doc_id", _BYTES.format(x="unhex") + " AS b")
    back = F.unbase64(F.base64("b"))
    return rows.select("doc_id", sc.sniff_mime("b").alias("mime"), sc.sniff_extension("b").alias("ext"), F.base64("b").alias("b64"), F.sha2(back, 256).alias("sha256"), F.octet_length(back).alias("n"))


@query("s08_s09_labels_from_paths", f"SELECT file, 'x' AS extension, split_part(file, '/', 1) AS label, CASE WHEN starts_with(file, 'ai') THEN 1 ELSE 0 END AS y, regexp_replace(lower(split_part(file, '/', 2)), '[^a-z0-9._-]+', '-', 'g') AS domain, contains(file, '9.') AS hard FROM ({DUCK}) WHERE file IS NOT NULL".replace("'x' AS extension", "'jpg' AS extension"))
def labels_from_paths(spark: SparkSession, d: str) -> DataFrame:
    from lumenforge.sources.indexes import from_paths

    return from_paths(manifest(spark, d).filter("file IS NOT NULL").select("file"), "file", hard="9.")


@query("s11_until_short_page", "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents), h AS (SELECT *, k // 10 AS page FROM r WHERE k % 23 <> 17), n AS (SELECT source, page, count(*) AS n FROM h GROUP BY ALL), c AS (SELECT source, page, sum((n < 10)::INT) OVER (PARTITION BY source ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS short, row_number() OVER (PARTITION BY source ORDER BY page) - 1 AS run FROM n) SELECT h.doc_id, h.source FROM h JOIN c ON h.page = c.page AND h.source IS NOT DISTINCT FROM c.source WHERE coalesce(short, 0) = 0 AND run = c.page")
def until_short_page(spark: SparkSession, d: str) -> DataFrame:
    """A source's documents in pages of 10, some of which lack a row: pages up to the first short one."""
    rows = table(spark, d, "documents").select("doc_id", "source")
    numbered = running_number(rows, "source", "doc_id", "k").filter("k % 23 <> 17")
    return feeds.until_short(numbered, "source", "k", 10).select("doc_id", "source")


@query("s13_cursor_feed", "WITH e AS (SELECT user_id % 6 AS feed, event_id // 40 AS number, CASE WHEN event_id // 40 % 50 > 44 AND user_id % 6 < 2 THEN NULL WHEN event_id // 40 > 90 AND user_id % 6 = 3 THEN 7 ELSE event_id % 5000 END AS id FROM events WHERE user_id IS NOT NULL), p AS (SELECT feed, number, list(id) FILTER (id IS NOT NULL) AS ids FROM e GROUP BY ALL), f AS (SELECT feed, min(number) AS number, id FROM e WHERE id IS NOT NULL AND id % 7 <> 3 GROUP BY feed, id), m AS (SELECT p.feed, p.number, row_number() OVER (PARTITION BY p.feed ORDER BY p.number) AS pos, coalesce(len(ids), 0) AS size, (SELECT count(*) FROM f WHERE f.feed = p.feed AND f.number = p.number) AS fresh FROM p), g AS (SELECT *, pos - coalesce(max(CASE WHEN size > 0 THEN pos END) OVER w, 0) AS empty, pos - coalesce(max(CASE WHEN fresh > 0 THEN pos END) OVER w, 0) AS stale FROM m WINDOW w AS (PARTITION BY feed ORDER BY pos)), s AS (SELECT feed, min(number) AS stop FROM g WHERE empty >= 5 OR stale >= 8 GROUP BY feed) SELECT f.feed, f.number, f.id FROM f LEFT JOIN s USING (feed) WHERE stop IS NULL OR f.number <= stop")
def cursor_feed(spark: SparkSession, d: str) -> DataFrame:
    """Pages of six feeds, some of which run empty or stale; ids that are 3 modulo 7 are known."""
    e = table(spark, d, "events").filter("user_id IS NOT NULL").selectExpr("user_id % 6 AS feed", "event_id DIV 40 AS number", "event_id")
    gone = (F.col("number") % 50 > 44) & (F.col("feed") < 2)
    id_ = F.when(~gone, F.when((F.col("number") > 90) & (F.col("feed") == 3), F.lit(7)).otherwise(F.col("event_id") % 5000))
    pages = e.withColumn("id", id_).groupBy("feed", "number").agg(F.collect_list("id").alias("ids"))
    known = spark.range(5000).filter("id % 7 = 3")
    return feeds.until_dry(pages, known)


@query("s17_verified_artifacts", "SELECT doc_id AS name, CASE WHEN doc_id % 5 <> 4 THEN octet_length(encode(coalesce(text, '')))::INT END AS n_bytes, CASE WHEN doc_id % 5 = 4 THEN 'missing' WHEN doc_id % 3 = 1 THEN concat('error: digest ', sha256(coalesce(text, ''))) ELSE 'ready' END AS status FROM documents")
def verified_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """Contents against a manifest's digests, some of which are wrong, and some contents are missing."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    digest = F.when(F.col("name") % 3 == 1, F.sha2(F.lit("other").cast("binary"), 256)).otherwise(F.sha2("content", 256))
    return feeds.verified(docs.filter("name % 5 <> 4"), docs.select("name", digest.alias("sha256")))
