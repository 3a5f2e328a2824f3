"""Queries of the live flow over the events table, as replays in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.session import table
from lumenforge.streaming import live, slots

from .catalog import query

_JOB = "SELECT user_id AS id, event_id AS seq, value * 1e4 AS priority, event_type = 'error' OR mod(event_id, 97) = 0 AS bypass FROM {ev} WHERE user_id IS NOT NULL"
_DUCK_JOB = _JOB.format(ev="events")
_MERGED = f"SELECT id, arg_max(priority, seq) AS priority, bool_or(bypass) AS bypass, max(seq) AS seq FROM ({_DUCK_JOB}) GROUP BY id"


def jobs(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_JOB, ev=table(spark, d, "events"))


@query("t01_t02_queue_merge", f"SELECT id, round(priority, 6) AS priority, bypass, seq FROM ({_MERGED})")
def queue_merge(spark: SparkSession, d: str) -> DataFrame:
    return live.merged_queue(jobs(spark, d)).withColumn("priority", F.round("priority", 6))


@query("t03_pump", f"SELECT id FROM (SELECT *, max(priority) OVER () AS best FROM (SELECT * FROM ({_MERGED}) ORDER BY priority DESC, id LIMIT 8)) WHERE best < 900000 OR priority >= 900000")
def pump(spark: SparkSession, d: str) -> DataFrame:
    return live.pump(live.merged_queue(jobs(spark, d))).select("id")


#: A page's events: of ten ids some are asked for, at priorities in and out of sight, checked, done or failed, in any order.
_PAGE = "SELECT user_id AS owner, event_id AS seq, CASE WHEN mod(event_id * 31, 16) < 9 THEN 'job' WHEN mod(event_id * 31, 16) < 11 THEN 'check' WHEN mod(event_id * 31, 16) < 15 THEN 'done' ELSE 'failed' END AS kind, concat('i', cast(mod(mod(event_id * 7919, 1009), 23) AS string)) AS id, CASE WHEN mod(event_id * 13, 7) < 2 THEN 1e6 ELSE 5e5 END - mod(event_id * 101, 997) AS priority, mod(event_id, 5) = 2 AS bypass FROM {ev} WHERE user_id IS NOT NULL"


def _page_sql() -> str:
    """One event of every owner a step; lists are what a page holds."""
    mine, other = "list_filter(queue, lambda j: j.id = e.id)", "list_filter(queue, lambda j: j.id <> e.id)"
    job = "struct_pack(id := {i}, priority := {p}, bypass := {b}, put := {a})"
    old = lambda name, none: f"CASE WHEN len({mine}) > 0 THEN ({mine})[1].{name} ELSE {none} END"
    at_work = "len(list_filter(flight, lambda j: j.id = e.id)) > 0"
    me = "(list_filter(flight, lambda j: j.id = e.id))[1]"
    way = f"e.kind = 'check' AND {at_work} AND {me}.priority < 900000 AND len(list_filter({other}, lambda j: j.priority >= 900000)) > 0"
    ended = f"e.kind IN ('done', 'failed') AND {at_work}"
    asked = job.format(i="e.id", p="e.priority::DOUBLE", b=f"(e.bypass OR {old('bypass', 'false')})", a=old("put", "e.seq"))
    back = job.format(i="e.id", p=old("priority", f"{me}.priority"), b=f"({me}.bypass OR {old('bypass', 'false')})", a=old("put", "e.seq"))
    turn = "len(list_filter(queue, lambda j: j.priority > x.priority OR (j.priority = x.priority AND j.put < x.put)))"
    kind = "STRUCT(id VARCHAR, priority DOUBLE, bypass BOOLEAN, put BIGINT)[]"
    return f"""
WITH RECURSIVE ev AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY seq) AS k FROM ({_PAGE.format(ev='events')})),
step AS (
  SELECT owner, 0::BIGINT AS k, NULL::BIGINT AS seq, []::{kind} AS queue, []::{kind} AS flight, []::VARCHAR[] AS finished, NULL::VARCHAR AS started, NULL::VARCHAR AS inferring, NULL::VARCHAR AS yielded FROM (SELECT DISTINCT owner FROM ev)
  UNION ALL
  SELECT owner, k, seq, CASE WHEN NOT room THEN queue WHEN pick IS NULL THEN []::{kind} ELSE list_filter(queue, lambda x: x.priority < pick.priority OR (x.priority = pick.priority AND x.put > pick.put)) END,
    CASE WHEN pick IS NULL THEN flight ELSE list_append(flight, pick) END, finished, pick.id,
    (list_filter(list_transform((CASE WHEN pick IS NULL THEN flight ELSE list_append(flight, pick) END)[1:6], lambda x: x.id), lambda i: NOT list_contains(slot_before, i) OR coalesce(i = yielded, false)))[1], yielded
  FROM (
    SELECT *, len(flight) < 8 AS room, CASE WHEN len(flight) < 8 THEN (list_sort(list_transform(list_filter(queue, lambda x: NOT list_contains(list_transform(flight, lambda j: j.id), x.id) AND (x.bypass OR NOT list_contains(finished, x.id))), lambda x: struct_pack(p := -x.priority, put := x.put, x := x))))[1].x END AS pick
    FROM (
      SELECT owner, e.k, e.seq, list_transform(flight[1:6], lambda j: j.id) AS slot_before,
        CASE WHEN e.kind = 'job' THEN list_append({other}, {asked}) WHEN {way} THEN list_append({other}, {back}) ELSE queue END AS queue,
        CASE WHEN {ended} OR ({way}) THEN list_filter(flight, lambda j: j.id <> e.id) ELSE flight END AS flight,
        CASE WHEN e.kind = 'done' AND {at_work} AND NOT list_contains(finished, e.id) THEN list_append(finished, e.id) ELSE finished END AS finished,
        CASE WHEN {way} THEN e.id END AS yielded
      FROM step JOIN ev e USING (owner) WHERE e.k = step.k + 1
    )
  )
)
SELECT owner, seq, started, inferring, yielded, len(queue)::INT AS waiting, len(flight)::INT AS in_flight FROM step WHERE k > 0"""


@query("t02_t03_t04_t05_slots", _page_sql())
def page_slots(spark: SparkSession, d: str) -> DataFrame:
    """What starts, infers and gives way, event by event."""
    return slots.replayed(spark.sql(_PAGE, ev=table(spark, d, "events"))).drop("expired")


_ASKED = "SELECT user_id AS owner, event_id AS seq, concat(event_type, '|', cast(mod(event_id, 13) AS string)) AS item, CASE WHEN mod(event_id, 10) <> 7 THEN mod(event_id * 37, 1000) / 1000e0 END AS confidence FROM {ev} WHERE user_id IS NOT NULL"


@query("t06_t07_result_cache", f"SELECT owner, seq, item, hit, coalesce(p, 0.5)::DOUBLE AS confidence, CASE WHEN p IS NULL THEN 'error' WHEN p >= 0.6951 THEN 'ai' WHEN p <= 0.4099 THEN 'real' ELSE 'uncertain' END AS label FROM (SELECT owner, seq, item, coalesce(n > 0, false) AS hit, CASE WHEN n > 0 THEN f ELSE confidence END AS p FROM (SELECT *, count(confidence) OVER w AS n, first(confidence IGNORE NULLS) OVER w AS f FROM ({_ASKED.format(ev='events')}) WINDOW w AS (PARTITION BY owner, item ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))")
def result_cache(spark: SparkSession, d: str) -> DataFrame:
    """Items of an owner are fewer than a cache's entries, so none is let go; hits are labelled at the current thresholds."""
    return live.cached_batch(spark.sql(_ASKED, ev=table(spark, d, "events")))


_SHARED = "SELECT mod(user_id, 16) AS owner, event_id AS seq, concat('i', cast(mod(event_id * 7919, 997) AS string)) AS item, CASE WHEN mod(event_id, 10) <> 7 THEN mod(event_id * 37, 1000) / 1000e0 END AS confidence FROM {ev} WHERE user_id IS NOT NULL"


@query("t06_fifo_limit", f"""
WITH RECURSIVE ev AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY seq) AS k FROM ({_SHARED.format(ev='events')})),
step AS (
  SELECT owner, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::VARCHAR AS item, []::VARCHAR[] AS items, []::DOUBLE[] AS held, false AS hit, NULL::DOUBLE AS p FROM (SELECT DISTINCT owner FROM ev)
  UNION ALL
  SELECT owner, k, seq, item, CASE WHEN len(items) > 400 THEN items[2:] ELSE items END, CASE WHEN len(items) > 400 THEN held[2:] ELSE held END, hit, p
  FROM (
    SELECT owner, e.k, e.seq, e.item, list_contains(items, e.item) AS hit,
      CASE WHEN list_contains(items, e.item) THEN held[list_position(items, e.item)] ELSE e.confidence END AS p,
      CASE WHEN list_contains(items, e.item) OR e.confidence IS NULL THEN items ELSE list_append(items, e.item) END AS items,
      CASE WHEN list_contains(items, e.item) OR e.confidence IS NULL THEN held ELSE list_append(held, e.confidence::DOUBLE) END AS held
    FROM step JOIN ev e USING (owner) WHERE e.k = step.k + 1
  )
)
SELECT owner, seq, item, hit, coalesce(p, 0.5)::DOUBLE AS confidence, CASE WHEN p IS NULL THEN 'error' WHEN p >= 0.6951 THEN 'ai' WHEN p <= 0.4099 THEN 'real' ELSE 'uncertain' END AS label FROM step WHERE k > 0""")
def fifo_limit(spark: SparkSession, d: str) -> DataFrame:
    """Owners with more items than a cache holds; first in, first out."""
    return live.cached_replay(spark.sql(_SHARED, ev=table(spark, d, "events")))


_FIRST = "SELECT cast(event_id AS string) AS id, CASE WHEN mod(event_id, 10) <> 3 THEN mod(event_id * 37, 1000) / 1000e0 END AS confidence FROM {ev}"
_REFINED = "SELECT cast(event_id AS string) AS id, CASE WHEN mod(event_id, 6) = 0 THEN mod(event_id * 53, 1000) / 1000e0 END AS confidence FROM {ev} WHERE mod(event_id, 3) = 0"


@query("t08_t09_two_phases", f"SELECT id, arg_max(confidence, phase) AS confidence, max(phase)::INT AS phase FROM (SELECT *, 1 AS phase FROM ({_FIRST.format(ev='events')}) UNION ALL SELECT *, 2 FROM ({_REFINED.format(ev='events')})) WHERE confidence IS NOT NULL GROUP BY id")
def two_phases(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return live.latest_results(spark.sql(_FIRST, ev=e), spark.sql(_REFINED, ev=e))


@query("t10_pending_deadline", "SELECT event_id, user_id, coalesce(epoch_us(next) - epoch_us(ts) > 2500000, true) AS timed_out FROM (SELECT event_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)")
def pending_deadline(spark: SparkSession, d: str) -> DataFrame:
    """T10 in replay: an event is answered by its user's next one, if that comes within the deadline."""
    rows = table(spark, d, "events").select("event_id", "user_id", "ts")
    out = live.beside(rows, "user_id", ["ts", "event_id"], "ts", F.date_trunc("day", F.col("ts")), "next", after=True)
    gap = F.timestamp_diff("MICROSECOND", F.col("ts"), F.col("next"))
    return out.select("event_id", "user_id", F.coalesce(gap > live.PENDING_MS * 1000, F.lit(True)).alias("timed_out"))


_SRC = "SELECT user_id AS owner, event_id AS seq, event_type AS src, mod(event_id, 11) = 4 AS fatal FROM {ev} WHERE user_id IS NOT NULL"


@query("t11_t12_resets", f"SELECT owner, seq, version::BIGINT AS version, coalesce(bool_or(fatal) OVER (PARTITION BY owner, version ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stuck FROM (SELECT *, sum(change) OVER (PARTITION BY owner ORDER BY seq) AS version FROM (SELECT *, coalesce((lag(src) OVER (PARTITION BY owner ORDER BY seq) <> src)::INT, 1) AS change FROM ({_SRC.format(ev='events')})))")
def resets(spark: SparkSession, d: str) -> DataFrame:
    return live.with_resets(spark.sql(_SRC, ev=table(spark, d, "events")), width=1000).select("owner", "seq", "version", "stuck")


@query("t13_eviction", "SELECT id FROM (SELECT event_id AS id, event_type IN ('click', 'view') AS done, row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts DESC, event_id) AS rank FROM events) WHERE rank > 1000 OR (rank > 500 AND done)")
def eviction(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("user_id") % 4).alias("owner"), F.col("event_id").alias("id"), F.col("ts").alias("seen"), F.col("event_type").isin("click", "view").alias("done"))
    return live.evicted(e).select("id")


@query("t15_stale_results", f"SELECT owner, seq FROM (SELECT *, arg_max(src, seq) OVER (PARTITION BY owner) AS now FROM ({_SRC.format(ev='events')})) WHERE src = now")
def stale_results(spark: SparkSession, d: str) -> DataFrame:
    return live.fresh_results(spark.sql(_SRC, ev=table(spark, d, "events"))).select("owner", "seq")


@query("t14_debounce", "SELECT user_id AS owner, epoch_us(ts) + 7200000000 AS fired FROM (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events WHERE user_id IS NOT NULL) WHERE coalesce(epoch_us(next) - epoch_us(ts) >= 7200000000, true)")
def debounce(spark: SparkSession, d: str) -> DataFrame:
    """Here with a wait of two hours, since the events are hours apart."""
    e = table(spark, d, "events").filter("user_id IS NOT NULL").select(F.col("user_id").alias("owner"), "ts", F.col("event_id").alias("id"))
    return live.debounced(e, wait_ms=7_200_000).select("owner", F.unix_micros(F.col("fired").cast("timestamp")).alias("fired"))


@query("t14_rediscover", "SELECT user_id AS owner, (epoch_us(ts) // 3600000000 + 1) * 3600000000 AS tick, count(*)::BIGINT AS n FROM events WHERE user_id IS NOT NULL GROUP BY ALL")
def rediscover(spark: SparkSession, d: str) -> DataFrame:
    """Here with a tick each hour."""
    e = table(spark, d, "events").filter("user_id IS NOT NULL").select(F.col("user_id").alias("owner"), "ts")
    return live.rediscovered(e, every_ms=3_600_000).select("owner", F.unix_micros(F.col("tick").cast("timestamp")).alias("tick"), "n")
