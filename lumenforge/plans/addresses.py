"""Queries of the address operators over names of parts and addresses of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenforge.functions import urls
from lumenforge.session import dealt, table

from .catalog import query

_SRCSET = "CASE mod(p_partkey, 5) WHEN 0 THEN concat('https://a/', cast(p_partkey AS string), '-s.jpg 320w, https://a/', cast(p_partkey AS string), '-l.jpg 1200w') WHEN 1 THEN concat(' https://b/x.png 2x , https://b/', cast(p_partkey AS string), '.png 900w') WHEN 2 THEN 'https://c/bare.jpg, https://c/zero.jpg 0w' WHEN 3 THEN concat('https://d/1.jpg 800W,,https://d/', cast(p_partkey AS string), '.jpg 2X') ELSE '' END"
_BEST = "CASE p_partkey % 5 WHEN 0 THEN concat('https://a/', p_partkey::VARCHAR, '-l.jpg') WHEN 1 THEN concat('https://b/', p_partkey::VARCHAR, '.png') WHEN 2 THEN 'https://c/bare.jpg' WHEN 3 THEN 'https://d/1.jpg' END"


@query("f05_f06_srcset", f"SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END::INT AS n, {_BEST} AS best FROM part")
def srcset(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", urls.parse_srcset(F.expr(_SRCSET)).alias("c"))
    return rows.select("p_partkey", F.size("c").alias("n"), urls.pick_best(F.col("c")).alias("best"))


_BLOB = "CASE mod(page_id, 6) WHEN 0 THEN concat('/imgres?imgurl=https%3A%2F%2Fx%2F', cast(page_id AS string), '.jpg&h=1') WHEN 1 THEN concat('a=1&imgurl%3Dhttps:', chr(92), '/', chr(92), '/y/', cast(page_id AS string)) WHEN 2 THEN concat('{\"ou\":\"https:', chr(92), '/', chr(92), '/z/', cast(page_id AS string), '+a.png\"}') WHEN 3 THEN '?imgurl=ftp%3A%2F%2Fno&mediaurl=http%3A%2F%2Fm' WHEN 4 THEN '?imgurl=https%3A%2F%2Fbad%ZZ' ELSE url END"


@query("f07_f08_full_url_param", "SELECT page_id, CASE page_id % 6 WHEN 0 THEN concat('https://x/', page_id::VARCHAR, '.jpg') WHEN 1 THEN concat('https://y/', page_id::VARCHAR) WHEN 2 THEN concat('https://z/', page_id::VARCHAR, '+a.png') WHEN 3 THEN 'http://m' END AS full_url FROM pages")
def full_url_param(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", urls.full_url_param(F.expr(_BLOB)).alias("full_url"))


_SOCIAL = "CASE mod(page_id, 7) WHEN 0 THEN 'https://pbs.twimg.com/media/a?format=jpg&name=small' WHEN 1 THEN 'https://pbs.twimg.com/media/a.jpg:thumb' WHEN 2 THEN 'https://pbs.twimg.com/profile_images/1/b_normal.png' WHEN 3 THEN 'https://pbs.twimg.com/media/a?name=orig' WHEN 4 THEN 'https://encrypted-tbn0.gstatic.com/images?q=tbn:x' WHEN 5 THEN 'https://th.bing.com/th?id=1' ELSE url END"


@query("f12_f13_hosts", "SELECT page_id, page_id % 7 IN (4, 5) AS thumb, CASE page_id % 7 WHEN 0 THEN 'https://pbs.twimg.com/media/a?format=jpg&name=large' WHEN 1 THEN 'https://pbs.twimg.com/media/a.jpg:large' WHEN 2 THEN 'https://pbs.twimg.com/profile_images/1/b_400x400.png' WHEN 3 THEN 'https://pbs.twimg.com/media/a?name=orig' WHEN 4 THEN 'https://encrypted-tbn0.gstatic.com/images?q=tbn:x' WHEN 5 THEN 'https://th.bing.com/th?id=1' ELSE url END AS upgraded FROM pages")
def hosts(spark: SparkSession, d: str) -> DataFrame:
    x = F.expr(_SOCIAL)
    return table(spark, d, "pages").select("page_id", urls.is_thumb(x).alias("thumb"), urls.upgraded(x).alias("upgraded"))


_SCRIPT = """concat('x["id', cast(1000 + mod(page_id, 50) AS string), '",["https://e.gstatic.com/images?q=1",10,20],["https://full/', cast(page_id AS string), '.jpg"]] ["https://encrypted-tbn0.gstatic.com/images?q=tbn:k', cast(page_id AS string), '",5,6],["https://orig/', cast(page_id AS string), '.png"]')"""


@query("f09_script_map", "SELECT page_id, concat('id', (1000 + page_id % 50)::VARCHAR) AS id, concat('https://full/', page_id::VARCHAR, '.jpg') AS url FROM pages UNION ALL SELECT page_id, concat('https://encrypted-tbn0.gstatic.com/images?q=tbn:k', page_id::VARCHAR), concat('https://orig/', page_id::VARCHAR, '.png') FROM pages UNION ALL SELECT page_id, concat('tbn:k', page_id::VARCHAR), concat('https://orig/', page_id::VARCHAR, '.png') FROM pages")
def script_map(spark: SparkSession, d: str) -> DataFrame:
    scripts = table(spark, d, "pages").select("page_id", F.expr(_SCRIPT).alias("script"))
    return urls.script_map(scripts, "page_id", "script")


@query("f10_f11_ancestors", "SELECT page_id AS img, concat('https://full/', page_id::VARCHAR, '.jpg') AS url FROM pages WHERE page_id % 4 <> 3")
def ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Images whose nearest known ancestor is up to ten levels away; every fourth one's is farther."""
    pages = table(spark, d, "pages")
    pairs = urls.script_map(pages.select("page_id", F.expr(_SCRIPT).alias("script")), "page_id", "script")
    depth = F.when(F.col("page_id") % 4 == 3, 12).otherwise(F.col("page_id") % 4).cast("int")
    known = F.concat(F.lit("id"), (1000 + F.col("page_id") % 50).cast("string"))
    attrs = pages.select(F.col("page_id").alias("img"), "page_id", F.inline(F.array(F.struct(depth.alias("depth"), F.lit(1).alias("attr_ord"), known.alias("value")), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("attr_ord"), F.lit("unknown").alias("value")))))
    return urls.ancestor_lookup(attrs, pairs, "img", "page_id")


@query("f14_resolve_url", f"SELECT p_partkey, coalesce(CASE WHEN p_partkey % 5 = 0 OR p_partkey % 2 = 1 AND p_partkey % 5 IN (1, 3) THEN {_BEST} END, CASE WHEN p_partkey % 2 = 0 THEN 'https://encrypted-tbn0/t.jpg' ELSE 'https://s/cur.jpg' END) AS fast, CASE WHEN p_partkey % 3 = 0 THEN concat('https://full/', p_partkey::VARCHAR) WHEN p_partkey % 3 = 1 THEN 'https://pbs.twimg.com/media/q?name=large' ELSE coalesce(CASE WHEN p_partkey % 5 IN (0, 1, 3) THEN {_BEST} END, CASE WHEN p_partkey % 2 = 0 THEN 'https://encrypted-tbn0/t.jpg' ELSE 'https://s/cur.jpg' END) END AS full_ FROM part")
def resolve_url(spark: SparkSession, d: str) -> DataFrame:
    """candidates in both modes; the displayed asset is 10 by 10."""
    current = F.when(F.col("p_partkey") % 2 == 0, "https://encrypted-tbn0/t.jpg").otherwise("https://s/cur.jpg")
    attr = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("https://full/"), F.col("p_partkey").cast("string")))
    linked = F.when(F.col("p_partkey") % 3 == 1, F.lit("https://pbs.twimg.com/media/q?name=small"))
    both = {m: urls.resolve(mode, attr, linked, F.expr(_SRCSET), current, F.lit(100)) for m, mode in (("fast", "fast"), ("full_", "full"))}
    return dealt(table(spark, d, "part").select("p_partkey"), "p_partkey", 1 << 15).select("p_partkey", *[c.alias(m) for m, c in both.items()])
