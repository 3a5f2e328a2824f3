"""Landed pages of feeds: where a scan of them stops, and artifacts that are held against their digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAGE, EMPTY_MOST, STALE_MOST = 100, 5, 8


def until_short(rows: DataFrame, split: str, place: str, page: int = PAGE) -> DataFrame:
    """Rows of the pages that a scan from offset 0 sees: page after page of a split, up to the first one that holds fewer than ``page`` rows. place: a row's number in its split.

    A page without rows ends the scan too. Counted by page before anything is
    joined, so no task holds a split.
    """
    held = rows.withColumn("_page", F.floor(F.col(place) / F.lit(page)))
    full = held.groupBy(F.col(split).alias("_s"), F.col("_page").alias("_p")).agg(F.count("*").alias("_n")).filter(F.col("_n") >= page)
    # of full pages numbered from 0 without a gap, the one before the first gap
    run = full.withColumn("_run", F.row_number().over(W.partitionBy("_s").orderBy("_p")) - 1).filter("_run = _p")
    last = run.groupBy("_s").agg(F.max("_p").alias("_last"))
    joined = held.join(last, F.col(split).eqNullSafe(F.col("_s")), "left")
    return joined.filter(F.col("_page") <= F.coalesce(F.col("_last") + 1, F.lit(0))).drop("_page", "_s", "_last")


def in_a_row(pages: DataFrame, feed: str, number: str, holds: Column, out: str) -> DataFrame:
    """How many pages up to each one hold in a row. Pages, not their contents, are what a task holds of a feed."""
    before = W.partitionBy(feed).orderBy(number).rowsBetween(W.unboundedPreceding, 0)
    place = F.row_number().over(W.partitionBy(feed).orderBy(number))
    return pages.withColumn("_at", place).withColumn(out, F.col("_at") - F.coalesce(F.max(F.when(~holds, F.col("_at"))).over(before), F.lit(0))).drop("_at")


def until_dry(pages: DataFrame, known: DataFrame, feed: str = "feed", number: str = "number", ids: str = "ids", empty_most: int = EMPTY_MOST, stale_most: int = STALE_MOST) -> DataFrame:
    """feed, number and id of what a cursor feed gives for the first time: pages in the order in which they were fetched, until ``empty_most`` without images or ``stale_most`` without new ids follow each other.

    known: a table of ids (its first column) that are there already.
    """
    found = pages.select(feed, number, F.explode(ids).alias("id")).filter("id IS NOT NULL").groupBy(feed, "id").agg(F.min(number).alias(number))
    fresh = found.join(known.select(F.col(known.columns[0]).alias("id")).distinct(), "id", "left_anti")
    news = fresh.groupBy(F.col(feed).alias("_f"), F.col(number).alias("_n")).agg(F.count("*").alias("_new"))
    counted = pages.select(feed, number, F.coalesce(F.size(ids), F.lit(0)).alias("_size")).join(news, F.col(feed).eqNullSafe(F.col("_f")) & (F.col(number) == F.col("_n")), "left").drop("_f", "_n")
    counted = in_a_row(counted, feed, number, F.col("_size") <= 0, "_empty")
    counted = in_a_row(counted, feed, number, F.col("_new").isNull(), "_stale")
    stop = counted.filter((F.col("_empty") >= empty_most) | (F.col("_stale") >= stale_most)).groupBy(F.col(feed).alias("_f")).agg(F.min(number).alias("_stop"))
    joined = fresh.join(stop, F.col(feed).eqNullSafe(F.col("_f")), "left")
    return joined.filter(F.col("_stop").isNull() | (F.col(number) <= F.col("_stop"))).select(feed, number, "id")


def verified(artifacts: DataFrame, manifest: DataFrame, key: str = "name", content: str = "content") -> DataFrame:
    """Every artifact that the manifest (key, sha256) names, with its size and status: ready, missing, or an error that names the digest found."""
    have = artifacts.select(F.col(key).alias("_k"), F.sha2(content, 256).alias("_digest"), F.octet_length(content).alias("n_bytes"))
    joined = manifest.join(have, F.col(key) == F.col("_k"), "left")
    status = F.when(F.col("_digest").isNull(), "missing").when(F.col("_digest") == F.col("sha256"), "ready").otherwise(F.concat(F.lit("error: digest "), "_digest"))
    return joined.select(key, "n_bytes", status.alias("status"))
