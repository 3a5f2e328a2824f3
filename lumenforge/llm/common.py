"""Small helpers that the operators share."""

from __future__ import annotations

import atexit
import contextlib
import gc
import uuid
from collections.abc import Callable, Iterator

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: the session's, or else one in the warehouse, which a cluster shares too."""
    at = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for what results are read from; it goes when the program ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_forget, at)
    return at


def _forget(path: str) -> None:
    jvm = SparkContext._jvm
    if jvm is None:
        return
    with contextlib.suppress(Py4JError, OSError):  # the JVM may have ended before
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)


def remove_dir(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def let_go(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of frames that are no longer referenced; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def give_back() -> None:
    """Return freed memory to the system: a Python worker waits for its next task with all it ever held otherwise."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A batch function that gives memory back when its partition ends."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return wrapped


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_chunk(df: DataFrame, at: str) -> DataFrame:
    """The rows as they are read back from a folder where they lie bucketed by chunk: grouping by chunk doesn't shuffle them."""
    spark, name = df.sparkSession, f"chunks_{uuid.uuid4().hex}"
    df.write.bucketBy(partitions(spark), "chunk").option("path", at).saveAsTable(name)
    held = spark.table(name).select(*df.columns)
    held.schema  # resolved, so it doesn't need the name any more
    spark.sql(f"DROP TABLE {name}")  # the files stay
    return held


def running_start(df: DataFrame, key: str, order: list[str], size: str, out: str, bucket: Column, n_keys_small: bool = True) -> DataFrame:
    """Exclusive running sum of ``size`` within ``key`` in ``order``, with no task that holds a whole key.

    ``bucket`` must be monotone in ``order`` and splits each key evenly: sums of
    buckets are added up first (a small table), then each bucket on its own.
    """
    df = df.withColumn("_b", bucket)
    sums = df.groupBy(key, "_b").agg(F.sum(size).alias("_s"))
    ahead = W.partitionBy(key).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias("_k"), F.col("_b").alias("_kb"), F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_base"))
    inner = W.partitionBy(key, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    inside = df.withColumn("_in", F.coalesce(F.sum(size).over(inner), F.lit(0)))
    joined = inside.join(sums, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb")))
    return joined.withColumn(out, F.col("_base") + F.col("_in")).drop("_k", "_kb", "_b", "_in", "_base")
