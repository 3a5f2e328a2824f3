"""Session settings shared by tests, bench and the driver's entry points."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def get_spark(app: str = "lumenforge", master: str | None = None) -> SparkSession:
    """A session for local work; on a cluster the caller's session is used as it is."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str):
    """One Parquet table of a data folder; the path may be in any store Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df, key: str, rows: int = 256):
    """Rows that each make thousands, dealt by key over tasks of about ``rows`` of them, however few files they come from.

    What is made of them and grouped by the key needs no other shuffle, and a task's groups don't grow with the table.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(tasks, key)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all executors see: the session's checkpoint folder, or else one in the warehouse."""
    at = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``scratch`` named."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
