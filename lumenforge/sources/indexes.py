"""Corpus indexes and image folders as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenforge.functions.scalars import domain_name

ENTRY = T.StructType([T.StructField(n, T.StringType()) for n in ("file", "label", "model", "modelName", "promptId", "sha256")] + [T.StructField("hardCase", T.BooleanType())])
INDEX = T.StructType([T.StructField("generatedAt", T.StringType()), T.StructField("count", T.LongType()), T.StructField("images", T.ArrayType(ENTRY))])
EXTENSIONS = ("jpg", "jpeg", "png", "webp")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """One row for each image of an index file; a missing list gives none."""
    return spark.read.schema(INDEX).option("multiLine", True).json(path).select(F.inline("images"))


def two_indexes(spark: SparkSession, ai_path: str, real_path: str, files: DataFrame | None = None) -> DataFrame:
    """An AI and a real index one below the other, the label from the index; with ``files`` (column file), entries without a file go."""
    out = entries(spark, ai_path).withColumn("label", F.lit("ai")).unionByName(entries(spark, real_path).withColumn("label", F.lit("real")))
    out = out.withColumn("hardCase", F.coalesce("hardCase", F.lit(False)) & (F.col("label") == "real"))
    return out.join(files.select("file").distinct(), "file", "left_semi") if files is not None else out


def labelled_index(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """One index with labels of its own; entries of other labels go. An index without rows gives the fallback's."""
    out = entries(spark, path).filter(F.col("label").isin("ai", "real"))
    return labelled_index(spark, fallback) if fallback and out.isEmpty() else out


def from_paths(files: DataFrame, col: str = "path", hard: str | None = None) -> DataFrame:
    """label/domain/.../name.ext paths to label, y, domain and extension; other labels and extensions go."""
    label, ext = F.regexp_extract(col, "(?:^|/)(ai|real)/", 1), F.lower(F.regexp_extract(col, r"\.([A-Za-z0-9]+)$", 1))
    out = files.withColumns({"label": label, "extension": ext, "domain": domain_name(F.regexp_extract(col, "(?:^|/)(?:ai|real)/([^/]+)", 1))})
    out = out.filter(F.col("label").isin("ai", "real") & F.col("extension").isin(*EXTENSIONS)).withColumn("y", F.when(F.col("label") == "ai", 1).otherwise(0))
    return out.withColumn("hard", F.contains(F.col(col), F.lit(hard))) if hard else out


def image_folder(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """All images below a folder; without ``content`` the bytes are never read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return from_paths(found if content else found.drop("content"))
