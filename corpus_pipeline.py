"""The corpus pipeline: five stages, each one of the operators of ``lumenforge.llm``.

Every stage takes what the one before kept (all columns of ``documents``) and
writes its result as Parquet in the shared folder; the last returns the index of
the token files. Null texts count as empty throughout; an empty table passes
through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenforge.llm import decontam, mixing, nearcopies, quality, tokenbin
from lumenforge.llm.common import fresh_dir, partitions, table

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Score every document; those below the classifier's threshold go."""
    docs = docs.select(*DOCUMENT)
    scored = quality.classify(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return scored.filter("quality_pred = 1").select(*DOCUMENT)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of at least 0.8) the document with the smallest id stays; of documents without words one stays."""
    docs = docs.select(*DOCUMENT)
    roots = nearcopies.near_copies(docs)
    # the digest of a whole row tells rows apart; ids may be null or repeated, and rows equal in all are interchangeable
    rest = F.to_json(F.struct("doc_id", F.md5(F.col("text").cast("binary")).alias("text"), "lang", "source", "n_chars"))
    keyed = docs.withColumn("_row", F.md5(rest.cast("binary")))
    named = keyed.select("doc_id", "_row", nearcopies.node().alias("n")).join(roots, F.col("n") == F.col("node"), "left")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    stay = named.groupBy(F.coalesce("root", "n")).agg(F.min_by("_row", order).alias("_row")).select("_row")
    return keyed.join(stay, "_row").dropDuplicates(["_row"]).select(*DOCUMENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    found = decontam.contamination(docs.select(*DOCUMENT), table(spark, sf_dir, "benchmark"))
    return found.filter("size(dc_spans) = 0").select(*DOCUMENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, once for each time that their source's stream comes round to them, in the order of their slots: a document of which it takes k times its size, in parts or whole, is there k times, rounded up."""
    docs = docs.select(*DOCUMENT)
    key = ["doc_id", "source", "size"]
    parts = mixing.mix(docs)["parts"].groupBy(*key, "start", "pass").agg(F.min("slot").alias("slot"))
    # rows of one id, source and size are interchangeable: each is there as often as the most taken one
    rows = parts.withColumn("time", F.row_number().over(W.partitionBy(*key, "start").orderBy("slot")))
    plan = rows.groupBy(*[F.col(c).alias(f"mix_{c}") for c in key], "time").agg(F.min("slot").alias("slot"))
    keyed = docs.withColumn("size", mixing.word_count())
    same = F.col("doc_id").eqNullSafe(F.col("mix_doc_id")) & F.col("source").eqNullSafe(F.col("mix_source")) & (F.col("size") == F.col("mix_size"))
    mixed = keyed.join(plan, same)
    return mixed.repartitionByRange(partitions(spark), "slot").sortWithinPartitions("slot").select(*DOCUMENT)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the mix, write it as bit planes, read the files back: one row per document in file order."""
    return tokenbin.op4(docs.select(*DOCUMENT))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source_mix", mix_sources),
    ("token_files", write_token_files),
]

#: The classifier and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    at = fresh_dir(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
