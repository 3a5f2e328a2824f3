"""Queries of the operators of this subpackage, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from . import clusters, decontam, langid, lmscore, mixing, pii, quality, runs, simhash, suffixdedup, tokenbin, topk, wordbpe
from .common import table
from .sql import ORACLE_SQL

QUERIES = {
    "op1_lm_score": lambda spark, d: lmscore.op1(table(spark, d, "documents")),
    "op2_language_id": lambda spark, d: langid.op2(table(spark, d, "documents")),
    "op3_suffix_dedup": lambda spark, d: suffixdedup.op3(table(spark, d, "documents")),
    "op4_token_binary": lambda spark, d: tokenbin.op4(table(spark, d, "documents")),
    "op5_pii": lambda spark, d: pii.op5(table(spark, d, "documents")),
    "op6_simhash": lambda spark, d: simhash.op6(table(spark, d, "documents")),
    "op7_decontamination": lambda spark, d: decontam.op7(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op8_source_mix": lambda spark, d: mixing.op8(table(spark, d, "documents")),
    "op9_exact_topk": lambda spark, d: topk.op9(table(spark, d, "embeddings")),
    "op10_quality": lambda spark, d: quality.op10(table(spark, d, "documents"), table(spark, d, "labels")),
    "op11_annulus_clusters": lambda spark, d: clusters.op11(table(spark, d, "embeddings")),
    "op12_byte_bpe": lambda spark, d: wordbpe.op12(table(spark, d, "documents")),
    "op13_word_runs": lambda spark, d: runs.op13(table(spark, d, "documents")),
}

__all__ = ["ORACLE_SQL", "QUERIES"]
