"""The corpus pipeline: five stages over documents, each written and read again.

Stages keep the columns of documents, of any further names too, and every row that their
operator does not reject: rows without doc_id and repeated ids are judged by their own
text. Null and empty texts are rejected by the quality rules; an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from matchspark.llm.decision_list import keep_good
from matchspark.llm.line_dedup import line_dedup
from matchspark.llm.packing import pack
from matchspark.llm.secret_scan import mask_secrets
from matchspark.llm.shingle_near import keep_first
from matchspark.session import discard, scratch_path, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: rows that the base rule or the learned rules reject go, null and empty texts among them."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: lines on too many distinct pages of their source go; every row stays, exact copies count once."""
    return line_dedup(docs, copies_once=True)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5 at five words and similarity 0.8, by fingerprint bytes with count filtering: one row of each group stays, the smallest doc_id (null last)."""
    return keep_first(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: found spans are replaced by their kind; every row stays."""
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: pieces of all rows in sequences of at most 2048 tokens; null is the empty text."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality_rules), ("line_dedup", boilerplate_lines), ("near_dedup", near_dedup), ("secret_scans", secrets), ("best_fit_packing", packing)]

#: Learned rules, similarities and tokens have no SQL form; tests/llm/test_pipeline.py compares a run with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; what each returns is written as Parquet and reread, and then removed but for the last."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            discard(spark, before)
        before = path
    return docs
