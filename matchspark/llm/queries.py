"""The registered queries of the corpus operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matchspark.llm import collocations, decision_list, line_dedup, merkle_log, packing, quality_pu, secret_scan, sentencepiece_codec, simhash_near, sstable, text_prints, toxicity_zstd, vector_topk
from matchspark.session import table


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of all documents."""
    return simhash_near.near_duplicates(table(spark, sf_dir, "documents"))


def op10_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to table shards and read back."""
    import public_tokenizers

    return sstable.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that too many pages of their source hold."""
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return secret_scan.find_secrets(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdicts of the learned rules for all documents."""
    return decision_list.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector."""
    return vector_topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality_pu.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity_zstd.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of all documents and whether they decode to the text."""
    import public_tokenizers

    return sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents."""
    return merkle_log.merkle_manifest(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of each language over all documents."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return text_prints.document_prints(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_line_dedup, op2_exact_top_k, op3_sentencepiece, op4_quality_classifier, op5_simhash_near_dedup, op6_secret_scans, op7_best_fit_packing, op8_quality_rules, op9_toxicity, op10_sstable, op11_merkle_manifest, op12_phrase_collocations, op13_document_fingerprints, pipeline]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL.replace("{docs}", "documents"), "op2_exact_top_k": vector_topk.SQL, "op11_merkle_manifest": merkle_log.SQL, "op12_phrase_collocations": collocations.SQL}
