"""Queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronotext.llm import language_id
from chronotext.llm._spark import table
from chronotext.llm.bpe import encoded
from chronotext.llm.decontaminate import index_of, leaks
from chronotext.llm.embed_dedup import near_duplicate_vectors
from chronotext.llm.license_scan import licenses
from chronotext.llm.minhash_dedup import near_duplicate_groups
from chronotext.llm.oracle import SQL
from chronotext.llm.secret_scan import secrets
from chronotext.llm.suffix_dedup import repeated_passages
from chronotext.llm.token_count import token_counts
from chronotext.llm.toxicity import model_for, toxic_spans


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), index_of(table(spark, sf_dir, "benchmark")))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_spans(table(spark, sf_dir, "documents"), model_for(spark, sf_dir))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents."""
    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_with_repeats_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator, which also reports passages that repeat within one document only."""
    return repeated_passages(table(spark, sf_dir, "documents"), within=True)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(table(spark, sf_dir, "documents"), language_id.model_for(spark, sf_dir))


__all__ = ["QUERIES", "SQL"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_token_counts": op2_token_counts,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_license_scans": op4_license_scans,
    "op5_bpe": op5_bpe,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op9_with_repeats_within": op9_with_repeats_within,
    "op10_language_id": op10_language_id,
}

