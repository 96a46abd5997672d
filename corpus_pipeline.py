"""A corpus of documents through five stages, each over all rows that its predecessor kept.

Order: cheap row-local rejection first (toxic documents), then the one stage
that exchanges data (near copies), then two row-local stages over what is left
(benchmark passages, secrets), then encoding.  Each stage's rows are written as
Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronotext.llm import bpe, decontaminate, minhash_dedup, secret_scan, toxicity
from chronotext.llm._spark import removed, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go.

    Null and empty texts stay; repeated rows are judged one by one; whole texts are
    read; without labels nothing is rejected.  No rows give no rows; all columns stay.
    """
    return toxicity.drop_toxic(docs, toxicity.model_for(spark, sf_dir))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the least doc_id.

    Null texts and null ids stay; of repeated rows of a doc_id one stays, that of
    the least text and then the least other columns.  No rows give no rows; all
    columns stay.
    """
    return minhash_dedup.drop_near_duplicates(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark text within the edit budget go.

    Null and empty texts stay; repeated rows are judged one by one; an empty
    benchmark drops nothing.  No rows give no rows; all columns stay.
    """
    return decontaminate.drop_leaks(docs, decontaminate.index_of(table(spark, sf_dir, "benchmark")))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; all documents stay and n_chars follows the text.

    Null and empty texts and repeated rows stay as they are.  No rows give no rows.
    """
    return secret_scan.redact_secrets(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, round_trip) of each document that is left.

    A null text has null ids, an empty one none; null ids of documents and repeated
    rows are kept; no rows give no rows; other columns are dropped.
    """
    return bpe.encoded(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("minhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_leaks),
    ("secret_scans", without_secrets),
    ("bpe", encode),
]

#: The stages hold trained models, hash minima and a merge loop, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage.

    Nulls in any column pass through (null texts are in no group, are never
    toxic and have null ids); of repeated rows of a doc_id one stays; an empty
    table of documents gives no rows; extra columns are carried to the last
    stage, which drops them.
    """
    docs = table(spark, sf_dir, "documents")
    before: list[str] = []
    for name, stage in STAGES[:-1]:
        own: list[str] = []
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", own)
        removed(spark, before)  # this stage's rows are written: its input isn't read again
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
