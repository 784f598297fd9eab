"""Cleaning of a corpus in stages, each written as Parquet and read by the next one.

Every stage works on all that the one before kept, and all but the last return the columns of
``documents``. A text that a stage changes gets a new ``n_chars``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayer.llm import chosen_path, line_chunks, piece_bpe, quality_ledger, suffix_decontam
from assayer.llm.common import read, stored

# Words that a Python worker remembers in the last stage. Workers live on between stages, so
# what they hold adds to the memory of the stages that follow in the same session.
ENCODING_MEMORY = 100_000
# Rows that pass between Spark and Python at a time, in all stages. Texts may be long, and both
# sides hold a batch several times over.
BATCH_ROWS = 1000

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy keeps."""
    return quality_ledger.keep(docs, "prose-1")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that an earlier document has; those of which nothing
    remains go."""
    _small_batches(spark)
    return line_chunks.remove(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, the one with the smallest id."""
    _small_batches(spark)
    return chosen_path.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; mostly covered ones go."""
    _small_batches(spark)
    return suffix_decontam.remove(docs, read(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What remains, as piece ids with an end id, and the text decoded from them."""
    _small_batches(spark)
    both = piece_bpe.encode_decode(docs.select("doc_id", "text"), memory=ENCODING_MEMORY)
    return both.select("doc_id", "ids", "decoded")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

# Chosen paths, content-defined chunks and backtracking have no SQL form; the stages are
# tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
