"""From raw documents to packed training sequences, in stages that are each written and read again.

Every stage takes ``(spark, docs, sf_dir)`` and works on what its predecessor kept. All but the last return the columns
of ``documents``; the last returns the place of every piece of every kept document in a sequence. A changed text has its
``n_chars`` counted anew.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitflow.llm import decontaminate, linededup, neardup, packing, toxicity
from visitflow.llm.registry import VOCABULARY, usable_labels
from visitflow.llm.shared import new_folder, small_batches, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(run: Stage) -> Stage:
    """A stage whose Python workers get small batches, since stages share the workers of a session."""
    @wraps(run)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return run(spark, docs, sf_dir)

    return bounded


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


@_stage
def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the limit; learned from the usable labels of the documents given."""
    return toxicity.without_toxic(docs, usable_labels(table(spark, sf_dir, "labels")))


@_stage
def copied_lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier elsewhere; those that consist of them go."""
    return _counted(linededup.without_copies(docs))


@_stage
def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return neardup.one_of_each(docs)


@_stage
def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those that are mostly such passages go."""
    return _counted(decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")))


@_stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place and checksum of every piece; its ids are those of the document from ``start`` on."""
    return packing.packed(docs, VOCABULARY, digest=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic_out),
    ("line_dedup", copied_lines_out),
    ("near_dedup", near_copies_out),
    ("decontamination", benchmark_out),
    ("packing", packed),
]

# Iterative models, sampling and packing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
