"""From raw documents to sharded training data: the stages, and their run over ``documents``.

Each stage takes all rows that the one before it kept, read back from parquet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carecohort.llm.common import free_name, table
from carecohort.llm.decontaminate import with_contamination
from carecohort.llm.language import UNKNOWN, language_of, learn_language
from carecohort.llm.mixing import in_mixed_order
from carecohort.llm.near_dup import one_of_each_group
from carecohort.llm.sharding import file_order, with_shards
from carecohort.storage import written

#: Texts without a letter go, and those that no language claims with this score.
MIN_LANGUAGE_SCORE = 0.3
SHARDS = 40


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a known language; learned from these rows' own labels.

    Without any label nothing can be rejected for its language: texts with a letter stay.
    """
    model = learn_language(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    name = free_name(docs, "_language")
    found = docs.withColumn(name, language_of(F.col("text"), model))
    known = (F.col(name)["lang_pred"] != UNKNOWN) & (F.col(name)["score"] >= MIN_LANGUAGE_SCORE)
    return found.where(known).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that shares 80 % of its five-word shingles, by links."""
    return one_of_each_group(docs, words=5, share=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any ten-word passage of a benchmark item."""
    name = free_name(docs, "_benchmark")
    found = with_contamination(docs, table(spark, sf_dir, "benchmark"), name)
    return found.where(F.size(F.col(name)["hit"]) == 0).drop(name)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, in the order of the mix: files and rows in them follow the schedule."""
    return in_mixed_order(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with ``shard`` and ``slot``; slots of a shard keep the order of the files."""
    return with_shards(docs, [1.0] * SHARDS, order=file_order(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Signatures, kernels and the schedule have no SQL form; tests hold run() against brute force.
ORACLE_SQL = None
