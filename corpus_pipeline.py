"""From raw documents to a training mix: quality, near copies, benchmark leaks, personal data, source weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder named in
spark.checkpoint.dir and hands what it reads back to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import decontaminate, mixing, near_copies, personal_data, quality
from pairloom.llm.common import table
from pairloom.session import scratch_folder


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is usual in their language."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of copies and near copies: the one with the smallest id."""
    return near_copies.first_of_each_class(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data covered."""
    return personal_data.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents with their texts, once for each repetition, the border documents cut; those of which nothing is taken are left out."""
    return mixing.mixed_documents(docs)


STAGES = [("quality", keep_quality), ("near_copies", drop_near_copies), ("benchmark", drop_benchmark), ("personal_data", redact), ("mix", mix)]
#: The model and the samples of the first two stages can't be written in SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        folder = scratch_folder(spark)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
