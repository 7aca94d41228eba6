"""The corpus pipeline: each stage takes all that its predecessor kept, as Parquet in the shared folder.

Rows of documents with odd values have a defined way through: each stage's module says what it does with nulls, empty
texts, repeated rows and empty tables. Columns of documents beyond those that a stage reads are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cueloom.llm import common, decontamination, language_id, line_dedup, mixing, near_dedup


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is rejected."""
    return language_id.keep_known(docs)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes lines that near-repeat an earlier one out of the texts."""
    return line_dedup.without_duplicate_lines(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return near_dedup.keep_one(docs)


def clear_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that leak a benchmark item."""
    return decontamination.without_leaks(docs, common.read(spark, sf_dir, "benchmark"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents by raked probabilities; adds mix_weight."""
    return mixing.mixed(docs)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", distinct_lines),
    ("near_dedup", one_of_each_group),
    ("decontamination", clear_of_benchmark),
    ("mixing", mixed_sources),
]

#: SQL can't express the first stage's vectors, nor the later ones' signatures; tests/llm hold the stages of line dedup,
#: near dedup and decontamination against brute force, the other two and run() not yet.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table documents."""
    tables = common.Tables(spark, "pipeline")
    docs = common.read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = tables.write(stage(spark, docs, sf_dir))
    return docs
