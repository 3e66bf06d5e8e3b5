"""Training-corpus pipeline: quality, language, near copies, benchmark passages, packing.

``STAGES`` are run in order, each on all rows that the one before it kept. All
but the last return the columns of their input; the last returns the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lynceus.llm import decontaminate, frames, language, packing, quality, simhash


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, quality.train(docs, frames.read(spark, sf_dir, "labels")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language that don't claim another one."""
    return language.accepted(docs, language.train(docs))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.deduplicate(docs)


def free_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    return decontaminate.remove(docs, frames.read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequence and offset of every piece of every document."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("language_id", known_language),
    ("simhash_near_dedup", one_of_each_group),
    ("benchmark_decontamination", free_of_benchmarks),
    ("best_fit_packing", packed),
]

#: SQL can express neither the classifiers nor the packing; tests/llm compares
#: the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written and read again."""
    work = f"{frames.shared_folder(spark)}/pipeline/{spark.sparkContext.applicationId}-{spark.sql('select uuid()').first()[0]}"
    docs = frames.read(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{work}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
