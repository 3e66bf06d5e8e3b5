"""Whole-table queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lynceus.llm import decontaminate, language, licenses, ogg, packing, quality, rangecoder, simhash, tokens, toxicity
from lynceus.llm.frames import read


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every toxic document with its score."""
    docs = read(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")), only_toxic=True)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its language, and whether it is accepted."""
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of a benchmark item, with the item."""
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality, and whether it is accepted."""
    docs = read(spark, sf_dir, "documents")
    return quality.scores(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and line that is a known license or notice."""
    return licenses.scan(read(spark, sf_dir, "documents"))


def op6_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document, in coded blocks."""
    return rangecoder.write(read(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token count of every document."""
    return tokens.counts(read(spark, sf_dir, "documents"))


def op8_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logical streams of every document's media."""
    return ogg.streams(ogg.wrap(read(spark, sf_dir, "documents")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequence and offset of every piece of every document."""
    return packing.pack(read(spark, sf_dir, "documents"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint, its group of near copies, and whether it stays."""
    return simhash.groups(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_language": op2_language,
    "op3_decontamination": op3_decontamination,
    "op4_quality": op4_quality,
    "op5_licenses": op5_licenses,
    "op6_token_blocks": op6_token_blocks,
    "op7_token_counts": op7_token_counts,
    "op8_ogg_media": op8_ogg_media,
    "op9_packing": op9_packing,
    "op10_simhash_dedup": op10_simhash_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": decontaminate.ORACLE_SQL,
    "op5_licenses": licenses.ORACLE_SQL,
}
