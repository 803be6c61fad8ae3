"""From raw documents to a training mix: language, near copies, benchmark passages, personal data, source weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioweave.llm import decontam, langid, mixing, pii, simhash
from folioweave.sources.tables import SharedTables


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found go; a missing lang is set to the language found."""
    return langid.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.first_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark windows cover by a twentieth or more go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return pii.redact(docs)


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a copy's `taken` tells its words in the mix."""
    return mixing.expand_mix(mixing.mix_sources(docs)).drop("place")


STAGES = [
    ("language ID", known_languages),
    ("simhash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_passages),
    ("personal data", personal_data),
    ("source mixing", source_weights),
]

#: Fingerprint components, trained classifiers and message passing have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written and read again as the next one's documents."""
    tables = SharedTables(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, tables.write(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            tables.drop(before)
    return docs
