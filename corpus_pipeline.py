"""A corpus pipeline: civil, exact and near copies gone, no benchmark passages, mixed to target weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foreloom.llm import decontamination, exact_dedup, mixing, near_dedup, toxicity
from foreloom.llm.common import park
from foreloom.session import ship

#: The near-duplicate stage takes shingles of five words.
NEAR = near_dedup.Sketch(words=5)


def civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, does not reject."""
    ship(spark)
    return toxicity.keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each text."""
    return exact_dedup.keep_first(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of near duplicates."""
    ship(spark)
    return near_dedup.keep_one(docs, p=NEAR)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    return decontamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document that is left."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", civil),
    ("exact_dedup", distinct),
    ("near_dedup", dissimilar),
    ("decontamination", unseen),
    ("mixing", mixed),
]

#: The first stage is a learned classifier, which SQL does not express; tests hold the others against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = park(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
