"""Registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreloom.llm import collocations, decontamination, exact_dedup, language, line_dedup, merkle, mixing, near_dedup, quality, secrets, set_join, token_counts, toxicity
from foreloom.llm.prefix import numbered
from foreloom.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return fn(lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_secret_scan", secrets.SQL)
def _(table):
    """Secrets of every document, scanned blob by blob."""
    return secrets.digested(secrets.scan(table("documents")))


@query("op2_mix_sources", mixing.SQL)
def _(table):
    """The mix of all documents."""
    return mixing.mix(table("documents"))


@query("op3_line_dedup", line_dedup.SQL)
def _(table):
    """Every document without the passages of three lines or more that stand somewhere before."""
    return line_dedup.digested(line_dedup.deduplicated(table("documents")))


@query("op4_quality")
def _(table):
    """Quality of every document."""
    return quality.quality(table("documents"), table("labels"))


@query("op5_language")
def _(table):
    """Language of every document."""
    return language.languages(table("documents"))


@query("op6_toxicity")
def _(table):
    """Toxicity of every document."""
    return toxicity.toxicity(table("documents"), table("labels"))


@query("op7_near_dedup")
def _(table):
    """Every document with its component of near duplicates."""
    found = near_dedup.near_duplicates(numbered(table("documents")))
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "kept")


@query("op8_token_counts")
def _(table):
    """Tokens of every document by its lines."""
    return token_counts.digested(token_counts.by_line(table("documents")))


@query("op9_decontaminate")
def _(table):
    """Every document with the benchmark items that it holds."""
    return decontamination.flagged(table("documents"), table("benchmark"))


@query("op10_exact_dedup", exact_dedup.SQL)
def _(table):
    """Every document with the one that stays of its text, the table coming in two batches against one index."""
    return exact_dedup.dedup(table("documents"), batches=2)


@query("op11_collocations", collocations.SQL)
def _(table):
    """The strongest phrases of every language."""
    return collocations.collocations(table("documents"))


@query("op12_set_join", set_join.SQL)
def _(table):
    """Every document with its component of an exact join of shingle sets."""
    found = set_join.similar(table("documents"))
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


@query("op13_merkle_manifest", merkle.SQL)
def _(table):
    """Every document's proof, and whether it still verifies after the tampering of some."""
    return merkle.verified(table("documents"))
