"""Preparation of star schemas: encodings, missing dimension rows, made-up target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foreloom.functions.scalars import synthetic_target
from foreloom.plans.joins import attach
from foreloom.plans.ordered import positions


def dictionary(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of a column, numbered from 1 in their sort order."""
    values = df.select(F.col(column).alias("original_value")).where(F.col(column).isNotNull()).distinct()
    numbered = positions(values, [], ["original_value"], "__pos")
    return numbered.select("original_value", (F.col("__pos") + 1).alias("dict_id"))


def replace_by_dictionary(df: DataFrame, column: str, words: DataFrame) -> DataFrame:
    lookup = words.select(F.col("original_value").alias(column), "dict_id")
    out = attach(df, lookup, [column], "left")
    return out.withColumn(column, F.col("dict_id")).drop("dict_id").select(*df.columns)


def dict_encode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Replace every text column by the ids of its dictionary."""
    texts = columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    for c in texts:
        df = replace_by_dictionary(df, c, dictionary(df, c))
    return df


def bool_encode(df: DataFrame) -> DataFrame:
    flags = {f.name for f in df.schema if isinstance(f.dataType, T.BooleanType)}
    return df.select(*[F.col(c).cast("int").alias(c) if c in flags else F.col(c) for c in df.columns])


def fill_missing_keys(dim: DataFrame, facts: DataFrame, keys: Sequence[str], defaults: dict) -> DataFrame:
    """Add the key tuples seen in the facts but not in the dimension."""
    seen = facts.select(*keys).distinct()
    missing = seen.join(dim.select(*keys), list(keys), "left_anti")
    filled = missing.select(
        *keys,
        *[
            F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name)
            for f in dim.schema
            if f.name not in keys
        ],
    )
    return dim.unionByName(filled)


def add_synthetic_target(
    sales: DataFrame, stores: DataFrame, trans: DataFrame, oil: DataFrame
) -> DataFrame:
    """Target of the star schema from the sales row and three of its dimensions."""
    joined = attach(sales, stores.select("store_nbr", "f4"), ["store_nbr"])
    joined = attach(joined, trans.select("date", "store_nbr", "f5"), ["date", "store_nbr"], "left")
    joined = attach(joined, oil.select("date", "dcoilwtico"), ["date"], "left")
    target = synthetic_target("unit_sales", "dcoilwtico", "f4", "date", "f5")
    return joined.withColumn("target", target).drop("f4", "f5", "dcoilwtico")


def star_view(
    sales: DataFrame,
    items: DataFrame,
    trans: DataFrame,
    stores: DataFrame,
    holidays: DataFrame,
    oil: DataFrame,
) -> DataFrame:
    """The training view: inner to items, transactions and stores, left to holidays and oil."""
    return (
        sales.join(items, "item_nbr")
        .join(trans, ["date", "store_nbr"])
        .join(stores, "store_nbr")
        .join(holidays, "date", "left")
        .join(oil, "date", "left")
    )
