"""Ordered computations inside key groups, also for groups that no task can hold.

Every function first measures the largest group.  Up to the limit of the
session a plain window is used: one shuffle on the keys.  Above it the rows are
range-partitioned by (keys, order) and written once, which splits a long group
into consecutive slices; sums, counts and last values of the slices are carried
over in a window that holds one row per slice.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreloom.plans.joins import null_safe_join
from foreloom.session import group_rows, shuffle_partitions, stage

SLICE = "__slice"
MAX_SLICES = 20_000


def group_sizes(df: DataFrame, keys: list[str], name: str = "n") -> DataFrame:
    counted = df.groupBy(*keys) if keys else df.groupBy()
    return counted.agg(F.count(F.lit(1)).alias(name))


def largest_group(df: DataFrame, keys: list[str]) -> int:
    return group_sizes(df, keys).agg(F.max("n")).first()[0] or 0


def is_long(df: DataFrame, keys: list[str], limit: int | None = None) -> bool:
    return largest_group(df, keys) > (limit or group_rows(df.sparkSession))


def sliced(df: DataFrame, keys: list[str], order: list[str], limit: int | None = None) -> DataFrame:
    """Rows range-partitioned by (keys, order), with the slice number kept as a column.

    The range bounds come from a sample, so the result is written before use:
    every reader then sees the same slices, also after a lost executor.
    """
    rows = limit or group_rows(df.sparkSession)
    parts = min(MAX_SLICES, max(2, math.ceil(df.count() / rows)))
    cut_up = df.repartitionByRange(parts, *keys, *order).withColumn(SLICE, F.spark_partition_id())
    return stage(cut_up, "slices")


def _window(keys: list[str], order: list[str]):
    spec = Window.partitionBy(*keys) if keys else Window.partitionBy()
    return spec.orderBy(*order)


def _carried(df: DataFrame, keys: list[str], totals: dict[str, Column]) -> DataFrame:
    """Per slice, the sum of the totals of all earlier slices of its group."""
    per_slice = df.groupBy(*keys, SLICE).agg(*[c.alias(n) for n, c in totals.items()])
    before = _window(keys, [SLICE]).rowsBetween(Window.unboundedPreceding, -1)
    return per_slice.select(
        *keys, SLICE, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in totals]
    )


def _beside(cut_up: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Slices with what is carried to them, over at least as many tasks as there are slices."""
    parts = max(cut_up.agg(F.max(SLICE)).first()[0] + 1, shuffle_partitions(cut_up.sparkSession))
    return null_safe_join(cut_up, carried, [*keys, SLICE]).repartition(parts, *keys, SLICE)


def positions(
    df: DataFrame, keys: list[str], order: list[str], name: str = "pos", limit: int | None = None
) -> DataFrame:
    """Zero-based position of every row in the order of its group."""
    if not is_long(df, keys, limit):
        return df.withColumn(name, F.row_number().over(_window(keys, order)).cast("long") - 1)
    cut_up = sliced(df, keys, order, limit)
    offsets = _carried(cut_up, keys, {"__offset": F.count(F.lit(1))})
    placed = _beside(cut_up, offsets, keys)
    inside = F.row_number().over(_window([*keys, SLICE], order)).cast("long") - 1
    return placed.withColumn(name, inside + F.col("__offset")).drop("__offset", SLICE)


def running_sums(
    df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], limit: int | None = None
) -> DataFrame:
    """Running sums of columns (new name -> column); the order must be unique in a group."""
    upto = (Window.unboundedPreceding, Window.currentRow)
    if not is_long(df, keys, limit):
        w = _window(keys, order).rowsBetween(*upto)
        return df.select("*", *[F.sum(c).over(w).alias(n) for n, c in sums.items()])
    cut_up = sliced(df, keys, order, limit)
    offsets = _carried(cut_up, keys, {f"__before_{n}": F.sum(c) for n, c in sums.items()})
    joined = _beside(cut_up, offsets, keys)
    w = _window([*keys, SLICE], order).rowsBetween(*upto)
    return joined.select(
        *df.columns, *[(F.sum(c).over(w) + F.col(f"__before_{n}")).alias(n) for n, c in sums.items()]
    )


def peer_running_sums(
    df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], limit: int | None = None
) -> DataFrame:
    """Running sums in which rows with equal order values share the total (a RANGE frame).

    Peers are added up first, so a value shared by very many rows is reduced
    before it is ordered.
    """
    peers = df.groupBy(*keys, *order).agg(*[F.sum(c).alias(c) for c in dict.fromkeys(sums.values())])
    return running_sums(peers, keys, order, sums, limit).select(*keys, *order, *sums)


def look_back(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: Callable[[object], dict[str, Column]],
    rows: int,
    limit: int | None = None,
) -> DataFrame:
    """Window columns that look at most ``rows`` rows back, e.g. lags.

    ``columns`` receives an ordered window and returns name -> column.  Long
    groups are cut into chunks of equal length, each with a halo of the rows
    just before it, and the halo rows are dropped at the end.
    """
    if not is_long(df, keys, limit):
        made = columns(_window(keys, order))
        return df.select("*", *[c.alias(n) for n, c in made.items()])
    length = max(limit or group_rows(df.sparkSession), rows + 1)
    placed = positions(df, keys, order, "__pos", limit)
    chunk = F.floor(F.col("__pos") / length)
    near_end = F.col("__pos") % length >= length - rows
    spread = placed.withColumn(
        "__chunk", F.explode(F.when(near_end, F.array(chunk, chunk + 1)).otherwise(F.array(chunk)))
    )
    made = columns(_window([*keys, "__chunk"], ["__pos"]))
    out = spread.select("*", *[c.alias(n) for n, c in made.items()])
    return out.where(chunk == F.col("__chunk")).drop("__pos", "__chunk")


def carry_forward(
    df: DataFrame, keys: list[str], order: list[str], columns: list[str], limit: int | None = None
) -> DataFrame:
    """Replace NULLs by the last value seen before them in the group."""
    upto = (Window.unboundedPreceding, Window.currentRow)
    others = [c for c in df.columns if c not in columns]
    if not is_long(df, keys, limit):
        w = _window(keys, order).rowsBetween(*upto)
        filled = [F.last(c, ignorenulls=True).over(w).alias(c) for c in columns]
        return df.select(*others, *filled).select(*df.columns)
    cut_up = sliced(df, keys, order, limit)
    place = F.struct(*order)
    per_slice = cut_up.groupBy(*keys, SLICE).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(f"__end_{c}") for c in columns]
    )
    before = _window(keys, [SLICE]).rowsBetween(Window.unboundedPreceding, -1)
    seen = per_slice.select(
        *keys,
        SLICE,
        *[F.last(f"__end_{c}", ignorenulls=True).over(before).alias(f"__seen_{c}") for c in columns],
    )
    joined = _beside(cut_up, seen, keys)
    w = _window([*keys, SLICE], order).rowsBetween(*upto)
    filled = [
        F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"__seen_{c}")).alias(c) for c in columns
    ]
    return joined.select(*others, *filled).select(*df.columns)
