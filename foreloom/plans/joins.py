"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreloom.session import broadcast_rows, cut, fits, group_rows

SALTS = 64


def key_match(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], null_safe: bool) -> Column:
    pairs = [
        left[l].eqNullSafe(right[r]) if null_safe else left[l] == right[r] for l, r in on
    ]
    return reduce(lambda a, b: a & b, pairs)


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on same-named keys in which NULL meets NULL; keys appear once."""
    if not on:
        raise ValueError("at least one key is needed")
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in on],
        *[F.col(c) for c in right.columns if c not in on],
    )
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in on])
    out = left.join(renamed, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{k}" for k in on])


def heavy_keys(rows: DataFrame, on: list[str]) -> DataFrame | None:
    """Keys with more rows than a task should hold, at least one in ``broadcast_rows`` of all; None if there are none.

    The rows are read once, and a second time only where some key is as frequent as that.
    """
    spark = rows.sparkSession
    sizes = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    heavy = cut(sizes.where(F.col("__n") > group_rows(spark)))
    if heavy.isEmpty():
        return None
    least = -(-rows.count() // broadcast_rows(spark))
    heavy = heavy.where(F.col("__n") > least).select(*on, F.lit(True).alias("__heavy"))
    return None if heavy.isEmpty() else heavy


def attach(
    rows: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "inner",
    small: bool | None = None,
    spread: str | None = None,
    heavy: Callable[[], DataFrame | None] | None = None,
) -> DataFrame:
    """Join many rows with a lookup that has one row per key.

    A lookup that was measured to be small is broadcast.  With a larger one the keys of ``rows`` are counted: where none
    has more rows than a task should hold, it is a plain join.  Otherwise only the lookup rows of these heavy keys are
    copied over ``SALTS`` salts, and only rows of such keys pick one, from their own content (or from the column
    ``spread``).  A heavy key has at least one in ``broadcast_rows`` of all rows, so that there are few of them.  ``heavy``
    gives the ``heavy_keys`` of the rows where they were counted before.
    """
    spark = rows.sparkSession
    if small is None:
        small = fits(lookup, broadcast_rows(spark))
    if small:
        return rows.join(F.broadcast(lookup), on, how)
    found = heavy() if heavy else heavy_keys(rows, on)
    if found is None:
        return rows.join(lookup, on, how)
    others = [spread] if spread else [c for c in rows.columns if c not in on] or rows.columns
    salt = F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int")
    salted = null_safe_join(rows, F.broadcast(found), on, "left")
    salted = salted.withColumn("__salt", F.when(F.col("__heavy"), salt).otherwise(0)).drop("__heavy")
    copies = F.when(F.col("__heavy"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = null_safe_join(lookup, F.broadcast(found), on, "left").withColumn("__salt", F.explode(copies)).drop("__heavy")
    return salted.join(copied, [*on, "__salt"], how).drop("__salt")
