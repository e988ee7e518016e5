"""Row-wise time-series operators; every one works per series and on long series."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreloom.functions.scalars import clean_numeric, log10p1
from foreloom.operators.kernel import MAX_D
from foreloom.plans import ordered as O
from foreloom.plans.joins import null_safe_join


def difference(
    df: DataFrame, keys: Sequence[str], d: int, ts: str = "ts", value: str = "value", name: str = "diff"
) -> DataFrame:
    """d-fold first difference as one weighted sum of lags; the first d rows drop out."""
    if d <= 0:
        return df.withColumn(name, F.col(value))
    weights = [(-1) ** k * math.comb(d, k) for k in range(d + 1)]

    def columns(w):
        terms = [F.lit(float(c)) * (F.lag(value, k).over(w) if k else F.col(value)) for k, c in enumerate(weights)]
        return {name: reduce(add, terms), "__at": F.lag(F.lit(1), d).over(w)}

    out = O.look_back(df, list(keys), [ts], columns, rows=d)
    return out.where(F.col("__at").isNotNull()).drop("__at")


def integrate(
    diffs: DataFrame,
    initial: DataFrame,
    keys: Sequence[str],
    d: int,
    order: str = "pos",
    value: str = "diff",
    name: str = "value",
) -> DataFrame:
    """Inverse of ``difference``: keys, order, value for the d initial rows and all later ones.

    ``diffs`` has keys, a position and the differences; ``initial`` has keys,
    positions 0..d-1 and the first d levels.  Each of the d rounds is a running
    sum that starts from the matching difference of the initial levels.
    """
    keys = list(keys)
    if not 0 <= d <= MAX_D:
        raise ValueError(f"d must be between 0 and {MAX_D}")
    if d == 0:
        return diffs.select(*keys, order, F.col(value).alias(name))
    levels = F.transform(F.array_sort(F.collect_list(F.struct(order, name))), lambda x: x[name])
    # d rows per series, so the group is bounded
    starts = initial.groupBy(*keys).agg(levels.alias("__start")) if keys else initial.agg(levels.alias("__start"))
    checked = F.when(F.size("__start") == d, F.col("__start")).otherwise(
        F.raise_error(F.lit("integrate: a series needs as many first levels as it was differenced"))
    )
    starts = starts.select(*keys, checked.alias("__start"))
    rows = diffs.select(*keys, order, F.col(value).alias("__w"))
    for level in range(d - 1, -1, -1):
        # value of the level-fold difference right before the first summed row
        at = reduce(
            add,
            [F.lit(float((-1) ** k * math.comb(level, k))) * F.col("__start")[d - 1 - k] for k in range(level + 1)],
        )
        summed = O.running_sums(rows, keys, [order], {"__s": "__w"})
        base = starts.select(*keys, at.alias("__base"))
        joined = null_safe_join(summed, F.broadcast(base) if not keys else base, keys) if keys else _with_row(summed, base)
        rows = joined.select(*keys, order, (F.col("__s") + F.col("__base")).alias("__w"))
    return initial.select(*keys, order, F.col(name).cast("double").alias(name)).unionByName(
        rows.select(*keys, order, F.col("__w").alias(name))
    )


def _with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Every row with the columns of a one-row frame, as scalar subqueries."""
    return df.select("*", *[one_row.select(c).scalar().alias(c) for c in one_row.columns])


def read_clean(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    value: str,
    drop_nulls: bool = True,
    log: bool = False,
) -> DataFrame:
    """keys, ts, value as double; optionally without NULLs and as log10(x + 1)."""
    v = F.col(value).cast("double")
    out = df.select(*keys, F.col(ts).alias("ts"), (log10p1(v) if log else v).alias("value"))
    return out.where(F.col("value").isNotNull()) if drop_nulls else out


def lag_features(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    columns: Sequence[str],
    lags: int,
    max_features: int | None = None,
) -> tuple[DataFrame, list[str]]:
    """Add ``<col>_lag_1..L`` per target column; the feature list is cut at ``max_features``."""

    def made(w):
        return {f"{c}_lag_{i}": F.lag(c, i).over(w) for c in columns for i in range(1, lags + 1)}

    names = [f"{c}_lag_{i}" for c in columns for i in range(1, lags + 1)]
    out = O.look_back(df, list(keys), [ts], made, rows=lags)
    return out, names[:max_features] if max_features else names


def target_columns(columns: Sequence[str], lags: int, max_features: int, single: bool = False) -> list[str]:
    """Targets that the allowed number of features can serve."""
    if single:
        return list(columns[:1])
    return list(columns[: math.ceil(min(len(columns) * lags, max_features) / lags)])


def supervised(
    df: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], lags: int, max_features: int
) -> tuple[DataFrame, list[str], list[str]]:
    """Training matrix: rows with complete lags, feature names and target names."""
    targets = target_columns(columns, lags, max_features)
    out, features = lag_features(df, keys, ts, targets, lags, max_features)
    return out.dropna(subset=features), features, targets


def ar_expression(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, phi: Sequence[float], name: str = "ar"
) -> DataFrame:
    """Autoregressive part from lags; a missing lag counts as 0."""

    def columns(w):
        terms = [
            F.coalesce(F.lag(value, j).over(w), F.lit(0.0)) * F.lit(float(f)) for j, f in enumerate(phi, start=1)
        ]
        return {name: reduce(add, terms, F.lit(0.0))}

    return O.look_back(df, list(keys), [ts], columns, rows=max(1, len(phi)))


def fill_gaps(df: DataFrame, keys: Sequence[str], ts: str, columns: Sequence[str], clean: bool = True) -> DataFrame:
    """Last observation carried forward, then 0."""
    columns = list(columns)
    if clean:
        df = df.withColumns({c: clean_numeric(c) for c in columns})
    return O.carry_forward(df, list(keys), [ts], columns).na.fill(0.0, columns)


def pivot_series(
    df: DataFrame,
    index: str,
    name: str,
    value: str,
    names: Sequence[str] | None = None,
    agg: Callable = F.first,
) -> DataFrame:
    """Long to wide, one column per series; give the names to save a pass over the data."""
    grouped = df.groupBy(index)
    pivoted = grouped.pivot(name, list(names)) if names else grouped.pivot(name)
    return pivoted.agg(agg(value))


def running_residual(df: DataFrame, keys: Sequence[str], ts: str, value: str, name: str = "s") -> DataFrame:
    """Running sum of the deviations from the mean of each series."""
    from foreloom.operators.stats import centred

    return O.running_sums(centred(df, keys, value, "__r"), list(keys), [ts], {name: "__r"}).drop("__r")
