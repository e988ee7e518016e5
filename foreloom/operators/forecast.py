"""Forecasts from fits or stored states; only the newest rows of a series are read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreloom.functions.scalars import inv_log10p1, log10p1
from foreloom.operators.fit import (
    arima_fit,
    autoarima_search,
    best_candidate,
    fit_candidates,
    prepare_search,
)
from foreloom.operators.kernel import MAX_D, MAX_P
from foreloom.operators.relational import latest_rows
from foreloom.session import cut

DAY = "1 day"


def _doubles(c: Column) -> Column:
    return F.coalesce(c, F.array()).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays; positions that one of them lacks count as 0."""
    pairs = F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0)))
    return F.aggregate(pairs, F.lit(0.0), lambda s, v: s + v)


def forecast_array(
    phi: Column,
    theta: Column,
    c: Column,
    newest: Column,
    errors: Column,
    levels: Column,
    d: Column,
    horizon: int,
) -> Column:
    """Forecast values as an array.

    ``newest`` are the last differenced values, ``errors`` the last residuals
    and ``levels`` the last d original values, all newest first.  Residuals of
    the future are 0.
    """
    phi, theta, newest = _doubles(phi), _doubles(theta), _doubles(newest)
    errors, levels = _doubles(errors), _doubles(levels)
    p = F.size(phi)
    # weights that turn a difference back into a level, by d
    back = (
        F.when(d == 1, F.array(F.lit(1.0)))
        .when(d == 2, F.array(F.lit(2.0), F.lit(-1.0)))
        .otherwise(F.array().cast("array<double>"))
    )
    start = F.struct(
        F.slice(newest, F.lit(1), p).alias("y"),
        errors.alias("e"),
        F.slice(levels, F.lit(1), d).alias("x"),
        F.array().cast("array<double>").alias("out"),
    )

    def step(acc, _):
        w = c + dot(phi, acc["y"]) + dot(theta, acc["e"])
        level = w + dot(back, acc["x"])
        return F.struct(
            F.slice(F.concat(F.array(w), acc["y"]), F.lit(1), p).alias("y"),
            F.slice(F.concat(F.array(F.lit(0.0)), acc["e"]), F.lit(1), F.size(theta)).alias("e"),
            F.slice(F.concat(F.array(level), acc["x"]), F.lit(1), d).alias("x"),
            F.concat(acc["out"], F.array(level)).alias("out"),
        )

    if horizon < 1:
        raise ValueError("horizon must be positive")
    steps = F.sequence(F.lit(1), F.lit(horizon))
    value = F.aggregate(steps, start, step, lambda acc: acc["out"])
    short = F.raise_error(F.lit("forecast: the state holds fewer levels than its differences need"))
    return F.when(F.size(levels) < d, short.cast("array<double>")).otherwise(value)


def _dated(df: DataFrame, keys: Sequence[str], values: Column, use_log: Column, step: Column) -> DataFrame:
    rows = df.select(
        *keys, "last_ts", use_log.alias("__log"), step.alias("__step"), F.posexplode(values).alias("__i", "__v")
    )
    i = F.col("__i") + 1
    return rows.select(
        *keys,
        i.alias("step"),
        (F.col("last_ts") + F.col("__step") * i).alias("forecast_date"),
        F.when(F.col("__log"), inv_log10p1("__v")).otherwise(F.col("__v")).alias("forecast_value"),
    )


def interval(step: str | Column) -> Column:
    return F.expr(f"INTERVAL {step}") if isinstance(step, str) else step


def tails(df: DataFrame, keys: Sequence[str], ts: str, value: str, rows: int = MAX_P + MAX_D) -> DataFrame:
    """keys, last_ts and the newest values (newest first), without sorting the history."""
    keys = list(keys)
    clean = df.select(*keys, F.col(ts).alias("ts"), F.col(value).cast("double").alias("value"))
    newest = latest_rows(clean.where(F.col("value").isNotNull()), keys, "ts", rows)
    grouped = newest.groupBy(*keys) if keys else newest.groupBy()
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("ts", "value"))))
    out = grouped.agg(F.max("ts").alias("last_ts"), ordered.alias("o"))
    return out.select(*keys, "last_ts", F.transform("o", lambda x: x["value"]).alias("newest"))


def arima_run_forecast(
    df: DataFrame,
    fits: DataFrame,
    keys: Sequence[str],
    horizon: int,
    step: str | Column = DAY,
    ts: str = "ts",
    value: str = "value",
) -> DataFrame:
    """Forecast with given fit results (keys, d, phi, theta, c, residuals, optional use_log)."""
    keys = list(keys)
    if "use_log" not in fits.columns:
        fits = fits.withColumn("use_log", F.lit(False))
    end = tails(df, keys, ts, value)
    joined = end.join(fits, keys) if keys else attach_single(end, fits)
    logged = F.when(F.col("use_log"), F.transform("newest", lambda x: log10p1(x))).otherwise(F.col("newest"))
    d = F.col("d")
    first = F.zip_with(F.slice(logged, F.lit(1), F.size(logged) - 1), F.slice(logged, F.lit(2), F.size(logged) - 1), lambda a, b: a - b)
    second = F.zip_with(F.slice(first, F.lit(1), F.size(first) - 1), F.slice(first, F.lit(2), F.size(first) - 1), lambda a, b: a - b)
    diffs = F.when(d == 0, logged).when(d == 1, first).otherwise(second)
    values = forecast_array(
        F.col("phi"), F.col("theta"), F.col("c"), diffs, F.col("residuals"), F.slice(logged, F.lit(1), d), d, horizon
    )
    return _dated(joined, keys, values, F.col("use_log"), interval(step))


def attach_single(one: DataFrame, other: DataFrame) -> DataFrame:
    """Join of two one-row frames."""
    left, right = one.withColumn("__k", F.lit(1)), other.withColumn("__k", F.lit(1))
    return left.join(right, "__k").drop("__k")


def forecast_from_state(
    states: DataFrame, keys: Sequence[str], horizon: int, step: str | Column = DAY
) -> DataFrame:
    """Forecast from stored states: keys, last_ts, phi, theta, c, state, optional use_log.

    Reads no history; a state with fewer than d stored levels is an error.
    """
    keys = list(keys)
    if "use_log" not in states.columns:
        states = states.withColumn("use_log", F.lit(False))
    s = F.col("state")
    levels = F.reverse(F.slice(s["diff_buf"], F.lit(1), s["n_diff"]))
    values = forecast_array(
        F.col("phi"), F.col("theta"), F.col("c"), s["y_lags"], s["e_lags"], levels, s["d"], horizon
    )
    return _dated(states, keys, values, F.col("use_log"), interval(step))


def risky(fits: DataFrame) -> DataFrame:
    """Add ``warning``: which coefficients lie outside (-1, 1), and whether the search was cut off."""

    def outside(name):
        return F.exists(name, lambda x: (x <= -1.0) | (x >= 1.0))

    text = F.concat_ws(
        ", ",
        F.when(outside("phi"), F.lit("AR coefficients outside (-1, 1)")),
        F.when(outside("theta"), F.lit("MA coefficients outside (-1, 1)")),
        F.when(~F.col("converged"), F.lit("search not converged")) if "converged" in fits.columns else F.lit(None).cast("string"),
    )
    return fits.withColumn("warning", F.nullif(text, F.lit("")))


def arima_train_and_forecast(
    df: DataFrame,
    keys: Sequence[str],
    order: tuple[int, int, int],
    horizon: int,
    ts: str = "ts",
    value: str = "value",
    include_mean: bool = True,
    log: bool = False,
    method: str = "L-BFGS",
    step: str | Column = DAY,
) -> DataFrame:
    """Fit one order per series and forecast: keys, step, forecast_date, forecast_value, warning."""
    keys = list(keys)
    fits = risky(arima_fit(df, keys, order, ts, value, include_mean, method, log))
    fits = fits.withColumn("use_log", F.lit(log))
    out = arima_run_forecast(df, fits, keys, horizon, step, ts, value)
    return out.join(fits.select(*keys, "warning"), keys) if keys else out


def autoarima_train_and_forecast(
    df: DataFrame,
    keys: Sequence[str],
    horizon: int,
    ts: str = "ts",
    value: str = "value",
    step: str | Column = DAY,
) -> DataFrame:
    """Search an order per series, then refit it and forecast; the constant stays if it is not 0."""
    keys = list(keys)
    packed, plan = prepare_search(df, keys, ts, value)
    best = best_candidate(autoarima_search(packed, plan), keys)
    again = best.select(*keys, "p", "d", "q", (F.col("c") != 0.0).alias("constant"))
    fits = cut(fit_candidates(packed, again).join(plan.select(*keys, "use_log"), keys))
    packed.frame.unpersist()
    return arima_run_forecast(df, fits, keys, horizon, step, ts, value)
