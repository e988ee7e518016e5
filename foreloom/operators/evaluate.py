"""Forecast errors and evaluation over rolling or fixed cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreloom.functions.scalars import log10p1
from foreloom.operators.css import fold_states
from foreloom.operators.fit import autoarima_fit, fit_candidates
from foreloom.operators.forecast import DAY, forecast_from_state
from foreloom.plans.ordered import positions
from foreloom.plans.packed import pack
from foreloom.session import cut

# Fixed value: keeps the relative error finite.
EPSILON = 1e-12


def _paired(forecasts: DataFrame, actuals: DataFrame, keys: Sequence[str], step: str) -> DataFrame:
    f = forecasts.select(*keys, step, F.col("forecast_value").alias("f"))
    a = actuals.select(*keys, step, F.col("value").alias("a"))
    return f.join(a, [*keys, step])


def rmse_expr(f: str = "f", a: str = "a"):
    """Root mean squared error; 0 without rows."""
    gap = F.col(f) - F.col(a)
    return F.coalesce(F.sqrt(F.avg(gap * gap)), F.lit(0.0))


def msmape_expr(f: str = "f", a: str = "a"):
    """Mean symmetric percentage error with a floor under the divisor; 0 without rows."""
    size = (F.abs(F.col(a)) + F.abs(F.col(f))) / 2.0 + EPSILON
    share = F.abs(F.col(f) - F.col(a)) / F.greatest(size, F.lit(0.5 + EPSILON))
    return F.coalesce(100.0 * F.avg(share), F.lit(0.0))


def rmse(forecasts: DataFrame, actuals: DataFrame, keys: Sequence[str], step: str = "step") -> DataFrame:
    """Error per group over the steps that both sides have."""
    return _paired(forecasts, actuals, keys, step).groupBy(*keys).agg(rmse_expr().alias("rmse"))


def msmape(forecasts: DataFrame, actuals: DataFrame, keys: Sequence[str], step: str = "step") -> DataFrame:
    return _paired(forecasts, actuals, keys, step).groupBy(*keys).agg(msmape_expr().alias("msmape"))


def _models(rows: DataFrame, keys: list[str], order: tuple[int, int, int] | None, include_mean: bool) -> DataFrame:
    """keys, phi, theta, c, d, use_log: a fit of one order, or with no order given an automatic search."""
    if order is None:
        best = autoarima_fit(rows, keys)
        return best.select(*keys, "phi", "theta", "c", F.col("d").cast("int").alias("d"), "use_log")
    p, d, q = order
    packed = pack(rows, keys)
    wanted = packed.frame.where("chunk = 0").select(*keys, F.lit(p).alias("p"), F.lit(d).alias("d"), F.lit(q).alias("q"), F.lit(include_mean).alias("constant"))
    fits = fit_candidates(packed, wanted)
    return fits.select(*keys, "phi", "theta", "c", F.col("d").cast("int").alias("d"), F.lit(False).alias("use_log"))


def replayed_states(rows: DataFrame, models: DataFrame, keys: list[str], cuts: Sequence[int]) -> DataFrame:
    """keys, cut and the state of each model once the first ``cut`` rows were inserted, with the time of the last one.

    Rows between two cuts are folded into the state at the first of them, so that every row is read once and no prefix
    is copied.  ``rows`` has keys, ts, value and pos (from 0).
    """
    logged = rows.join(models.select(*keys, "use_log"), keys)
    logged = logged.withColumn("value", F.when(F.col("use_log"), log10p1("value")).otherwise(F.col("value")))
    out, before, points = None, 0, models.select(*keys, "phi", "theta", "c", "d")
    for number in sorted(cuts):
        part = logged.where((F.col("pos") >= before) & (F.col("pos") < number)).select(*keys, "ts", "value")
        packed = pack(part, keys)
        ends = packed.frame.groupBy(*keys).agg(F.max("last_ts").alias("last_ts"))
        states = cut(fold_states(packed, points, []).join(ends, keys))
        at = states.select(*keys, F.lit(number).alias("cut"), "state", "last_ts")
        out = at if out is None else out.unionByName(at)
        points = models.select(*keys, "phi", "theta", "c", "d").join(states.select(*keys, "state"), keys)
        before = number
    return out


def rolling_origin_eval(
    df: DataFrame,
    keys: Sequence[str],
    cuts: Sequence[int],
    horizon: int,
    order: tuple[int, int, int] | None = None,
    ts: str = "ts",
    value: str = "value",
    include_mean: bool = True,
    models: DataFrame | None = None,
    step: str = DAY,
) -> DataFrame:
    """keys, cut, rmse, msmape, n: at every cut the forecast of the model that was stored at the first one, by replay.

    The model is fitted once on the first rows (by a search where no ``order`` is given) or comes as ``models`` (keys,
    phi, theta, c, d, use_log).  Then rows are inserted: each cut's state is the one before, advanced by the rows in
    between, and forecasts are made from states alone.  Series shorter than a cut have no row for it.
    """
    keys, cuts = list(keys), sorted(cuts)
    rows = positions(df.select(*keys, F.col(ts).alias("ts"), F.col(value).cast("double").alias("value")).where(F.col(value).isNotNull()), keys, ["ts"])
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    rows = cut(rows.join(sizes, keys).where(F.col("n_rows") >= cuts[0]))
    if models is None:
        models = cut(_models(rows.where(F.col("pos") < cuts[0]).select(*keys, "ts", "value"), keys, order, include_mean))
    states = replayed_states(rows, models, keys, cuts)
    enough = rows.select(*keys, "n_rows").distinct()
    states = states.join(enough, keys).where(F.col("cut") <= F.col("n_rows")).join(models.select(*keys, "phi", "theta", "c", "use_log"), keys)
    groups = [*keys, "cut"]
    forecasts = forecast_from_state(states.drop("n_rows"), groups, horizon, step)
    ahead = F.explode(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: (F.col("pos") >= c) & (F.col("pos") < c + horizon)))
    actual = rows.withColumn("cut", ahead).withColumn("step", (F.col("pos") - F.col("cut") + 1).cast("int"))
    pairs = _paired(forecasts, actual, groups, "step")
    return pairs.groupBy(*groups).agg(rmse_expr().alias("rmse"), msmape_expr().alias("msmape"), F.count("*").alias("n"))


def fixed_window_eval(
    df: DataFrame,
    keys: Sequence[str],
    horizon: int,
    order: tuple[int, int, int] | None = None,
    ts: str = "ts",
    value: str = "value",
    frequency: str | None = None,
    step: str = DAY,
) -> DataFrame:
    """keys, rmse, msmape: the last ``horizon`` rows of each series are held out once.

    Without an ``order`` one is searched for each series.  With ``frequency`` (a column of ``df``) the result has a row
    for each class of series instead, with the means over its series and their number.
    """
    keys = list(keys)
    named = [F.col(c) for c in ([frequency] if frequency else [])]
    rows = positions(df.select(*keys, *named, F.col(ts).alias("ts"), F.col(value).cast("double").alias("value")).where(F.col(value).isNotNull()), keys, ["ts"])
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    marked = rows.join(sizes, keys)
    held = F.col("pos") >= F.col("n") - horizon
    train = cut(marked.where(~held).select(*keys, "ts", "value"))
    actual = marked.where(held).withColumn("step", (F.col("pos") - (F.col("n") - horizon) + 1).cast("int"))
    models = cut(_models(train, keys, order, True))
    logged = train.join(models.select(*keys, "use_log"), keys)
    packed = pack(logged.withColumn("value", F.when(F.col("use_log"), log10p1("value")).otherwise(F.col("value"))), keys)
    ends = packed.frame.groupBy(*keys).agg(F.max("last_ts").alias("last_ts"))
    states = fold_states(packed, models.drop("use_log"), []).join(ends, keys).join(models.select(*keys, "phi", "theta", "c", "use_log"), keys)
    forecasts = forecast_from_state(states, keys, horizon, step)
    out = _paired(forecasts, actual, keys, "step").groupBy(*keys).agg(rmse_expr().alias("rmse"), msmape_expr().alias("msmape"))
    if frequency is None:
        return out
    classes = rows.groupBy(*keys).agg(F.first(frequency).alias(frequency))
    return out.join(classes, keys).groupBy(frequency).agg(F.avg("rmse").alias("rmse"), F.avg("msmape").alias("msmape"), F.count("*").alias("series"))


def benchmark_summary(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean insert and forecast times, summed error and mean relative error of benchmark rows."""
    grouped = results.groupBy(*keys) if keys else results.groupBy()
    return grouped.agg(
        F.avg("insert_seconds").alias("avg_insert"),
        F.avg("forecast_seconds").alias("avg_forecast"),
        F.sum("rmse").alias("sum_rmse"),
        F.avg("msmape").alias("avg_msmape"),
    )
