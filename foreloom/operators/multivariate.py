"""Forecasts of wide series by boosted trees on lag features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreloom.functions.scalars import micros, seconds_interval
from foreloom.operators.joingraph import JoinGraph
from foreloom.operators.relational import latest_rows
from foreloom.operators.timeseries import lag_features
from foreloom.operators.trees import DecisionTree, DummyModel, GradientBoosting
from foreloom.sources.files import insert_ignore

# Settings of the boosted forecaster.
LEARNING_RATE = 0.1
NUM_LEAVES = 8
DEPTH = 3
TREES = 50
MORE_TREES = 10
DEFAULT_STEP = 600.0


def lag_graph(train: DataFrame, features: Sequence[str], target: str) -> JoinGraph:
    """A graph of one relation: the lag table."""
    return JoinGraph().add_relation("train", train, X=features, y=target)


def booster(trees: int = TREES, more: int = MORE_TREES) -> GradientBoosting:
    return GradientBoosting(NUM_LEAVES, LEARNING_RATE, DEPTH, n_estimators=trees, incremental_estimators=more)


def lag_rows(base: DataFrame, ts: str, targets: Sequence[str], lags: int, features: int) -> tuple[DataFrame, list[str]]:
    """Complete rows with their lag features."""
    out, names = lag_features(base, [], ts, targets, lags, features)
    return out.dropna(subset=names), names


def new_lag_rows(
    base: DataFrame, train: DataFrame, ts: str, targets: Sequence[str], lags: int, features: int
) -> DataFrame:
    """Lag rows after the newest row of the lag table.

    Only rows from lags + 1 steps before that date on are read, which is what
    the lags of the first new row need; rows that exist already are skipped.
    """
    last = train.agg(F.max(ts).alias("last")).first()["last"]
    if last is None:
        return lag_rows(base, ts, targets, lags, features)[0]
    newest = latest_rows(base.select(ts), [], ts, 2)
    gap = newest.agg((F.max(micros(ts)) - F.min(micros(ts))).alias("gap")).first()["gap"]
    look_back = (gap or 3_600_000_000) / 1e6 * (lags + 1)
    since = F.lit(last) - seconds_interval(F.lit(float(look_back)))
    recent, names = lag_features(base.where(F.col(ts) > since), [], ts, targets, lags, features)
    fresh = recent.where(F.col(ts) > F.lit(last)).dropna(subset=names)
    return insert_ignore(fresh, train, [ts])


def boost_on_new_rows(
    models: dict[str, GradientBoosting],
    base: DataFrame,
    train: DataFrame,
    ts: str,
    targets: Sequence[str],
    lags: int,
    features: int,
) -> tuple[dict[str, GradientBoosting], DataFrame]:
    """Add trees to every model on the lag rows that came since; returns models and the grown table."""
    fresh = new_lag_rows(base, train, ts, targets, lags, features)
    names = [f"{c}_lag_{i}" for c in targets for i in range(1, lags + 1)][:features]
    for target in targets:
        model = models.get(target) or booster()
        warm = target in models
        source = fresh if warm else train.unionByName(fresh)
        model.fit(lag_graph(source, names, target), skip_check=True, warm_start=warm)
        models[target] = model
    return models, train.unionByName(fresh)


def _feature(name: str) -> tuple[str, int]:
    column, lag = name.rsplit("_lag_", 1)
    return column, int(lag)


def recursive_lag_forecast(
    models: dict[str, DummyModel],
    rows: DataFrame,
    keys: Sequence[str],
    ts: str,
    lags: int,
    horizon: int,
    step_seconds: float | None = None,
    feedback: str = "carried",
) -> DataFrame:
    """keys, step, forecast_date and one column per target with a model.

    The newest rows of each series seed a fold over the horizon that evaluates
    the models' expressions inside Spark.  Lags of series without a model keep
    their last values.  With ``feedback="carried"`` every step takes over the
    target and the lags of the row before it, so a value enters the lags one
    step after it was predicted; ``"direct"`` feeds it back at once.
    """
    if feedback not in ("carried", "direct"):
        raise ValueError(f"unknown feedback {feedback}")
    keys, targets = list(keys), list(models)
    columns = [c for c in rows.columns if c not in (*keys, ts)]
    newest = latest_rows(rows.select(*keys, ts, *columns), keys, ts, max(lags, 2))
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct(F.col(ts).alias("__ts"), *columns))))
    grouped = newest.groupBy(*keys) if keys else newest.groupBy()
    gap = (F.max(micros(ts)) - F.min(micros(ts))) / 1e6
    seeds = grouped.agg(ordered.alias("__o"), F.max(ts).alias("__last"))
    first_two = F.slice("__o", F.lit(1), F.lit(2))
    spacing = F.when(
        F.size(first_two) == 2, (micros(first_two[0]["__ts"]) - micros(first_two[1]["__ts"])) / 1e6
    ).otherwise(DEFAULT_STEP)
    step = F.lit(step_seconds) if step_seconds else spacing

    def series(c) -> Column:
        # a lag beyond the stored rows counts as 0
        values = F.transform("__o", lambda r: r[c].cast("double"))
        return F.transform(F.sequence(F.lit(1), F.lit(lags)), lambda i: F.coalesce(F.get(values, i - 1), F.lit(0.0)))

    seeds = seeds.select(*keys, "__last", step.alias("__step"), *[series(c).alias(f"__s_{c}") for c in columns])
    fields = [F.col(f"__s_{c}").alias(f"l_{c}") for c in targets]
    fields += [F.col(f"__s_{c}")[0].alias(f"y_{c}") for c in targets]
    empty = ", ".join(f"{c}: double" for c in targets)
    start = F.struct(*fields, F.array().cast(f"array<struct<{empty}>>").alias("out"))

    def advance(acc, _):
        def resolve(split):
            c, lag = _feature(split.feature)
            return acc[f"l_{c}"][lag - 1] if c in targets else F.col(f"__s_{c}")[lag - 1]

        made = {c: models[c].to_column_of(resolve) for c in targets}
        entering = {c: acc[f"y_{c}"] if feedback == "carried" else made[c] for c in targets}
        shifted = [
            F.slice(F.concat(F.array(entering[c]), acc[f"l_{c}"]), F.lit(1), F.lit(lags)).alias(f"l_{c}")
            for c in targets
        ]
        values = [made[c].alias(f"y_{c}") for c in targets]
        row = F.struct(*[made[c].alias(c) for c in targets])
        return F.struct(*shifted, *values, F.concat(acc["out"], F.array(row)).alias("out"))

    folded = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, advance, lambda acc: acc["out"])
    rows_out = seeds.select(*keys, "__last", "__step", F.posexplode(folded).alias("__i", "__r"))
    number = F.col("__i") + 1
    return rows_out.select(
        *keys,
        number.alias("step"),
        (F.col("__last") + seconds_interval(F.col("__step") * number)).alias("forecast_date"),
        *[F.col(f"__r.{c}").alias(c) for c in targets],
    )
