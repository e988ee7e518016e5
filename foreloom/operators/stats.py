"""Series statistics, autocovariance and the level stationarity test."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreloom.operators.css import as_array, ddl
from foreloom.operators.kernel import MAX_D, differenced
from foreloom.plans import ordered as O
from foreloom.plans.joins import attach
from foreloom.plans.packed import Packed

# Significance levels of the test and their critical values.
KPSS_CRITICAL = {0.1: 0.347, 0.05: 0.463, 0.025: 0.574, 0.01: 0.739}
# Fixed values of the automatic lag rule.
LAG_SCALE = 1.1447
LAG_CAP = 12.0
# Fixed values of the automatic log rule and of the choice of d.
LOG_CV = 0.3
MAX_KPSS_ROUNDS = 3


def with_totals(df: DataFrame, aggregates: dict[str, Column]) -> DataFrame:
    """Every row with global aggregates, read as scalar subqueries."""
    one = df.agg(*[c.alias(n) for n, c in aggregates.items()])
    return df.select("*", *[one.select(n).scalar().alias(n) for n in aggregates])


def series_stats(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Minimum, population deviation, mean and count of each series."""
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    return grouped.agg(
        F.min(value).alias("min_val"),
        F.stddev_pop(value).alias("std_dev"),
        F.avg(value).alias("mean"),
        F.count(value).alias("n"),
    )


def log_rule(stats: DataFrame) -> DataFrame:
    """Add ``use_log``: nothing negative and a coefficient of variation above the limit."""
    cv = F.coalesce(F.try_divide(F.col("std_dev"), F.nullif(F.col("mean"), F.lit(0.0))), F.lit(0.0))
    return stats.withColumn("use_log", (F.col("min_val") >= 0) & (cv > LOG_CV))


def centred(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the deviation from the mean of the series."""
    if not keys:
        out = with_totals(df, {"__mean": F.avg(value)})
    else:
        out = attach(df, df.groupBy(*keys).agg(F.avg(value).alias("__mean")), list(keys))
    return out.withColumn(name, F.col(value) - F.col("__mean")).drop("__mean")


def autocovariance(
    df: DataFrame, keys: Sequence[str], max_lag: int, ts: str = "ts", value: str = "value"
) -> DataFrame:
    """keys, lag, gamma for lags 0..K, from lag products added up before the shuffle."""
    keys = list(keys)
    rows = centred(df.select(*keys, ts, value), keys, value, "__r")

    def columns(w):
        return {f"__l{k}": F.lag("__r", k).over(w) for k in range(1, max_lag + 1)}

    lagged = O.look_back(rows, keys, [ts], columns, rows=max(1, max_lag))
    sums = [F.sum(F.col("__r") * (F.col(f"__l{k}") if k else F.col("__r"))) for k in range(max_lag + 1)]
    totals = [F.coalesce(s, F.lit(0.0)) for s in sums]
    grouped = lagged.groupBy(*keys) if keys else lagged.groupBy()
    one = grouped.agg(F.array(*totals).alias("g"), F.count("__r").alias("n"))
    return one.select(*keys, F.posexplode("g").alias("lag", "g"), "n").select(
        *keys, "lag", (F.col("g") / F.col("n")).alias("gamma")
    )


def _lags_needed(n: float) -> int:
    """Lags that the rule can look at for a series of n values."""
    return max(int(n ** (2.0 / 9.0)), int(LAG_CAP * (n / 100.0) ** 0.25), 1)


def longest(packed: Packed) -> int:
    return packed.frame.agg(F.max("n_total")).first()[0] or 0


def kpss_halo(n: int) -> int:
    """Halo that packed series need for the test."""
    return _lags_needed(n) + MAX_D + 1


def moments(packed: Packed, orders: Sequence[int] = (0,)) -> DataFrame:
    """Per series and d: n, the sum of squared running sums, and lag products of the deviations.

    A chunk reports products with the deviations just before it (its halo), and
    its running sums from zero; the sum carried in from earlier chunks enters
    as n*S0^2 + 2*S0*sum(s) + sum(s^2).
    """
    keys = packed.keys
    orders = list(orders)
    frame = packed.frame
    if packed.long:
        means = _difference_means(packed, orders)
        frame = attach(frame, means, keys, spread="chunk") if keys else _one_row(frame, means)
    else:
        frame = frame.withColumn("means", F.lit(None).cast("array<double>"))
    names = [*keys, "chunk", "d", "n_total", "n_own", "sum_r", "sum_s", "sum_s2", "g"]

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                halo, vals, first = as_array(row.halo), as_array(row.vals), int(row.first)
                means = row.means
                for at, d in enumerate(orders):
                    before, own, _ = differenced(halo, vals, first, d)
                    n = int(row.n_total) - d
                    if n <= 0 or not len(own):
                        continue
                    mean = float(own.mean()) if means is None else float(means[at])
                    r = np.concatenate([before, own]) - mean
                    mine = r[len(before) :]
                    lags = min(_lags_needed(n), n - 1)
                    if len(before) < lags and first > 0:
                        raise ValueError("the packed halo is shorter than the lags of the test")
                    g = [float(mine @ mine)]
                    for k in range(1, lags + 1):
                        late = mine[max(0, k - len(before)) :]
                        start = len(before) + max(0, k - len(before)) - k
                        g.append(float(late @ r[start : start + len(late)]))
                    s = np.cumsum(mine)
                    rows.append(
                        (
                            *[getattr(row, k) for k in keys],
                            row.chunk,
                            d,
                            n,
                            len(own),
                            float(mine.sum()),
                            float(s.sum()),
                            float(s @ s),
                            g,
                        )
                    )
            yield pd.DataFrame(rows, columns=names)

    schema = (
        f"{ddl(packed.frame, [*keys, 'chunk'])}, d int, n_total long, n_own long, sum_r double, "
        "sum_s double, sum_s2 double, g array<double>"
    )
    parts = frame.select(*keys, "chunk", "first", "halo", "vals", "n_total", "means").mapInPandas(run, schema)
    if not packed.long:
        return parts.select(*keys, "d", F.col("n_total").alias("n"), F.col("sum_s2").alias("eta"), "g")
    w = Window.partitionBy(*keys, "d").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = F.coalesce(F.sum("sum_r").over(w), F.lit(0.0))
    small = parts.drop("g").withColumn("s0", carried)
    eta = F.sum(
        F.col("n_own") * F.col("s0") * F.col("s0") + 2.0 * F.col("s0") * F.col("sum_s") + F.col("sum_s2")
    )
    etas = small.groupBy(*keys, "d").agg(F.max("n_total").alias("n"), eta.alias("eta"))
    lagged = parts.select(*keys, "d", F.posexplode("g").alias("lag", "v"))
    summed = lagged.groupBy(*keys, "d", "lag").agg(F.sum("v").alias("v"))
    # one value per lag of the rule: bounded by the lag cap, not by the series
    arrays = summed.groupBy(*keys, "d").agg(F.array_sort(F.collect_list(F.struct("lag", "v"))).alias("a"))
    arrays = arrays.select(*keys, "d", F.transform("a", lambda x: x["v"]).alias("g"))
    return etas.join(arrays, [*keys, "d"])


def _one_row(frame: DataFrame, means: DataFrame) -> DataFrame:
    return frame.withColumn("means", means.select("means").scalar())


def _difference_means(packed: Packed, orders: Sequence[int]) -> DataFrame:
    """Mean of the d-fold differences of each series, for series of many chunks."""
    keys = packed.keys
    names = [*keys, "d", "s", "n"]

    def run(batches):
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                for d in orders:
                    _, own, _ = differenced(as_array(row.halo), as_array(row.vals), int(row.first), d)
                    rows.append((*[getattr(row, k) for k in keys], d, float(own.sum()), len(own)))
            yield pd.DataFrame(rows, columns=names)

    keyed = ddl(packed.frame, keys) + ", " if keys else ""
    parts = packed.frame.select(*keys, "first", "halo", "vals").mapInPandas(run, f"{keyed}d int, s double, n long")
    mean = F.try_divide(F.sum("s"), F.sum("n"))
    per_d = parts.groupBy(*keys, "d").agg(mean.alias("m"))
    grouped = per_d.groupBy(*keys) if keys else per_d.groupBy()
    ordered = F.array_sort(F.collect_list(F.struct("d", "m")))
    return grouped.agg(F.transform(ordered, lambda x: x["m"]).alias("means"))


def _lag_sum(upto: Column, weight) -> Column:
    """Sum over lags 1..upto of weight(lag) * g[lag]."""
    lags = F.when(upto >= 1, F.sequence(F.lit(1), upto)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(lags, F.lit(0.0), lambda s, k: s + weight(k) * F.col("g")[k])


def autolag(n: Column) -> Column:
    """Number of lags from the lag products ``g`` of a series of n values."""
    size = n.cast("double")
    cover = F.floor(F.pow(size, F.lit(2.0 / 9.0))).cast("int")
    cover = F.least(cover, F.size("g") - 1)
    half = size / 2.0
    s0 = F.col("g")[0] / size + _lag_sum(cover, lambda k: 1.0 / half)
    s1 = _lag_sum(cover, lambda k: k / half)
    ratio = F.try_divide(s1, s0)
    gamma = LAG_SCALE * F.pow(ratio * ratio, F.lit(1.0 / 3.0))
    lags = F.floor(gamma * F.pow(size, F.lit(1.0 / 3.0))).cast("int")
    lags = F.when(lags >= n, (n - 1).cast("int")).otherwise(lags)
    cap = F.floor(LAG_CAP * F.pow(size / 100.0, F.lit(0.25))).cast("int")
    return F.least(F.coalesce(lags, F.lit(0)), cap)


def long_run_variance(lags: Column, n: Column) -> Column:
    """Bartlett-weighted variance from the lag products ``g``."""
    weighted = _lag_sum(lags, lambda k: 1.0 - k / (lags + 1.0))
    return (F.col("g")[0] + 2.0 * weighted) / n


def critical_value(p_value: float) -> float:
    if p_value not in KPSS_CRITICAL:
        raise ValueError(f"p_value must be one of {sorted(KPSS_CRITICAL)}")
    return KPSS_CRITICAL[p_value]


def kpss(packed: Packed, orders: Sequence[int] = (0,), p_value: float = 0.05, fixed_lag: bool = False) -> DataFrame:
    """keys, d, n, lags, lr_var, kpss_val, crit_val, test_passed.

    ``fixed_lag`` uses max(1, n^(2/9)) lags instead of the automatic rule.
    """
    crit = critical_value(p_value)
    m = moments(packed, orders)
    n = F.col("n")
    if fixed_lag:
        lags = F.greatest(F.lit(1), F.floor(F.pow(n.cast("double"), F.lit(2.0 / 9.0))).cast("int"))
        lags = F.least(lags, F.size("g") - 1)
    else:
        lags = autolag(n)
    size = n.cast("double")
    return (
        m.withColumn("lags", lags)
        .withColumn("lr_var", long_run_variance(F.col("lags"), size))
        .withColumn("kpss_val", F.try_divide(F.col("eta"), size * size * F.col("lr_var")))
        .withColumn("crit_val", F.lit(crit))
        .withColumn("test_passed", F.col("kpss_val") <= crit)
        .select(*packed.keys, "d", "n", "lags", "lr_var", "kpss_val", "crit_val", "test_passed")
    )


def choose_d(packed: Packed, tests: DataFrame | None = None) -> DataFrame:
    """keys, d, capped: the first difference order that passes at 5 %, at most two."""
    tests = kpss(packed, (0, 1, 2)) if tests is None else tests
    first = F.min(F.when(F.col("test_passed"), F.col("d")))
    grouped = tests.groupBy(*packed.keys) if packed.keys else tests.groupBy()
    chosen = grouped.agg(first.alias("__d"))
    return chosen.select(
        *packed.keys, F.coalesce("__d", F.lit(MAX_D)).alias("d"), F.col("__d").isNull().alias("capped")
    )
