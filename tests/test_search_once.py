"""A search is run once, and its batches are solved at once."""

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foreloom.operators import fit as Fit
from foreloom.operators import kernel as K
from foreloom.operators import search as S
from foreloom.suite import Tables, series


def test_fits_beside_the_grid_are_searched_once(spark, folder):
    rows = series.users(Tables(spark, folder))
    found = Fit.arima_fit_ar(rows, ["k"], 1).select("k").distinct()
    asked = spark.sparkContext.accumulator(0)

    def one(k):
        asked.add(1)
        return k

    point = F.array(F.lit(0.2))
    fits = found.select(
        F.udf(one, T.LongType()).asNondeterministic()("k").alias("k"), F.lit(1).alias("p"), F.lit(0).alias("d"), F.lit(1).alias("q"),
        point.alias("phi"), point.alias("theta"), F.lit(1.0).alias("c"), F.lit(1.0).alias("css"), F.lit(True).alias("converged"),
    )
    got = series._against_grid(rows, fits, 0).collect()
    assert got and asked.value == len(got)


def test_a_batch_is_solved_at_once(monkeypatch):
    rng = np.random.default_rng(3)
    ys = [rng.exponential(50, 30 + i) for i in range(20)]
    low, high = np.full((20, 3), -1e9), np.full((20, 3), 1e9)
    whole = S.Projected(K.Batch([(y[:0], y, 0) for y in ys], 1, 1), low, high, True)
    calls, solve = [], np.linalg.solve
    monkeypatch.setattr(S.np.linalg, "solve", lambda a, b: calls.append(1) or solve(a, b))
    f, z, _ = whole.solve(np.full((20, 1), 0.3))
    assert len(calls) == 1
    alone = [whole.take(np.array([i])).solve(np.array([[0.3]])) for i in range(20)]
    np.testing.assert_allclose(f, [a[0][0] for a in alone], rtol=1e-12)
    np.testing.assert_allclose(z, [a[1][0] for a in alone], rtol=1e-9)


def test_rows_out_of_bounds_are_solved_one_by_one():
    ys = [np.arange(30.0) ** 2, np.cos(np.arange(30.0))]
    batch = K.Batch([(y[:0], y, 0) for y in ys], 1, 1)
    whole = S.Projected(batch, np.full((2, 3), -0.5), np.full((2, 3), 0.5), True)
    z = whole.solve(np.zeros((2, 1)))[1]
    assert (np.abs(z) <= 0.5).all() and np.abs(z[0]).max() == 0.5
