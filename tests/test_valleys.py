"""Fits of one moving-average coefficient look into every valley of its line."""

import datetime as dt

import numpy as np
import pytest

from foreloom.operators import fit as Fit
from foreloom.operators import kernel as K
from foreloom.operators import search as S

# Two valleys: near 0.28, where the lowest of a few starts lie, and the lower one near 0.83.
VALUES = [
    153.55, 13.24, 10.69, 19.8, 0.63, 4.34, 126.44, 23.94, 48.92, 70.96, 21.85, 5.62, 36.08, 36.92, 49.39, 55.76, 18.64,
    12.02, 9.3, 38.86, 95.7, 175.44, 29.51, 57.77, 43.78, 50.48, 8.02, 35.54, 137.88, 73.87, 4.87, 11.33, 21.96, 64.24,
    40.22, 75.94, 74.31, 2.19, 73.11, 6.2, 11.12, 52.96, 2.68, 59.25, 1.81, 22.91, 15.48, 43.19, 1.11, 56.05, 33.83, 28.89,
    9.49, 9.7, 248.97, 24.62, 39.4, 38.72, 80.51, 263.75,
]
LEAST, THETA = 161249.3158, 0.82881


@pytest.mark.parametrize("follow", [S.descend, S.simplex])
def test_the_lower_valley_is_found(follow):
    y = np.array(VALUES)
    x, css, ended = S.fit(K.Batch([(y[:0], y, 0)], 1, 1), np.array([y.mean()]), True, follow)
    assert css[0] == pytest.approx(LEAST, abs=1e-3) and x[0, 1] == pytest.approx(THETA, abs=1e-4) and ended[0]


def test_the_lower_valley_is_found_over_chunks(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [("a", start + dt.timedelta(hours=i), v) for i, v in enumerate(VALUES)]
    series = spark.createDataFrame(rows, "k string, ts timestamp_ntz, value double")
    spark.conf.set("spark.foreloom.packRows", "20")
    try:
        got = Fit.arima_fit(series, ["k"], (1, 0, 1)).first()
    finally:
        spark.conf.unset("spark.foreloom.packRows")
    assert got["css"] == pytest.approx(LEAST, abs=1e-3) and got["theta"] == pytest.approx([THETA], abs=1e-4)


def test_starts_that_are_followed():
    line = np.array([[0.2], [-0.9], [0.0], [0.9], [0.5]])
    assert S.followed(line, np.array([3.0, 1.0, 4.0, 2.0, 5.0])).tolist() == [1, 3, 0]
    assert S.followed(line, np.full(5, np.inf)).tolist() == []
    assert S.followed(line, np.zeros(5)).tolist() == [1]
