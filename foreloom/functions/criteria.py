"""Likelihood and information criteria as Column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from foreloom.functions.expressions import ColumnLike, as_column


def used_rows(p: ColumnLike, q: ColumnLike, n: ColumnLike) -> Column:
    return as_column(n) - F.greatest(as_column(p), as_column(q))


def loglik(css: ColumnLike, p: ColumnLike, q: ColumnLike, n: ColumnLike) -> Column:
    """Conditional Gaussian likelihood over the rows after the first max(p, q)."""
    rows = used_rows(p, q, n)
    rest = F.lit(math.log(2.0 * math.pi)) + F.ln(as_column(css) / rows) + 1.0
    # ln(0) is NULL in SQL; a perfect fit has an infinite likelihood
    value = F.when(as_column(css) == 0.0, F.lit(float("inf"))).otherwise(-0.5 * rows * rest)
    return F.when(rows > 0, value).otherwise(F.lit(float("nan")))


def all_params(p: ColumnLike, q: ColumnLike, k: ColumnLike) -> Column:
    return as_column(p) + as_column(q) + as_column(k) + 1


def param_count(p: ColumnLike, q: ColumnLike, constant: ColumnLike) -> Column:
    return as_column(p) + as_column(q) + as_column(constant).cast("int")


def aic(css: ColumnLike, p: ColumnLike, q: ColumnLike, k: ColumnLike, n: ColumnLike) -> Column:
    return -2.0 * loglik(css, p, q, n) + 2.0 * all_params(p, q, k)


def aicc(css: ColumnLike, p: ColumnLike, q: ColumnLike, k: ColumnLike, n: ColumnLike) -> Column:
    """AIC with the small-sample correction; ``k`` is handed in by the caller as is."""
    m = all_params(p, q, k).cast("double")
    room = as_column(n) - m - 1.0
    correction = F.when(room == 0.0, F.lit(float("inf"))).otherwise(2.0 * m * (m + 1.0) / room)
    return F.when(used_rows(p, q, n) > 0, aic(css, p, q, k, n) + correction).otherwise(F.lit(float("nan")))
