"""Column expressions and predicates of the query layer."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import add, and_, mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_column(value) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


# -- arithmetic ---------------------------------------------------------------


def identity(expression: ColumnLike, alias: str | None = None) -> Column:
    """A column, or any SQL expression given as text."""
    col = F.expr(expression) if isinstance(expression, str) else expression
    return col.alias(alias) if alias else col


def total(terms: Iterable[ColumnLike]) -> Column:
    return reduce(add, map(as_column, terms))


def minus(left: ColumnLike, right: ColumnLike) -> Column:
    return as_column(left) - as_column(right)


def ratio(left: ColumnLike, right: ColumnLike) -> Column:
    """Division that yields NULL for a zero divisor."""
    return F.try_divide(as_column(left), as_column(right))


def product(factors: Iterable[ColumnLike]) -> Column:
    return reduce(mul, [as_column(f).cast("double") for f in factors])


def root(value: ColumnLike) -> Column:
    return F.sqrt(as_column(value))


def power(base: ColumnLike, exponent: ColumnLike) -> Column:
    return F.pow(as_column(base), as_column(exponent))


def cast(value: ColumnLike, to: str) -> Column:
    return as_column(value).cast(to)


def case(branches: Sequence[tuple[ColumnLike, Sequence[Column]]]) -> Column:
    """First branch whose predicates all hold, as a double; 0 when none does."""
    if not branches:
        return F.lit(0.0)
    out = None
    for value, predicates in branches:
        cond = every(predicates)
        then = as_column(value).cast("double")
        out = F.when(cond, then) if out is None else out.when(cond, then)
    return out.otherwise(F.lit(0.0))


# -- predicates ---------------------------------------------------------------


def every(predicates: Sequence[Column]) -> Column:
    return reduce(and_, predicates, F.lit(True))


def is_null(c: ColumnLike) -> Column:
    return as_column(c).isNull()


def is_not_null(c: ColumnLike) -> Column:
    return as_column(c).isNotNull()


def at_most(c: ColumnLike, value) -> Column:
    return as_column(c) <= value


def below(c: ColumnLike, value) -> Column:
    return as_column(c) < value


def above(c: ColumnLike, value) -> Column:
    return as_column(c) > value


def equal(c: ColumnLike, value) -> Column:
    return as_column(c) == value


def not_equal(c: ColumnLike, value) -> Column:
    return as_column(c) != value


def not_distinct(c: ColumnLike, value) -> Column:
    return as_column(c).eqNullSafe(value)


def distinct(c: ColumnLike, value) -> Column:
    return ~as_column(c).eqNullSafe(value)


def member(c: ColumnLike, values: Sequence) -> Column:
    return as_column(c).isin(list(values))


def not_member(c: ColumnLike, values: Sequence) -> Column:
    return ~as_column(c).isin(list(values))


def semi_join(
    df: DataFrame, other: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str] | None = None
) -> DataFrame:
    """Rows whose key tuple occurs in another relation."""
    keys = other.select(*[F.col(k) for k in (right_keys or left_keys)]).toDF(*left_keys)
    return df.join(keys, list(left_keys), "left_semi")


# -- aggregates over joined relations -----------------------------------------


def sum_of_product(factors: Iterable[ColumnLike]) -> Column:
    return F.sum(reduce(mul, map(as_column, factors)))


def sum_of_products(terms: Iterable[Iterable[ColumnLike]]) -> Column:
    """Sum of a sum of products, e.g. R.s*S.c + S.s*R.c."""
    return F.sum(total([reduce(mul, map(as_column, t)) for t in terms]))
