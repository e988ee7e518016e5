"""Every registered query against its SQL counterpart in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_module

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()

# queries whose groups are cut into slices or chunks when the limits are low
LONG = """read_series css_loss css_loss_d1 css_incremental css_full_table advance_states residuals win_running_css
kpss choose_d difference integrate win_lag_features win_ffill autocovariance win_row_number win_cumsum_by_value
win_cumsum_by_ratio split_num decision_tree update_residuals dict_encode forecast_from_state breach_check
arima_fit_ar css_loss_sql state_transition_telescoping""".split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return str(v) if math.isnan(v) or math.isinf(v) else float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    if type(v).__name__ == "Decimal":
        return float(v)
    return v


def rows(tuples):
    return sorted((tuple(norm(x) for x in t) for t in tuples), key=repr)


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, duck, folder, name):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    mine = rows(df.select(*[f"`{c}`" for c in columns]).collect())
    answer = duck.execute(ORACLES[name])
    named = [c[0] for c in answer.description]
    assert sorted(named) == columns
    at = [named.index(c) for c in columns]
    theirs = rows(tuple(r[i] for i in at) for r in answer.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, folder, name):
    compare(spark, duck, folder, name)


@pytest.mark.parametrize("name", LONG)
def test_long_groups_match_sql(spark, duck, folder, short_groups, name):
    compare(spark, duck, folder, name)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.columns == ["k", "css"] and df.count() > 0
