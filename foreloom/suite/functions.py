"""Queries of the scalar, array, date and cleaning functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreloom.functions import scalars as S
from foreloom.functions import sql as SQL
from foreloom.operators import preparation as P
from foreloom.suite import query
from foreloom.suite.series import USERS, forecast_sql, kpss_sql, users


@query("log10p1", "SELECT event_id, ROUND(LOG10(value + 1), 9) AS v FROM events")
def _(t):
    return t.events.select("event_id", F.round(S.log10p1("value"), 9).alias("v"))


_X = "CASE WHEN value < 1 THEN NULL WHEN value > 300 THEN value + 100 ELSE value / 100 END"


@query(
    "inv_log10p1",
    f"""SELECT event_id, CASE WHEN x IS NULL THEN NULL WHEN ABS(x) <= 308 THEN ROUND(POW(10, x) - 1, 4)
               ELSE CAST('Infinity' AS DOUBLE) END AS v FROM (SELECT event_id, {_X} AS x FROM events)""",
)
def _(t):
    out = S.inv_log10p1(F.expr(_X))
    bounded = F.when(out == float("inf"), out).otherwise(F.round(out, 4))
    return t.events.select("event_id", bounded.alias("v"))


@query(
    "math_basic",
    """SELECT c_custkey, ABS(c_acctbal) AS a, CAST(FLOOR(c_acctbal) AS BIGINT) AS f, ROUND(SQRT(ABS(c_acctbal)), 9) AS r,
              ROUND(POW(c_acctbal / 1000, 2), 6) AS p, GREATEST(c_acctbal, 0.0) AS g, COALESCE(NULLIF(c_nationkey, 0), -1) AS n
       FROM customer""",
)
def _(t):
    return t.customer.selectExpr(
        "c_custkey",
        "abs(c_acctbal) AS a",
        "floor(c_acctbal) AS f",
        "round(sqrt(abs(c_acctbal)), 9) AS r",
        "round(power(c_acctbal / 1000, 2), 6) AS p",
        "greatest(c_acctbal, 0.0D) AS g",
        "coalesce(nullif(c_nationkey, 0), -1) AS n",
    )


@query("random_feature")
def _(t):
    return t.part.select("p_partkey", S.random_feature(42, "p_partkey").alias("f1"))


@query("date_doy", "SELECT o_orderkey, CAST(EXTRACT(DOY FROM o_orderdate) AS INTEGER) AS doy FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.dayofyear("o_orderdate").alias("doy"))


@query(
    "date_add_steps",
    """SELECT o_orderkey, i.i, CAST(o_orderdate + i.i * INTERVAL 6 HOUR AS TIMESTAMP) AS d
       FROM orders, (SELECT UNNEST([1, 2, 3]) AS i) i""",
)
def _(t):
    rows = t.orders.select("o_orderkey", "o_orderdate", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i"))
    step = F.expr("INTERVAL 6 HOUR")
    return rows.select("o_orderkey", "i", S.date_add_steps("o_orderdate", step, "i").alias("d"))


@query(
    "date_from_index",
    "SELECT event_id, CAST(TIMESTAMP '2024-01-01 00:00:00' + event_id * INTERVAL 1 SECOND AS TIMESTAMP) AS d FROM events",
)
def _(t):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return t.events.select("event_id", S.date_from_index(start, "event_id").alias("d"))


_FREQ = """CASE p_size % 6 WHEN 0 THEN '10_minutes' WHEN 1 THEN 'half_hourly' WHEN 2 THEN 'daily' WHEN 3 THEN '2_weeks'
           WHEN 4 THEN '4_seconds' ELSE 'monthly' END"""


@query(
    "freq_to_interval",
    """SELECT p_partkey, CAST(CASE p_size % 6 WHEN 0 THEN 600 WHEN 1 THEN 1800 WHEN 2 THEN 86400 WHEN 3 THEN 1209600
              WHEN 4 THEN 4 END AS DOUBLE) AS seconds FROM part""",
)
def _(t):
    return t.part.select("p_partkey", S.freq_interval_column(F.expr(_FREQ)).alias("seconds"))


@query(
    "date_add_frequency",
    """SELECT o_orderkey, CAST(CASE o_orderkey % 5 WHEN 0 THEN o_orderdate + to_months(3 * CAST(o_custkey % 7 AS INTEGER))
              WHEN 1 THEN o_orderdate + to_months(12 * CAST(o_custkey % 7 AS INTEGER)) WHEN 2 THEN o_orderdate + to_minutes(30 * CAST(o_custkey % 7 AS BIGINT))
              WHEN 3 THEN o_orderdate + to_days(7 * CAST(o_custkey % 7 AS INTEGER)) ELSE o_orderdate + to_months(CAST(o_custkey % 7 AS INTEGER)) END AS TIMESTAMP) AS later FROM orders""",
)
def _(t):
    """Some steps of a named frequency later, months by the calendar."""
    names = F.element_at(F.array(*[F.lit(n) for n in ("quarterly", "yearly", "half_hourly", "weekly", "monthly")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return t.orders.select("o_orderkey", S.add_frequency(F.col("o_orderdate"), names, F.col("o_custkey") % 7).alias("later"))


_ARR = "[l_quantity, l_discount, l_tax, l_extendedprice]"


def _arrays(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", F.array("l_quantity", "l_discount", "l_tax", "l_extendedprice").alias("a")
    )


@query(
    "arr_slice",
    f"SELECT l_orderkey, l_linenumber, ({_ARR})[2:3][1] AS x, ({_ARR})[2:3][2] AS y FROM lineitem",
)
def _(t):
    s = F.slice("a", 2, 2)
    return _arrays(t).select("l_orderkey", "l_linenumber", s[0].alias("x"), s[1].alias("y"))


@query(
    "arr_concat",
    f"SELECT l_orderkey, l_linenumber, LIST_CONCAT({_ARR}, [l_tax])[5] AS x, CAST(LEN(LIST_CONCAT({_ARR}, [l_tax])) AS INTEGER) AS n FROM lineitem",
)
def _(t):
    joined = F.concat("a", F.array(F.col("a")[2]))
    return _arrays(t).select("l_orderkey", "l_linenumber", joined[4].alias("x"), F.size(joined).alias("n"))


@query("arr_len", f"SELECT l_orderkey, l_linenumber, CAST(LEN({_ARR}) AS INTEGER) AS n FROM lineitem")
def _(t):
    return _arrays(t).select("l_orderkey", "l_linenumber", F.size("a").alias("n"))


@query(
    "arr_reverse",
    f"SELECT l_orderkey, l_linenumber, LIST_REVERSE({_ARR})[1] AS x, LIST_REVERSE({_ARR})[4] AS y FROM lineitem",
)
def _(t):
    r = S.reverse_array("a")
    return _arrays(t).select("l_orderkey", "l_linenumber", r[0].alias("x"), r[3].alias("y"))


@query(
    "arr_unnest_ord",
    f"""SELECT l_orderkey, l_linenumber, CAST(i - 1 AS INTEGER) AS pos, ({_ARR})[i] AS x
        FROM lineitem, (SELECT UNNEST([1, 2, 3, 4]) AS i)""",
)
def _(t):
    return _arrays(t).select("l_orderkey", "l_linenumber", F.posexplode("a").alias("pos", "x"))


@query(
    "arr_build",
    f"SELECT l_orderkey, l_linenumber, l_tax AS a0, l_quantity AS a1, l_tax AS a3, 0.0::DOUBLE AS z, 4 AS n FROM lineitem",
)
def _(t):
    shifted = S.shift_in("a", F.col("a")[2])
    zeros = F.array_repeat(F.lit(0.0), 4)
    return _arrays(t).select(
        "l_orderkey", "l_linenumber", shifted[0].alias("a0"), shifted[1].alias("a1"), shifted[3].alias("a3"),
        zeros[3].alias("z"), F.size(zeros).alias("n"),
    )


@query(
    "arr_norm",
    """SELECT l_orderkey, l_linenumber, ROUND(SQRT(l_quantity * l_quantity + l_discount * l_discount + l_tax * l_tax + l_extendedprice * l_extendedprice), 6) AS norm,
              ROUND(l_quantity * 0.5, 6) AS half FROM lineitem""",
)
def _(t):
    return _arrays(t).select(
        "l_orderkey", "l_linenumber", F.round(S.array_norm("a"), 6).alias("norm"),
        F.round(S.array_scale("a", F.lit(0.5))[0], 6).alias("half"),
    )


@query(
    "generate_series",
    """SELECT l_orderkey, l_linenumber, i FROM (SELECT l_orderkey, l_linenumber, UNNEST(RANGE(1, l_linenumber + 1)) AS i FROM lineitem)""",
)
def _(t):
    steps = F.explode(F.sequence(F.lit(1), F.col("l_linenumber"))).cast("long")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.explode(F.sequence(F.lit(1).cast("long"), F.col("l_linenumber").cast("long"))).alias("i"))


@query(
    "dict_encode",
    """SELECT p_partkey, CAST(DENSE_RANK() OVER (ORDER BY p_name) AS BIGINT) AS p_name,
              CAST(DENSE_RANK() OVER (ORDER BY p_brand) AS BIGINT) AS p_brand,
              CAST(DENSE_RANK() OVER (ORDER BY p_type) AS BIGINT) AS p_type, p_size FROM part""",
)
def _(t):
    return P.dict_encode(t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size"))


@query(
    "bool_encode",
    "SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS done, CAST(o_totalprice > 200000 AS INTEGER) AS big FROM orders",
)
def _(t):
    flags = t.orders.selectExpr("o_orderkey", "o_orderstatus = 'F' AS done", "o_totalprice > 200000 AS big")
    return P.bool_encode(flags)


@query(
    "synthetic_target",
    """SELECT l_orderkey, l_linenumber, ROUND(COALESCE(LOG10(ABS(l_extendedprice) + 1), 0) + COALESCE(LOG10(ABS(o_totalprice) + 1), 0)
              - 10 * COALESCE(s_nationkey, 0) - 10 * EXTRACT(DOY FROM l_shipdate) + POW(COALESCE(h.p_size, 0), 2), 6) AS target
       FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey
       LEFT JOIN (SELECT * FROM part WHERE p_size > 25) h ON l_partkey = h.p_partkey""",
)
def _(t):
    heavy = t.part.where("p_size > 25").select("p_partkey", "p_size")
    rows = (
        t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(heavy, F.col("l_partkey") == F.col("p_partkey"), "left")
    )
    target = S.synthetic_target("l_extendedprice", "o_totalprice", "s_nationkey", "l_shipdate", "p_size")
    return rows.select("l_orderkey", "l_linenumber", F.round(target, 6).alias("target"))


_MESSY = "CASE p_size % 4 WHEN 0 THEN 'NULL' WHEN 1 THEN 'inf' WHEN 2 THEN 'abc' ELSE CAST(p_retailprice AS VARCHAR) END"


@query("clean_numeric", "SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN p_retailprice END AS v FROM part")
def _(t):
    messy = _MESSY.replace("VARCHAR", "STRING").replace("'inf'", "'Infinity'")
    return t.part.select("p_partkey", S.clean_numeric(F.expr(messy)).alias("v"))


@query(
    "json_arg",
    """SELECT event_id, CASE WHEN JSON_EXTRACT_STRING(props, '$.k') IN ('1') THEN true
              WHEN JSON_EXTRACT_STRING(props, '$.k') IN ('0') THEN false ELSE false END AS flag FROM events""",
)
def _(t):
    return t.events.select("event_id", S.json_arg("props", "k").alias("flag"))


@query(
    "rename_reserved",
    "SELECT s_suppkey AS fl_s, s_acctbal AS fl_c, s_nationkey AS fl_rowid, s_name FROM supplier",
)
def _(t):
    clashing = t.supplier.select(
        F.col("s_suppkey").alias("s"), F.col("s_acctbal").alias("c"), F.col("s_nationkey").alias("rowid"), "s_name"
    )
    return S.rename_reserved(clashing)[0]


@query(
    "sql_functions",
    f"""WITH {USERS}, a AS (SELECT k, i, y, LAG(y) OVER (PARTITION BY k ORDER BY i) AS x FROM u)
        SELECT k, ROUND(SUM(POW(y - 2.0 - 0.5 * x, 2)), 6) AS css, COUNT(*) AS n FROM a WHERE x IS NOT NULL GROUP BY k""",
)
def _(t):
    """The array functions called from SQL text, on the packed series."""
    from foreloom.plans.packed import pack

    SQL.register(t.spark)
    pack(users(t), ["k"]).frame.createOrReplaceTempView("foreloom_packed")
    return t.spark.sql(
        """SELECT k, round(css_loss(vals, array(0.5D), CAST(array() AS ARRAY<DOUBLE>), 1, 0, 2.0D), 6) AS css,
                  CAST(size(arima_difference(vals, 1)) AS BIGINT) AS n FROM foreloom_packed"""
    )


@query("sql_run_forecast", forecast_sql(1, 5))
def _(t):
    """Forecasts of all users from their states, by the table function."""
    from foreloom.operators import css as S
    from foreloom.plans.packed import pack

    SQL.register(t.spark)
    packed = pack(users(t), ["k"])
    models = S.one_model(packed, [0.4, 0.1], [0.3, 0.2], 1.0, 1)
    ends = packed.frame.groupBy("k").agg(F.max("last_ts").cast("timestamp_ntz").alias("last_ts"))
    models.join(S.fold_states(packed, models, []), "k").join(ends, "k").createOrReplaceTempView("foreloom_states")
    return t.spark.sql(
        """SELECT k, i AS step, round(forecast_value, 6) AS forecast_value, forecast_date
           FROM foreloom_states, LATERAL run_forecast(last_ts, phi, theta, c, state, 5, INTERVAL '1 00:00:00' DAY TO SECOND)"""
    )


@query(
    "sql_kpss",
    kpss_sql(0, True) + " SELECT k, ROUND(eta / (n * n * lr), 6) AS kpss_val FROM v",
)
def _(t):
    """Stationarity of every user's events, called from SQL text with the fixed number of lags."""
    from foreloom.plans.packed import pack

    SQL.register(t.spark)
    pack(users(t), ["k"]).frame.createOrReplaceTempView("foreloom_packed")
    return t.spark.sql("SELECT k, round(kpss(vals, CAST(greatest(1, floor(power(size(vals), 2D / 9D))) AS INT)), 6) AS kpss_val FROM foreloom_packed")
