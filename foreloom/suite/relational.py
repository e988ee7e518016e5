"""Queries of the relational layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreloom.functions import expressions as E
from foreloom.operators import relational as R
from foreloom.plans import ordered as O
from foreloom.suite import query

# -- projections and expressions ----------------------------------------------


@query("expr_identity", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS doubled FROM lineitem")
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", E.identity("l_quantity * 2", "doubled"))


@query(
    "expr_add",
    "SELECT l_orderkey, l_linenumber, (l_quantity) + (l_discount) + (l_tax) AS added FROM lineitem",
)
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", E.total(["l_quantity", "l_discount", "l_tax"]).alias("added")
    )


@query(
    "expr_sub",
    "SELECT l_orderkey, l_linenumber, l_discount - l_tax AS gap FROM lineitem",
)
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", E.minus("l_discount", "l_tax").alias("gap"))


@query(
    "expr_div",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_tax <> 0 THEN l_extendedprice / l_tax END AS share
       FROM lineitem""",
)
def _(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", E.ratio("l_extendedprice", "l_tax").alias("share"))


@query(
    "expr_prod",
    """SELECT l_orderkey, l_linenumber,
              CAST(l_linenumber AS DOUBLE) * CAST(l_quantity AS DOUBLE) AS prod FROM lineitem""",
)
def _(t):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", E.product(["l_linenumber", "l_quantity"]).alias("prod")
    )


@query("expr_sqrt", "SELECT c_custkey, SQRT(ABS(c_acctbal)) AS root FROM customer")
def _(t):
    return t.customer.select("c_custkey", E.root(F.abs("c_acctbal")).alias("root"))


@query("expr_pow", "SELECT p_partkey, POW(CAST(p_size AS DOUBLE), 2) AS squared FROM part")
def _(t):
    return t.part.select("p_partkey", E.power(F.col("p_size").cast("double"), 2.0).alias("squared"))


@query("expr_cast", "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders")
def _(t):
    return t.orders.select("o_orderkey", E.cast("o_totalprice", "decimal(18,2)").alias("price"))


@query(
    "expr_case",
    """SELECT p_partkey,
              CASE WHEN p_size > 25 AND p_retailprice <= 1000 THEN CAST(1 AS DOUBLE)
                   WHEN p_type = 'ECONOMY' THEN CAST(p_size AS DOUBLE)
                   ELSE 0 END AS picked
       FROM part""",
)
def _(t):
    return t.part.select(
        "p_partkey",
        E.case(
            [
                (F.lit(1), [E.above("p_size", 25), E.at_most("p_retailprice", 1000)]),
                ("p_size", [E.equal("p_type", "ECONOMY")]),
            ]
        ).alias("picked"),
    )


# -- predicates ---------------------------------------------------------------

# a nullable column derived from the tables: no account balance below zero
_NULLABLE = "(SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS bal FROM customer)"


def _nullable(t):
    return t.customer.select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("bal"))


@query("pred_null", f"SELECT c_custkey FROM {_NULLABLE} WHERE bal IS NULL")
def _(t):
    return _nullable(t).where(E.is_null("bal")).select("c_custkey")


@query("pred_not_null", f"SELECT c_custkey, bal FROM {_NULLABLE} WHERE bal IS NOT NULL")
def _(t):
    return _nullable(t).where(E.is_not_null("bal"))


@query("pred_le", "SELECT p_partkey, p_size FROM part WHERE p_size <= 10")
def _(t):
    return t.part.where(E.at_most("p_size", 10)).select("p_partkey", "p_size")


@query("pred_lt", "SELECT p_partkey, p_size FROM part WHERE p_size < 10")
def _(t):
    return t.part.where(E.below("p_size", 10)).select("p_partkey", "p_size")


@query("pred_gt", "SELECT p_partkey, p_size FROM part WHERE p_size > 10")
def _(t):
    return t.part.where(E.above("p_size", 10)).select("p_partkey", "p_size")


@query("pred_eq", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A'")
def _(t):
    return t.lineitem.where(E.equal("l_returnflag", "A")).select("l_orderkey", "l_linenumber")


@query("pred_ne", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag != 'A'")
def _(t):
    return t.lineitem.where(E.not_equal("l_returnflag", "A")).select("l_orderkey", "l_linenumber")


@query(
    "pred_not_distinct",
    f"SELECT c_custkey FROM {_NULLABLE} WHERE bal IS NOT DISTINCT FROM CAST(NULL AS DOUBLE)",
)
def _(t):
    return _nullable(t).where(E.not_distinct("bal", F.lit(None).cast("double"))).select("c_custkey")


@query("pred_distinct", f"SELECT c_custkey FROM {_NULLABLE} WHERE bal IS DISTINCT FROM 73.0")
def _(t):
    return _nullable(t).where(E.distinct("bal", 73.0)).select("c_custkey")


@query("pred_in", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 49)")
def _(t):
    return t.part.where(E.member("p_size", [1, 5, 49])).select("p_partkey", "p_size")


@query("pred_not_in", "SELECT p_partkey, p_brand FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#2')")
def _(t):
    return t.part.where(E.not_member("p_brand", ["Brand#1", "Brand#2"])).select("p_partkey", "p_brand")


@query(
    "pred_semi_join",
    """SELECT s_suppkey, s_name FROM supplier
       WHERE s_nationkey IN (SELECT c_nationkey FROM customer WHERE c_mktsegment = 'MACHINERY')""",
)
def _(t):
    buyers = t.customer.where(E.equal("c_mktsegment", "MACHINERY"))
    return E.semi_join(t.supplier, buyers, ["s_nationkey"], ["c_nationkey"]).select("s_suppkey", "s_name")


@query("lateral_row_filter", f"SELECT c_custkey, bal FROM {_NULLABLE} WHERE bal IS NOT NULL")
def _(t):
    return _nullable(t).dropna(subset=["bal"])


@query(
    "filter_new_rows",
    "SELECT event_id, ts, value FROM events WHERE ts > TIMESTAMP '2024-01-20 00:00:00'",
)
def _(t):
    last = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    return t.events.where(E.above(F.col("ts").cast("timestamp_ntz"), last)).select("event_id", "ts", "value")


@query("sample_rows")
def _(t):
    """A Bernoulli sample: row-wise, repeatable by seed, no shuffle."""
    return R.Query(t.lineitem, ["l_orderkey", "l_linenumber"], sample=0.2, seed=7).frame()


# -- joins --------------------------------------------------------------------


@query(
    "join_equi",
    """SELECT o.o_orderkey, c.c_mktsegment, n.n_name
       FROM orders o, customer c, nation n
       WHERE o.o_custkey = c.c_custkey AND c.c_nationkey = n.n_nationkey""",
)
def _(t):
    o, c, n = t.orders, t.customer, t.nation
    return R.Query(
        o,
        ["o_orderkey", "c_mktsegment", "n_name"],
        joins=[(c, o.o_custkey == c.c_custkey, "inner"), (n, c.c_nationkey == n.n_nationkey, "inner")],
    ).frame()


_SIDES = """(SELECT CASE WHEN s_nationkey % 5 = 0 THEN NULL ELSE s_nationkey END AS k, s_suppkey FROM supplier)"""
_MESSAGES = """(SELECT CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey END AS k, COUNT(*) AS c
               FROM nation GROUP BY 1)"""


@query(
    "join_null_safe",
    f"SELECT a.s_suppkey, b.c FROM {_SIDES} a JOIN {_MESSAGES} b ON a.k IS NOT DISTINCT FROM b.k",
)
def _(t):
    from foreloom.plans.joins import null_safe_join

    def key(c):
        return F.when(F.col(c) % 5 != 0, F.col(c)).alias("k")

    side = t.supplier.select(key("s_nationkey"), "s_suppkey")
    message = t.nation.select(key("n_nationkey")).groupBy("k").agg(F.count("*").alias("c"))
    return null_safe_join(side, message, ["k"]).select("s_suppkey", "c")


@query(
    "join_semi",
    """SELECT l_orderkey, l_linenumber FROM lineitem l
       WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderstatus = 'P')""",
)
def _(t):
    open_orders = t.orders.where(E.equal("o_orderstatus", "P"))
    return E.semi_join(t.lineitem, open_orders, ["l_orderkey"], ["o_orderkey"]).select(
        "l_orderkey", "l_linenumber"
    )


@query(
    "join_star_outer",
    """WITH heavy AS (SELECT * FROM part WHERE p_size > 25)
       SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus, h.p_brand, h.p_size
       FROM lineitem l
       INNER JOIN orders o ON l.l_orderkey = o.o_orderkey
       INNER JOIN supplier s ON l.l_suppkey = s.s_suppkey
       LEFT JOIN heavy h ON l.l_partkey = h.p_partkey""",
)
def _(t):
    heavy = t.part.where(E.above("p_size", 25))
    l = t.lineitem
    return (
        l.join(t.orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey")
        .join(t.supplier.withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey")
        .join(heavy.withColumnRenamed("p_partkey", "l_partkey"), "l_partkey", "left")
        .select("l_orderkey", "l_linenumber", "o_orderstatus", "p_brand", "p_size")
    )


@query(
    "join_cross_stats",
    """SELECT o_orderkey, ROUND(o_totalprice - (SELECT AVG(o_totalprice) FROM orders), 4) AS resid,
              (SELECT COUNT(*) FROM orders) AS n FROM orders""",
)
def _(t):
    """Every row meets one row of statistics, as two scalar subqueries."""
    from foreloom.operators.stats import with_totals

    out = with_totals(t.orders, {"m": F.avg("o_totalprice"), "n": F.count("*")})
    return out.select("o_orderkey", F.round(F.col("o_totalprice") - F.col("m"), 4).alias("resid"), "n")


@query(
    "join_lag_self",
    """WITH r AS (SELECT user_id, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events)
       SELECT a.user_id, k.lag, CAST(COUNT(*) AS BIGINT) AS pairs, ROUND(SUM(a.value * b.value), 2) AS s
       FROM range(1, 4) k(lag)
       JOIN r a ON a.rn > k.lag
       JOIN r b ON b.user_id = a.user_id AND b.rn = a.rn - k.lag
       GROUP BY a.user_id, k.lag""",
)
def _(t):
    """Row i with row i-k for k = 1..3, by lags instead of a self-join."""
    lagged = O.look_back(
        t.events,
        ["user_id"],
        ["ts"],
        lambda w: {f"k{k}": F.lag("value", k).over(w) for k in (1, 2, 3)},
        rows=3,
    )
    pairs = R.melt(lagged.select("user_id", "value", "k1", "k2", "k3"), ["user_id", "value"], ["k1", "k2", "k3"], "lag", "other")
    return (
        pairs.where("other IS NOT NULL")
        .groupBy("user_id", F.expr("bigint(substring(lag, 2))").alias("lag"))
        .agg(F.count("*").alias("pairs"), F.round(F.sum(F.col("value") * F.col("other")), 2).alias("s"))
    )


@query(
    "join_anti_fill",
    """WITH dim AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS pri, 1 AS measure FROM orders WHERE o_orderstatus = 'F')
       SELECT k, pri, measure FROM dim
       UNION ALL
       SELECT DISTINCT o_custkey, o_orderpriority, 0 FROM orders o
       WHERE NOT EXISTS (SELECT 1 FROM dim d WHERE d.k = o.o_custkey AND d.pri = o.o_orderpriority)""",
)
def _(t):
    from foreloom.operators.preparation import fill_missing_keys

    pairs = t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("pri"), "o_orderstatus")
    dim = pairs.where("o_orderstatus = 'F'").select("k", "pri").distinct().withColumn("measure", F.lit(1))
    return fill_missing_keys(dim, pairs, ["k", "pri"], {"measure": 0})


@query(
    "join_update_dictionary",
    """WITH d AS (SELECT p_brand, CAST(ROW_NUMBER() OVER (ORDER BY p_brand) AS BIGINT) AS dict_id
                  FROM (SELECT DISTINCT p_brand FROM part))
       SELECT p.p_partkey, d.dict_id AS p_brand FROM part p JOIN d ON p.p_brand = d.p_brand""",
)
def _(t):
    from foreloom.operators.preparation import dictionary, replace_by_dictionary

    part = t.part.select("p_partkey", "p_brand")
    return replace_by_dictionary(part, "p_brand", dictionary(part, "p_brand"))


@query(
    "join_recursive_step",
    """WITH RECURSIVE u AS (SELECT event_type AS k, DATE_TRUNC('day', ts) AS ts, AVG(value) AS y,
                                ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY DATE_TRUNC('day', ts)) - 1 AS i
                         FROM events GROUP BY event_type, DATE_TRUNC('day', ts)),
       f AS (SELECT k, i, y - 300.0 AS e, CAST(0 AS DOUBLE) AS css FROM u WHERE i = 0
             UNION ALL
             SELECT u.k, u.i, u.y - 300.0 - 0.3 * f.e, f.css + f.e * f.e FROM f JOIN u ON u.k = f.k AND u.i = f.i + 1)
       SELECT k, i, ROUND(e, 6) AS e, ROUND(css, 4) AS css FROM f""",
)
def _(t):
    """Residuals of every day, each from the row of the day before, by a recursive query."""
    day = F.date_trunc("day", "ts").alias("ts")
    rows = O.positions(t.events.groupBy(F.col("event_type").alias("k"), day).agg(F.avg("value").alias("y")), ["k"], ["ts"], "i")
    rows = rows.select("k", "i", "y")
    first = rows.where("i = 0").select("k", "i", (F.col("y") - 300.0).alias("e"), F.lit(0.0).alias("css"))
    out = R.recursive_steps(first, rows, ["k"], "i", {"e": "s.y - 300D - 0.3D * f.e", "css": "f.css + f.e * f.e"})
    return out.select("k", "i", F.round("e", 6).alias("e"), F.round("css", 4).alias("css"))


# -- aggregates ---------------------------------------------------------------


@query(
    "agg_sum",
    "SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS qty FROM lineitem GROUP BY ALL",
)
def _(t):
    return R.Query(
        t.lineitem, [F.round(F.sum("l_quantity"), 2).alias("qty")], group_by=["l_returnflag", "l_linestatus"]
    ).frame()


@query(
    "agg_avg",
    "SELECT l_returnflag, ROUND(AVG(l_extendedprice), 4) AS price FROM lineitem GROUP BY ALL",
)
def _(t):
    return R.Query(
        t.lineitem, [F.round(F.avg("l_extendedprice"), 4).alias("price")], group_by=["l_returnflag"]
    ).frame()


@query("agg_max", "SELECT p_brand, MAX(p_retailprice) AS top FROM part GROUP BY ALL")
def _(t):
    return R.Query(t.part, [F.max("p_retailprice").alias("top")], group_by=["p_brand"]).frame()


@query("agg_min", "SELECT p_brand, MIN(p_retailprice) AS low FROM part GROUP BY ALL")
def _(t):
    return R.Query(t.part, [F.min("p_retailprice").alias("low")], group_by=["p_brand"]).frame()


@query("agg_count", "SELECT o_orderstatus, COUNT(o_custkey) AS n FROM orders GROUP BY ALL")
def _(t):
    return R.Query(t.orders, [F.count("o_custkey").alias("n")], group_by=["o_orderstatus"]).frame()


@query(
    "agg_count_distinct",
    "SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS customers FROM orders GROUP BY ALL",
)
def _(t):
    return R.Query(
        t.orders, [F.count_distinct("o_custkey").alias("customers")], group_by=["o_orderstatus"]
    ).frame()


@query(
    "agg_count_multi",
    "SELECT l_orderkey, l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_suppkey",
)
def _(t):
    """A count over several columns counts rows."""
    return R.Query(t.lineitem, [F.count("*").alias("n")], group_by=["l_orderkey", "l_suppkey"]).frame()


@query("distinct_rows", "SELECT DISTINCT p_brand, p_type FROM part")
def _(t):
    return R.Query(t.part, ["p_brand", "p_type"], distinct=True).frame()


@query(
    "agg_sum_prod",
    """SELECT p.p_brand, ROUND(SUM(l.l_quantity * p.p_size), 2) AS s
       FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY p.p_brand""",
)
def _(t):
    l, p = t.lineitem, t.part
    return (
        l.join(p, l.l_partkey == p.p_partkey)
        .groupBy("p_brand")
        .agg(F.round(E.sum_of_product(["l_quantity", "p_size"]), 2).alias("s"))
    )


@query(
    "agg_distributed_sum_prod",
    """WITH r AS (SELECT c_nationkey AS k, SUM(c_acctbal) AS s, COUNT(*) AS c FROM customer GROUP BY 1),
            q AS (SELECT s_nationkey AS k, SUM(s_acctbal) AS s, COUNT(*) AS c FROM supplier GROUP BY 1)
       SELECT ROUND(SUM(r.s * q.c + q.s * r.c), 2) AS s FROM r JOIN q ON r.k = q.k""",
)
def _(t):
    def side(df, key, value, prefix):
        return df.groupBy(F.col(key).alias("k")).agg(
            F.sum(value).alias(f"{prefix}s"), F.count("*").alias(f"{prefix}c")
        )

    r = side(t.customer, "c_nationkey", "c_acctbal", "r")
    q = side(t.supplier, "s_nationkey", "s_acctbal", "q")
    return r.join(q, "k").agg(F.round(E.sum_of_products([["rs", "qc"], ["qs", "rc"]]), 2).alias("s"))


@query(
    "argmax_per_group",
    """SELECT p_brand, p_partkey, p_retailprice FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part)
       WHERE rn = 1""",
)
def _(t):
    part = t.part.select("p_brand", "p_partkey", "p_retailprice")
    return R.argmax_per_group(part, ["p_brand"], "p_retailprice", ["p_partkey"])


# -- windows ------------------------------------------------------------------


@query(
    "win_row_number",
    """SELECT event_id, CAST(ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS i FROM events""",
)
def _(t):
    return O.positions(t.events, ["user_id"], ["ts"]).select("event_id", (F.col("pos") + 1).alias("i"))


@query(
    "win_cumsum_by_value",
    """SELECT DISTINCT p_size, ROUND(SUM(p_retailprice) OVER (ORDER BY p_size), 2) AS s,
              CAST(COUNT(*) OVER (ORDER BY p_size) AS BIGINT) AS c FROM part""",
)
def _(t):
    rows = t.part.select("p_size", F.col("p_retailprice").alias("s0"), F.lit(1).cast("long").alias("c0"))
    out = R.cumsum_by_value(rows, "p_size", {"s": "s0", "c": "c0"})
    return out.select("p_size", F.round("s", 2).alias("s"), "c")


@query(
    "win_cumsum_by_ratio",
    """WITH g AS (SELECT p_brand, SUM(p_retailprice) AS s, COUNT(*) AS c FROM part GROUP BY 1)
       SELECT p_brand, ROUND(SUM(s) OVER w, 2) AS s, CAST(SUM(c) OVER w AS BIGINT) AS c FROM g
       WINDOW w AS (ORDER BY s / c, p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def _(t):
    """Running sums of categories ordered by their mean."""
    g = t.part.groupBy("p_brand").agg(F.sum("p_retailprice").alias("s0"), F.count("*").alias("c0"))
    g = g.withColumn("mean", F.col("s0") / F.col("c0"))
    out = O.running_sums(g, [], ["mean", "p_brand"], {"s": "s0", "c": "c0"})
    return out.select("p_brand", F.round("s", 2).alias("s"), "c")


@query(
    "win_cumsum_grouped",
    """WITH g AS (SELECT l_returnflag, l_quantity, COUNT(*) AS n FROM lineitem GROUP BY ALL)
       SELECT l_returnflag, l_quantity,
              CAST(SUM(n) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS BIGINT) AS upto FROM g""",
)
def _(t):
    rows = t.lineitem.select("l_returnflag", "l_quantity", F.lit(1).cast("long").alias("one"))
    return R.cumsum_by_value(rows, "l_quantity", {"upto": "one"}, ["l_returnflag"])


@query(
    "win_cumcount",
    """SELECT p_brand, p_type, CAST(ROW_NUMBER() OVER (PARTITION BY p_brand, p_type) AS BIGINT) AS nth FROM part""",
)
def _(t):
    return R.cumcount(t.part.select("p_brand", "p_type"))


@query(
    "latest_rows",
    """SELECT user_id, event_id, ts FROM (
         SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn <= 3""",
)
def _(t):
    return R.latest_rows(t.events, ["user_id"], "ts", 3).select("user_id", "event_id", "ts")


@query(
    "last_step",
    """WITH r AS (SELECT user_id, ts, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before,
                         ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events)
       SELECT user_id, ts AS last_ts, (EPOCH_US(ts) - EPOCH_US(before)) / 1e6 AS step_seconds FROM r WHERE rn = 1""",
)
def _(t):
    return R.last_step(t.events, ["user_id"], "ts")


# -- order and limit ----------------------------------------------------------


@query("order_by", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey")
def _(t):
    return R.Query(
        t.customer, ["c_custkey", "c_acctbal"], order_by=[F.col("c_acctbal").desc(), "c_custkey"]
    ).frame()


@query(
    "limit_rows",
    "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10",
)
def _(t):
    """Top ten; Spark keeps ten rows per task before merging."""
    return R.Query(
        t.customer, ["c_custkey", "c_acctbal"], order_by=[F.col("c_acctbal").desc(), "c_custkey"], limit=10
    ).frame()


# -- set operations and reshapes ----------------------------------------------

_A = "(SELECT c_nationkey AS k FROM customer)"
_B = "(SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)"


def _sides(t):
    a = t.customer.select(F.col("c_nationkey").alias("k"))
    return a, t.supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))


for _name, _op in {
    "set_union": "UNION",
    "set_union_all": "UNION ALL",
    "set_intersect": "INTERSECT",
    "set_intersect_all": "INTERSECT ALL",
    "set_except": "EXCEPT",
    "set_except_all": "EXCEPT ALL",
}.items():
    query(_name, f"SELECT k FROM {_A} {_op} SELECT k FROM {_B}")(
        lambda t, op=_op: R.set_query(op, *_sides(t))
    )


@query(
    "melt",
    """SELECT l_orderkey, l_linenumber, key, value FROM (
         SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem)
       UNPIVOT (value FOR key IN (l_quantity, l_discount, l_tax))""",
)
def _(t):
    wide = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return R.melt(wide, ["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"])


@query(
    "concat_frames",
    """SELECT 'part' AS relation, p_size AS value, COUNT(*) AS c FROM part GROUP BY p_size
       UNION ALL SELECT 'supplier', s_nationkey, COUNT(*) FROM supplier GROUP BY s_nationkey
       UNION ALL SELECT 'customer', c_nationkey, COUNT(*) FROM customer GROUP BY c_nationkey""",
)
def _(t):
    def counted(df, name, c):
        return df.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("c")).withColumn("relation", F.lit(name))

    return R.concat(
        [
            counted(t.part, "part", "p_size"),
            counted(t.supplier, "supplier", "s_nationkey"),
            counted(t.customer, "customer", "c_nationkey"),
        ]
    )


@query(
    "pivot_aligned",
    """SELECT CAST(DATE_TRUNC('day', ts) AS TIMESTAMP) AS day,
              ROUND(SUM(CASE WHEN event_type = 'click' THEN value END), 2) AS click,
              ROUND(SUM(CASE WHEN event_type = 'error' THEN value END), 2) AS error,
              ROUND(SUM(CASE WHEN event_type = 'purchase' THEN value END), 2) AS purchase,
              ROUND(SUM(CASE WHEN event_type = 'signup' THEN value END), 2) AS signup,
              ROUND(SUM(CASE WHEN event_type = 'view' THEN value END), 2) AS "view"
       FROM events GROUP BY 1""",
)
def _(t):
    from foreloom.operators.timeseries import pivot_series

    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    daily = t.events.select(day, "event_type", "value")
    names = ["click", "error", "purchase", "signup", "view"]
    out = pivot_series(daily, "day", "event_type", "value", names, agg=F.sum)
    return out.select("day", *[F.round(n, 2).alias(n) for n in names])
