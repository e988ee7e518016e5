"""Queries of sources and sinks; files are derived from the tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foreloom.operators import relational as R
from foreloom.sources import files as S
from foreloom.sources import tsf
from foreloom.suite import query
from foreloom.suite.series import DAILY, daily
from foreloom.session import shared_folder


def scratch(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/suite-{name}-{uuid.uuid4().hex}"


@query("read_csv_relation", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    path = scratch(t, "csv")
    t.customer.write.option("header", True).csv(path)
    schema = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    return S.read_csv_relation(t.spark, path, schema, "foreloom_customer")


# The six star files from the tables: columns of the file, each as SQL that both engines read, and the table.
_STAR = {
    "holidays": (["CAST(ts AS DATE)", "event_type", "'day'", "CAST(user_id AS VARCHAR(20))", "'none'", "event_id % 2 = 0"], "events"),
    "items": (["CAST(p_partkey AS INT)", "p_type", "p_brand", "p_size"], "part"),
    "oil": (["CAST(o_orderdate AS DATE)", "CAST(CAST(o_custkey AS DECIMAL(12, 0)) AS DECIMAL(18, 6))"], "orders"),
    "stores": (["CAST(s_suppkey AS INT)", "s_name", "CAST(s_nationkey AS VARCHAR(20))", "'x'", "1"], "supplier"),
    "trans": (["CAST(o_orderdate AS DATE)", "CAST(o_custkey AS INT)", "CAST(o_orderkey AS INT)"], "orders"),
    "sales": (
        ["CAST(l_orderkey AS INT)", "CAST(l_shipdate AS DATE)", "CAST(l_suppkey AS INT)", "CAST(l_partkey AS INT)",
         "CAST(CAST(l_quantity AS DECIMAL(12, 0)) AS DECIMAL(18, 6))", "l_returnflag = 'R'"],
        "lineitem",
    ),
}


def _star_sql() -> str:
    """One text per row of each file, with the empty extra column at its end."""
    def line(columns):
        return " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in columns) + " || '|none'"

    parts = [f"SELECT '{n}' AS relation, {line(columns)} AS line FROM {table}" for n, (columns, table) in _STAR.items()]
    return " UNION ALL ".join(parts)


@query("bulk_load_star", _star_sql())
def _(t):
    folder = scratch(t, "star")
    for name, (columns, table) in _STAR.items():
        fields = [f.split()[0] for f in S.STAR_SCHEMAS[name].split(", ")]
        rows = getattr(t, table).selectExpr(*[f"{c} AS {f}" for c, f in zip(columns, fields)])
        rows.write.option("header", True).csv(f"{folder}/{name}.csv")
    loaded = S.bulk_load_star(t.spark, folder, f"{folder}/parquet")
    return R.concat(
        [
            df.select(
                F.lit(name).alias("relation"),
                F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in df.columns]).alias("line"),
            )
            for name, df in loaded.items()
        ]
    )


@query("read_long_csv", f"WITH {DAILY} SELECT CAST(i AS INTEGER) AS date, ROUND(y, 6) AS data, k AS cols FROM u")
def _(t):
    from foreloom.plans.ordered import positions

    path = scratch(t, "long")
    rows = positions(daily(t), ["k"], ["ts"])
    rows.select(F.col("pos").alias("date"), F.round("value", 6).alias("data"), F.col("k").alias("cols")).write.option(
        "header", True
    ).csv(path)
    return S.read_long_csv(t.spark, path, index=True)


def write_tsf(t) -> str:
    """A series file of the daily means, one line per event type."""
    path = scratch(t, "tsf")
    rows = daily(t)
    values = F.transform(F.array_sort(F.collect_list(F.struct("ts", "value"))), lambda x: F.round(x["value"], 6))
    text = F.transform(values, lambda v: F.when(v > 60, F.lit("?")).otherwise(v.cast("string")))
    start = F.date_format(F.min("ts"), "yyyy-MM-dd HH-mm-ss")
    lines = rows.groupBy("k").agg(start.alias("start"), F.array_join(text, ",").alias("v")).select(
        F.concat(F.lit("1"), "k").alias("o"), F.concat_ws(":", "k", "start", "v").alias("line")
    )
    header = [
        "# daily means", "@attribute series_name string", "@attribute start_timestamp date",
        "@frequency daily", "@horizon 7", "@missing true", "@equallength true", "@data",
    ]
    head = t.spark.createDataFrame([(f"0{i}", line) for i, line in enumerate(header)], "o string, line string")
    # one line per event type: the file is small by construction
    head.unionByName(lines).orderBy("o").select("line").coalesce(1).write.text(path)
    return path


_CUT = "CASE WHEN ROUND(y, 6) > 60 THEN NULL ELSE ROUND(y, 6) END"


@query(
    "read_tsf_meta",
    """SELECT 'series_name' AS attribute, 'string' AS type, 'daily' AS frequency, 7 AS horizon, true AS missing, true AS equal_length,
              COUNT(DISTINCT event_type) AS series FROM events
       UNION ALL SELECT 'start_timestamp', 'date', 'daily', 7, true, true, COUNT(DISTINCT event_type) FROM events""",
)
def _(t):
    path = write_tsf(t)
    meta = tsf.read_tsf_meta(t.spark, path)
    n = tsf.read_tsf_series(t.spark, path, meta=meta).agg(F.count("*").alias("series"))
    names = F.explode(F.arrays_zip(
        F.array(*[F.lit(c) for c in meta["attributes"]]).alias("a"), F.array(*[F.lit(c) for c in meta["attributes"].values()]).alias("b")
    )).alias("z")
    return n.select("series", names).select(
        F.col("z.a").alias("attribute"), F.col("z.b").alias("type"), F.lit(meta["frequency"]).alias("frequency"),
        F.lit(meta["horizon"]).alias("horizon"), F.lit(meta["missing"]).alias("missing"),
        F.lit(meta["equallength"]).alias("equal_length"), "series",
    )


@query(
    "read_tsf_series",
    f"""WITH {DAILY} SELECT k AS series_name, CAST(MIN(ts) AS TIMESTAMP) AS start_timestamp, CAST(COUNT(*) AS INTEGER) AS n,
               ROUND(SUM({_CUT}), 4) AS total FROM u GROUP BY k""",
)
def _(t):
    out = tsf.read_tsf_series(t.spark, write_tsf(t))
    total = F.aggregate("series", F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))
    return out.select("series_name", "start_timestamp", F.size("series").alias("n"), F.round(total, 4).alias("total"))


@query(
    "read_tsf_values",
    f"""WITH {DAILY}, s AS (SELECT k, MIN(ts) AS s0 FROM u GROUP BY k)
        SELECT u.k AS series_name, CAST(s0 AS TIMESTAMP) AS start_timestamp, CAST(i AS INTEGER) AS time_index,
               CAST(ROW_NUMBER() OVER (ORDER BY u.k, i) - 1 AS BIGINT) AS global_index, {_CUT} AS value FROM u JOIN s ON s.k = u.k""",
)
def _(t):
    return tsf.read_tsf_values(t.spark, write_tsf(t))


@query(
    "read_tsf_aligned",
    f"""WITH {DAILY}, m AS (SELECT MIN(ts) AS t0 FROM u)
        SELECT CAST(i AS INTEGER) AS index, CAST((SELECT t0 FROM m) + i * INTERVAL 1 MINUTE AS TIMESTAMP) AS timestamp,
               {', '.join(f"MAX(CASE WHEN k = '{n}' THEN {_CUT} END) AS {chr(34)}{n}{chr(34)}" for n in ('click', 'error', 'purchase', 'signup', 'view'))}
        FROM u GROUP BY i""",
)
def _(t):
    return tsf.read_tsf_aligned(t.spark, write_tsf(t))


@query("append_rows", "SELECT event_id, value FROM events")
def _(t):
    path = scratch(t, "append")
    late = F.col("event_type") == "error"
    S.append_rows(t.events.where(~late).select("event_id", "value"), path)
    S.append_rows(t.events.where(late).select("event_id", "value"), path)
    return t.spark.read.parquet(path)


@query(
    "insert_ignore",
    """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'
       UNION ALL SELECT o_orderkey, 'new' FROM orders WHERE o_orderstatus = 'F'""",
)
def _(t):
    stored = t.orders.where("o_orderstatus <> 'F'").select("o_orderkey", "o_orderstatus")
    offered = t.orders.select("o_orderkey", F.lit("new").alias("o_orderstatus"))
    return stored.unionByName(S.insert_ignore(offered, stored, ["o_orderkey"]))


@query("delete_rows", "SELECT event_id, ts FROM events WHERE NOT (ts > TIMESTAMP '2024-01-20 00:00:00')")
def _(t):
    limit = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    kept = S.delete_rows(t.events.select("event_id", "ts"), F.col("ts") > limit)
    return t.spark.read.parquet(S.rewrite(kept, scratch(t, "delete")))


@query("truncate", "SELECT event_id, ts FROM events LIMIT 0")
def _(t):
    return S.truncate(t.events.select("event_id", "ts"))


@query("materialize", "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY ALL")
def _(t):
    block = R.Query(t.orders, [F.count("*").alias("n")], group_by=["o_orderstatus"]).frame()
    table = R.materialize(block, "table")
    view = R.materialize(table, "view", "foreloom_counts")
    return R.materialize(view, "inline")


@query(
    "export_training_join",
    "SELECT l_orderkey AS id, l_linenumber, o_orderstatus, p_size FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey",
)
def _(t):
    path = scratch(t, "export")
    joined = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        t.part, F.col("l_partkey") == F.col("p_partkey")
    )
    S.export_training_join(joined.select(F.col("l_orderkey").alias("id"), "l_linenumber", "o_orderstatus", "p_size"), path)
    return t.spark.read.parquet(path)


@query(
    "table_layout",
    """SELECT l_orderkey, l_linenumber, l_partkey, STRFTIME(DATE_TRUNC('month', l_shipdate), '%Y-%m-%d') AS chunk FROM lineitem""",
)
def _(t):
    path = scratch(t, "layout")
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    S.table_layout(rows, path, "l_shipdate", ["l_partkey"])
    return t.spark.read.option("basePath", path).parquet(path).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.date_format("chunk", "yyyy-MM-dd").alias("chunk")
    )


@query("benchmark_sink", "SELECT event_type AS type, ROUND(AVG(value), 6) AS seconds FROM events GROUP BY ALL")
def _(t):
    path = scratch(t, "bench")
    rows = t.events.groupBy(F.col("event_type").alias("type")).agg(F.round(F.avg("value"), 6).alias("seconds"))
    S.benchmark_sink(rows, path)
    return t.spark.read.option("header", True).schema("type string, seconds double").csv(path)


@query(
    "generate_series_table",
    """SELECT event_id, i, ROUND(10.0 * POW(0.8, i % 10) + 0.1 * ((i * 7919 + 42) % 1009) / 1009.0, 9) AS made
       FROM (SELECT event_id, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i FROM events)""",
)
def _(t):
    """A made-up series in the place of every user's events."""
    out = S.generated_series(t.events, ["user_id"], ["ts"])
    return out.select("event_id", "i", F.round("made", 9).alias("made"))
