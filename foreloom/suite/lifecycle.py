"""Queries of stored models, the stream, multivariate forecasts and evaluation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from foreloom.operators import css as C
from foreloom.operators import evaluate as E
from foreloom.operators import multivariate as M
from foreloom.operators import simplex as X
from foreloom.operators.trees import GradientBoosting, Node, Split, Tree
from foreloom.plans.packed import pack
from foreloom.session import cut, group_rows
from foreloom.sources.registry import Registry, Snapshot, changes
from foreloom.streaming import incremental as I
from foreloom.suite import query
from foreloom.suite.series import DAILY, daily, fold_sql, forecast_sql, hourly, users
from foreloom.suite.storage import scratch

KIND, TABLE, DATE, VALUE = "autoarima", "events", "ts", "value"


def fixed_snapshot(t, rows, d: int = 1) -> Snapshot:
    """One stored model per series with given parameters, without a search."""
    packed = pack(rows, ["series_id"])
    # written once: the models come from the series, the states from both
    packed = replace(packed, frame=cut(packed.frame))
    models = C.one_model(packed, [0.4, 0.1], [0.3, 0.2], 1.0, d)
    ids = models.withColumn("model_id", F.xxhash64(F.lit(KIND), F.lit(TABLE), F.lit(DATE), F.lit(VALUE), "series_id"))
    ids = ids.withColumn("arima_id", F.xxhash64("model_id", F.lit(0)))
    joined = cut(X.initial_states(packed, ids, carry=["model_id", "arima_id"], ends=True))
    names = joined.where("vertex_id = 0").select(
        "model_id", F.lit(KIND).alias("model_type"), F.lit(TABLE).alias("input_table"), F.lit(DATE).alias("date_column"),
        F.lit(VALUE).alias("value_column"), "series_id",
    )
    stats = joined.where("vertex_id = 0").select(
        "arima_id", "model_id", F.lit(0).alias("version"), "phi", "theta", "d", "c", F.lit(False).alias("use_log"),
        F.lit(True).alias("is_active"), "last_ts", "state",
    )
    around = joined.where("vertex_id > 0").select("arima_id", "vertex_id", "phi", "theta", "state", "model_id")
    return Snapshot(names, stats, around)


def user_rows(t):
    return users(t).select(F.col("k").cast("string").alias("series_id"), "ts", "value")


def stored(t, d: int = 1) -> Registry:
    registry = Registry(t.spark, scratch(t, "registry"))
    registry.write(fixed_snapshot(t, user_rows(t), d))
    return registry


_LOSS = "SELECT CAST(k AS VARCHAR) AS series_id, ROUND(ARG_MAX(css, i), 4) AS css FROM f GROUP BY k"


@query(
    "write_registry",
    fold_sql("""u AS (SELECT user_id AS k, ts, value AS y, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i FROM events)""",
             [0.4, 0.1], [0.3, 0.2], 1.0, 1, final="SELECT CAST(k AS VARCHAR) AS series_id, 5 AS vertices FROM f GROUP BY k"),
)
def _(t):
    """Models, statistics and vertices stored as one snapshot: p + q + 1 vertices each."""
    snap = stored(t).read()
    n = snap.vertices.groupBy("arima_id").agg(F.count("*").cast("int").alias("vertices"))
    return snap.active().join(n, "arima_id").select("series_id", "vertices")


_U = "u AS (SELECT user_id AS k, ts, value AS y, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i FROM events)"


@query("model_get_loss", fold_sql(_U, [0.4, 0.1], [0.3, 0.2], 1.0, 1, final=_LOSS))
def _(t):
    out = stored(t).model_get_loss(KIND, TABLE, DATE, VALUE)
    return out.select("series_id", F.round("css", 4).alias("css"))


@query("read_registry", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS series_id, 1 AS version, true AS is_active, 2 AS versions FROM events")
def _(t):
    """The active row after a second version was stored; the first one stays, inactive."""
    registry = stored(t)
    old = registry.read()
    registry.append(changes(old, old.models, old.stats, old.vertices))
    snap = registry.read()
    n = snap.stats.groupBy("model_id").agg(F.count("*").cast("int").alias("versions"))
    return snap.active().join(n, "model_id").select("series_id", "version", "is_active", "versions")


@query("join_registry", "SELECT DISTINCT CAST(user_id AS VARCHAR) AS series_id, 'autoarima' AS model_type, 1 AS d FROM events")
def _(t):
    return stored(t).read().active().select("series_id", "model_type", "d")


@query("model_get_id", "SELECT COUNT(DISTINCT user_id) AS models, COUNT(DISTINCT user_id) AS ids FROM events")
def _(t):
    out = stored(t).model_get_id(KIND, TABLE, DATE, VALUE)
    return out.agg(F.count("*").alias("models"), F.count_distinct("model_id").alias("ids"))


@query("arima_get_active_id", "SELECT COUNT(DISTINCT user_id) AS models, COUNT(DISTINCT user_id) AS ids FROM events")
def _(t):
    out = stored(t).arima_get_active_id(KIND, TABLE, DATE, VALUE)
    return out.agg(F.count("*").alias("models"), F.count_distinct("arima_id").alias("ids"))


@query("arima_has_vertices", "SELECT COUNT(DISTINCT user_id) AS with_vertices FROM events")
def _(t):
    return stored(t).arima_has_vertices().where("has_vertices").agg(F.count("*").alias("with_vertices"))


@query("remove_forecast", "SELECT CAST(COUNT(*) AS BIGINT) AS models, CAST(0 AS BIGINT) AS vertices FROM events WHERE user_id IS NULL")
def _(t):
    registry = stored(t)
    if not registry.remove_forecast(KIND, TABLE, DATE, VALUE):
        raise AssertionError("the stored models were not found")
    snap = registry.read()
    vertices = snap.vertices.agg(F.count("*").alias("vertices"))
    return snap.models.agg(F.count("*").alias("models")).select("models", vertices.scalar().alias("vertices"))


@query(
    "run_forecast",
    f"SELECT CAST(k AS VARCHAR) AS series_id, forecast_date, ROUND(forecast_value, 6) AS forecast_value FROM ({forecast_sql(1, 4)})",
)
def _(t):
    """Forecasts from the stored states only."""
    out = stored(t).run_forecast(KIND, TABLE, DATE, VALUE, 4)
    return out.select("series_id", "forecast_date", F.round("forecast_value", 6).alias("forecast_value"))


@query("create_forecast")
def _(t):
    """Search and register a model for the daily mean of every event type."""
    registry = Registry(t.spark, scratch(t, "registry"))
    registry.create_forecast(KIND, "daily", daily(t), "ts", "value", "k")
    return registry.read().active().select("series_id", "d", F.col("state.p").alias("p"), F.col("state.q").alias("q"), F.col("state.css").alias("css"))


# -- stream -------------------------------------------------------------------

SPLIT = "2024-01-20 00:00:00"


def _streamed(t, policy: str, name: str):
    """Stored models on the older rows; the newer rows arrive in three parts, of one file each where they are few."""
    cutoff = F.lit(SPLIT).cast("timestamp_ntz")
    rows = user_rows(t)
    registry = Registry(t.spark, scratch(t, "registry"))
    registry.write(fixed_snapshot(t, rows.where(F.col("ts") < cutoff)))
    folder = scratch(t, name)
    # the newer rows of a series stand in one file of each part, so that files are read in their order however many they are
    files = max(1, -(-t.events.count() // group_rows(t.spark)))
    days = ["2024-01-24", "2024-01-27", None]  # the last part has no end
    low = SPLIT
    for day in days:
        high = None
        part = rows.where(F.col("ts") >= F.lit(low).cast("timestamp_ntz"))
        if day is not None:
            high = f"{day} 00:00:00"
            part = part.where(F.col("ts") < F.lit(high).cast("timestamp_ntz"))
        part.repartition(files, "series_id").sortWithinPartitions("ts").write.mode("append").parquet(folder)
        low = high
    q = I.on_insert(
        t.spark, folder, "series_id string, ts timestamp_ntz, value double", registry, scratch(t, "checkpoint"),
        TABLE, "series_id", "ts", "value", policy=policy,
        seed=rows.where(F.col("ts") < cutoff).select("series_id", "ts", "value"), files_per_batch=files,
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return registry


@query("on_insert", fold_sql(_U, [0.4, 0.1], [0.3, 0.2], 1.0, 1, final=_LOSS))
def _(t):
    """States after three micro-batches equal the fold over the whole history."""
    out = _streamed(t, "fixed", "stream").model_get_loss(KIND, TABLE, DATE, VALUE)
    return out.select("series_id", F.round("css", 4).alias("css"))


@query("seed_then_stream", f"SELECT CAST(user_id AS VARCHAR) AS series_id, MAX(ts) AS last_ts, CAST(COUNT(*) - 1 AS BIGINT) AS t FROM events GROUP BY 1")
def _(t):
    """Older rows seed the models, newer rows arrive file by file."""
    active = _streamed(t, "fixed", "seeded").read().active()
    return active.select("series_id", "last_ts", F.col("state.t").alias("t"))


def _daily_batches(t, policy: str):
    """Daily series, models searched on the first part, one micro-batch with the rest."""
    # a few days per type of event: the events are added up once, not at every step of the searches
    rows = cut(daily(t).select(F.col("k").alias("series_id"), "ts", "value"))
    cutoff = F.lit("2024-01-25 00:00:00").cast("timestamp_ntz")
    registry = Registry(t.spark, scratch(t, "registry"))
    registry.create_forecast(KIND, TABLE, rows.where(F.col("ts") < cutoff), "ts", "value", "series_id")
    version = registry.versions()[-1] + 1
    snap = I.process_batch(
        rows.where(F.col("ts") >= cutoff), registry, version, lambda: rows, KIND, TABLE, DATE, VALUE, policy
    )
    return snap.active().select("series_id", "version", "d", F.col("state.css").alias("css"))


@query("retrain_breached")
def _(t):
    """Models whose vertices beat the centre are searched again on the whole history."""
    return _daily_batches(t, "geometric")


@query("retrain_policy")
def _(t):
    """The naive policy searches every model again with every batch."""
    return _daily_batches(t, "naive")


# -- multivariate -------------------------------------------------------------


def lag_model() -> GradientBoosting:
    """A hand-made model on two own lags and a lag of another series."""
    model = GradientBoosting(num_leaves=3, max_depth=2)
    nodes = {
        1: Node(1, 0, 0.0, 10.0, Split("train", "click_lag_1", "NUM", 300.0)),
        2: Node(2, 1, 0.0, 5.0, Split("train", "click_lag_2", "NUM", 250.0)),
        3: Node(3, 1, 100.0, 5.0, Split("train", "error_lag_1", "NUM", 200.0)),
        4: Node(4, 2, -120.0, 3.0),
        5: Node(5, 2, 90.0, 2.0),
        6: Node(6, 2, -60.0, 2.0),
        7: Node(7, 2, 150.0, 3.0),
    }
    model.constant = 280.0
    model.trees = [Tree(nodes, {1, 2, 3}, 1.0)]
    return model


_HOURLY = """w AS (SELECT DATE_TRUNC('hour', ts) AS ts, SUM(CASE WHEN event_type = 'click' THEN value ELSE 0 END) AS click,
                   SUM(CASE WHEN event_type = 'error' THEN value ELSE 0 END) AS error FROM events GROUP BY 1),
             r AS (SELECT *, ROW_NUMBER() OVER (ORDER BY ts DESC) AS rn FROM w)"""
_MODEL = """280.0 + CASE WHEN l1 <= 300.0 THEN CASE WHEN l2 <= 250.0 THEN -40.0 ELSE 45.0 END
                        ELSE CASE WHEN e1 <= 200.0 THEN -30.0 ELSE 50.0 END END"""


@query(
    "recursive_lag_forecast",
    f"""WITH RECURSIVE {_HOURLY},
        f AS (SELECT 0 AS step, (SELECT click FROM r WHERE rn = 1) AS click, (SELECT click FROM r WHERE rn = 1) AS l1,
                     (SELECT click FROM r WHERE rn = 2) AS l2, (SELECT error FROM r WHERE rn = 1) AS e1
              UNION ALL SELECT step + 1, CAST({_MODEL} AS DOUBLE), click, l1, e1 FROM f WHERE step < 12)
        SELECT step, ROUND(click, 6) AS click,
               CAST((SELECT ts FROM r WHERE rn = 1) + step * ((SELECT ts FROM r WHERE rn = 1) - (SELECT ts FROM r WHERE rn = 2)) AS TIMESTAMP) AS forecast_date
        FROM f WHERE step > 0""",
)
def _(t):
    out = M.recursive_lag_forecast({"click": lag_model()}, hourly(t), [], "ts", 2, 12)
    return out.select("step", F.round("click", 6).alias("click"), "forecast_date")


@query("boost_on_new_rows")
def _(t):
    """Lag rows that came after the first part, and more trees on them."""
    base = hourly(t)
    cutoff = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    targets = ["click"]
    old, names = M.lag_rows(base.where(F.col("ts") < cutoff), "ts", targets, 3, 3)
    model = M.booster(trees=2, more=1).fit(M.lag_graph(old, names, "click"), skip_check=True)
    models, train = M.boost_on_new_rows({"click": model}, base, old, "ts", targets, 3, 3)
    return models["click"].predict(train).select("ts", "click", "prediction")


# -- evaluation ---------------------------------------------------------------

_PAIRS = """SELECT l_suppkey AS k, l_extendedprice AS f, l_extendedprice * (1 - l_discount) AS a FROM lineitem"""


def _pairs(t):
    from foreloom.plans.ordered import positions

    rows = positions(t.lineitem, ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "step")
    rows = rows.select(
        F.col("l_suppkey").alias("k"), "step", F.col("l_extendedprice").alias("forecast_value"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"),
    )
    return cut(rows)


@query("rmse", f"SELECT k, ROUND(SQRT(SUM(POW(f - a, 2)) / COUNT(*)), 4) AS rmse FROM ({_PAIRS}) GROUP BY k")
def _(t):
    p = _pairs(t)
    return E.rmse(p, p.select("k", "step", "value"), ["k"]).select("k", F.round("rmse", 4).alias("rmse"))


@query(
    "msmape",
    f"""SELECT k, ROUND(100.0 / COUNT(*) * SUM(ABS(f - a) / GREATEST((ABS(a) + ABS(f)) / 2 + 1e-12, 0.5 + 1e-12)), 6) AS msmape
        FROM ({_PAIRS}) GROUP BY k""",
)
def _(t):
    p = _pairs(t)
    return E.msmape(p, p.select("k", "step", "value"), ["k"]).select("k", F.round("msmape", 6).alias("msmape"))


@query(
    "benchmark_summary",
    """SELECT l_returnflag, ROUND(AVG(l_tax), 6) AS avg_insert, ROUND(AVG(l_discount), 6) AS avg_forecast,
              ROUND(SUM(l_quantity), 2) AS sum_rmse, ROUND(AVG(l_extendedprice), 4) AS avg_msmape FROM lineitem GROUP BY 1""",
)
def _(t):
    rows = t.lineitem.select(
        "l_returnflag", F.col("l_tax").alias("insert_seconds"), F.col("l_discount").alias("forecast_seconds"),
        F.col("l_quantity").alias("rmse"), F.col("l_extendedprice").alias("msmape"),
    )
    out = E.benchmark_summary(rows, ["l_returnflag"])
    return out.select(
        "l_returnflag", F.round("avg_insert", 6).alias("avg_insert"), F.round("avg_forecast", 6).alias("avg_forecast"),
        F.round("sum_rmse", 2).alias("sum_rmse"), F.round("avg_msmape", 4).alias("avg_msmape"),
    )


def _ar_sql(train: str, ends: str, final: str) -> str:
    """An AR(1) with constant by regression on ``train`` rows of u, forecast from the rows ``ends`` (k, cut, n)."""
    return f"""WITH RECURSIVE {DAILY}, c AS (SELECT k, COUNT(*) AS n_rows FROM u GROUP BY k),
      l AS (SELECT u.k, i, y, LAG(y) OVER (PARTITION BY u.k ORDER BY i) AS x, n_rows FROM u JOIN c ON c.k = u.k),
      m AS (SELECT k, REGR_SLOPE(y, x) AS phi, REGR_INTERCEPT(y, x) AS a FROM l WHERE x IS NOT NULL AND {train} GROUP BY k),
      z AS ({ends}),
      h AS (SELECT z.k, z.cut, 0 AS step, u.y AS f, phi, a FROM z JOIN u ON u.k = z.k AND u.i = z.cut - 1 JOIN m ON m.k = z.k
            UNION ALL SELECT k, cut, step + 1, a + phi * f, phi, a FROM h WHERE step < 5),
      e AS (SELECT h.k, h.cut, SQRT(AVG((f - y) * (f - y))) AS rmse, COUNT(*) AS n,
                   100 * AVG(ABS(f - y) / GREATEST((ABS(y) + ABS(f)) / 2 + 1e-12, 0.5 + 1e-12)) AS msmape
            FROM h JOIN u ON u.k = h.k AND u.i = h.cut + h.step - 1 WHERE step > 0 GROUP BY h.k, h.cut)
      {final}"""


@query(
    "rolling_origin_eval",
    _ar_sql("i < 15", "SELECT k, UNNEST([15, 20, 25]) AS cut FROM c", "SELECT k, CAST(cut AS INTEGER) AS cut, ROUND(rmse, 4) AS rmse, ROUND(msmape, 4) AS msmape, n FROM e"),
)
def _(t):
    """A model of the first rows, then rows inserted and a forecast at every cut."""
    out = E.rolling_origin_eval(daily(t), ["k"], [15, 20, 25], 5, (1, 0, 0))
    return out.select("k", "cut", F.round("rmse", 4).alias("rmse"), F.round("msmape", 4).alias("msmape"), "n")


@query(
    "fixed_window_eval",
    _ar_sql("i < n_rows - 5", "SELECT k, n_rows - 5 AS cut FROM c", "SELECT k, ROUND(rmse, 4) AS rmse, ROUND(msmape, 4) AS msmape FROM e"),
)
def _(t):
    out = E.fixed_window_eval(daily(t), ["k"], 5, (1, 0, 0))
    return out.select("k", F.round("rmse", 4).alias("rmse"), F.round("msmape", 4).alias("msmape"))
