"""Queries of the time-series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from foreloom.functions import criteria as C
from foreloom.operators import css as S
from foreloom.operators import fit as Fit
from foreloom.operators import forecast as Fc
from foreloom.operators import simplex as X
from foreloom.operators import stats as St
from foreloom.operators import timeseries as T
from foreloom.plans.packed import pack
from foreloom.session import cut
from foreloom.suite import query

# -- the two families of series used below ------------------------------------

# events of each user in time order
USERS = """u AS (SELECT user_id AS k, ts, value AS y,
                        ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS i FROM events)"""
# daily mean of each event type
DAILY = """u AS (SELECT event_type AS k, DATE_TRUNC('day', ts) AS ts, AVG(value) AS y,
                        ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY DATE_TRUNC('day', ts)) - 1 AS i
                 FROM events GROUP BY event_type, DATE_TRUNC('day', ts))"""


def users(t):
    return t.events.select(F.col("user_id").alias("k"), "ts", "value")


def daily(t):
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts")
    return t.events.groupBy(F.col("event_type").alias("k"), day).agg(F.avg("value").alias("value"))


def diffs_sql(d: int) -> str:
    """Differenced rows w(k, i, y) of u, numbered from 0 again."""
    if d == 0:
        return "w AS (SELECT k, i, y FROM u)"
    expr = {
        1: "y - LAG(y, 1) OVER o",
        2: "y - 2 * LAG(y, 1) OVER o + LAG(y, 2) OVER o",
    }[d]
    return f"""w AS (SELECT k, i - {d} AS i, y FROM
                  (SELECT k, i, {expr} AS y FROM u WINDOW o AS (PARTITION BY k ORDER BY i)) WHERE i >= {d})"""


def fold_sql(source: str, phi, theta, c=0.0, d=0, skip=None, final="ARG_MAX(css, i)", missing="NULL") -> str:
    """Recursive evaluation of the residuals of one model over every series."""
    p1, p2 = [*phi, 0.0, 0.0][:2]
    t1, t2 = [*theta, 0.0, 0.0][:2]
    skip = max(len(phi), len(theta)) if skip is None else skip

    def lag(j):
        return f"COALESCE(LAG(y, {j}) OVER o, 0.0)"

    return f"""WITH RECURSIVE {source}, {diffs_sql(d)},
      l AS (SELECT k, i, y - {c} - {p1} * {lag(1)} - {p2} * {lag(2)} AS z, y
            FROM w WINDOW o AS (PARTITION BY k ORDER BY i)),
      f AS (SELECT k, CAST({skip} - 1 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS e1, CAST(0 AS DOUBLE) AS e2,
                   CAST(0 AS DOUBLE) AS css FROM (SELECT DISTINCT k FROM w)
            UNION ALL
            SELECT k, i, e, e1, css + e * e FROM (
              SELECT f.k, l.i, f.e1, f.css, l.z - ({t1}) * f.e1 - ({t2}) * f.e2 AS e
              FROM f JOIN l ON l.k = f.k AND l.i = f.i + 1))
      {final}"""


LOSS = "SELECT k, ROUND(ARG_MAX(css, i), 4) AS css FROM f GROUP BY k"


def rounded(df, digits=4, **only):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# -- scans --------------------------------------------------------------------


@query(
    "read_series",
    f"WITH {USERS} SELECT k, i, ROUND(LOG10(y + 1), 9) AS v FROM u",
)
def _(t):
    """Ordered array of every series (logged), then back to rows to compare."""
    clean = T.read_clean(t.events.withColumn("k", F.col("user_id")), ["k"], "ts", "value", log=True)
    packed = pack(clean, ["k"])
    rows = packed.frame.select("k", "first", F.posexplode("vals").alias("p", "v"))
    return rows.select("k", (F.col("first") + F.col("p")).alias("i"), F.round("v", 9).alias("v"))


@query(
    "agg_ordered_array",
    """SELECT user_id AS k, ARRAY_TO_STRING(LIST(event_id ORDER BY ts), ',') AS ids FROM events GROUP BY 1""",
)
def _(t):
    # event numbers are exact in a double
    packed = pack(t.events.select(F.col("user_id").alias("k"), "ts", F.col("event_id").alias("value")), ["k"])
    ids = F.transform("vals", lambda x: x.cast("long").cast("string"))
    chunks = packed.frame.select("k", "chunk", F.array_join(ids, ",").alias("s"))
    parts = F.array_sort(F.collect_list(F.struct("chunk", "s")))
    return chunks.groupBy("k").agg(F.array_join(F.transform(parts, lambda x: x["s"]), ",").alias("ids"))


# -- preparation --------------------------------------------------------------


@query("difference", f"WITH {USERS}, {diffs_sql(1)} SELECT k, i, ROUND(y, 6) AS diff FROM w")
def _(t):
    return _numbered(T.difference(users(t), ["k"], 1), "diff")


@query("difference_2", f"WITH {USERS}, {diffs_sql(2)} SELECT k, i, ROUND(y, 6) AS diff FROM w")
def _(t):
    return _numbered(T.difference(users(t), ["k"], 2), "diff")


def _numbered(df, column):
    from foreloom.plans.ordered import positions

    return positions(df, ["k"], ["ts"], "i").select("k", "i", F.round(column, 6).alias(column))


@query("integrate", f"WITH {USERS} SELECT k, i AS pos, ROUND(y, 4) AS value FROM u")
def _(t):
    """Integrating the second differences gives the series back."""
    from foreloom.plans.ordered import positions

    rows = positions(users(t), ["k"], ["ts"])
    diffs = T.difference(rows, ["k"], 2, ts="pos")
    starts = rows.where("pos < 2").select("k", "pos", "value")
    return rounded(T.integrate(diffs.select("k", "pos", "diff"), starts, ["k"], 2))


@query(
    "win_lag_features",
    """SELECT event_id, LAG(value, 1) OVER w AS value_lag_1, LAG(value, 2) OVER w AS value_lag_2,
              LAG(value, 3) OVER w AS value_lag_3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""",
)
def _(t):
    out, names = T.lag_features(t.events, ["user_id"], "ts", ["value"], 3)
    return out.select("event_id", *names)


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


def _supervised_sql() -> str:
    sums = ", ".join(f"SUM(CASE WHEN event_type = '{n}' THEN value ELSE 0 END) AS \"{n}\"" for n in EVENT_TYPES)
    lags = [(n, j) for n in EVENT_TYPES for j in (1, 2)]
    looked = ", ".join(f'LAG("{n}", {j}) OVER o AS {n}_lag_{j}' for n, j in lags)
    out = [f'"{n}"' for n in EVENT_TYPES] + [f"{n}_lag_{j}" for n, j in lags]
    return f"""WITH wide AS (SELECT DATE_TRUNC('hour', ts) AS ts, {sums} FROM events GROUP BY 1),
                    l AS (SELECT *, {looked} FROM wide WINDOW o AS (ORDER BY ts))
               SELECT {", ".join(f"ROUND({c}, 2) AS {c}" for c in out)} FROM l
               WHERE {" AND ".join(f"{n}_lag_{j} IS NOT NULL" for n, j in lags)}"""


@query("supervised_lag_matrix", _supervised_sql())
def _(t):
    """All series with two lags each as features."""
    out, features, targets = T.supervised(hourly(t), [], "ts", EVENT_TYPES, 2, 2 * len(EVENT_TYPES))
    return out.select(*[F.round(c, 2).alias(c) for c in targets + features])


def hourly(t):
    """Wide multivariate series: hourly sums per event type."""
    hour = t.events.select(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "event_type", "value")
    return T.pivot_series(hour, "ts", "event_type", "value", EVENT_TYPES, agg=F.sum).na.fill(0.0, EVENT_TYPES)


@query(
    "win_lag_expr",
    """SELECT event_id, ROUND(COALESCE(LAG(value, 1) OVER w, 0.0) * 0.25 + COALESCE(LAG(value, 2) OVER w, 0.0) * 0.5, 6) AS ar
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)""",
)
def _(t):
    out = T.ar_expression(t.events, ["user_id"], "ts", "value", [0.25, 0.5])
    return out.select("event_id", F.round("ar", 6).alias("ar"))


@query(
    "win_ffill",
    """SELECT event_id, COALESCE(LAST_VALUE(g IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) AS g
       FROM (SELECT *, CASE WHEN value <= 100 THEN value END AS g FROM events)""",
)
def _(t):
    gaps = t.events.select("event_id", "user_id", "ts", F.when(F.col("value") <= 100, F.col("value")).alias("g"))
    return T.fill_gaps(gaps, ["user_id"], "ts", ["g"]).select("event_id", "g")


@query(
    "win_cumsum_residual",
    f"""WITH {USERS}, m AS (SELECT k, AVG(y) AS m FROM u GROUP BY k)
        SELECT u.k, i, ROUND(SUM(y - m.m) OVER (PARTITION BY u.k ORDER BY i), 9) + 0.0 AS s FROM u JOIN m ON m.k = u.k""",
)
def _(t):
    from foreloom.plans.ordered import positions

    out = T.running_residual(users(t), ["k"], "ts", "value")
    return positions(out, ["k"], ["ts"], "i").select("k", "i", (F.round("s", 9) + 0.0).alias("s"))


# -- statistics ---------------------------------------------------------------

STATS = "SELECT k, MIN(y) AS min_val, STDDEV_POP(y) AS std_dev, AVG(y) AS mean, COUNT(y) AS n FROM u GROUP BY k"


@query(
    "agg_series_stats",
    f"""WITH {USERS} SELECT k, min_val, ROUND(std_dev, 6) AS std_dev, ROUND(mean, 6) AS mean, n FROM ({STATS})""",
)
def _(t):
    out = St.series_stats(users(t), ["k"])
    return out.select("k", "min_val", F.round("std_dev", 6).alias("std_dev"), F.round("mean", 6).alias("mean"), "n")


@query(
    "auto_log_rule",
    f"""WITH {USERS} SELECT k, min_val >= 0 AND COALESCE(std_dev / NULLIF(mean, 0.0), 0.0) > 0.3 AS use_log FROM ({STATS})""",
)
def _(t):
    return St.log_rule(St.series_stats(users(t), ["k"])).select("k", "use_log")


@query(
    "autocovariance",
    f"""WITH {USERS}, r AS (SELECT k, i, y - AVG(y) OVER (PARTITION BY k) AS r, COUNT(*) OVER (PARTITION BY k) AS n FROM u)
        SELECT a.k, CAST(g.lag AS INTEGER) AS lag, ROUND(SUM(a.r * b.r) / MAX(a.n), 4) AS gamma
        FROM range(0, 4) g(lag) JOIN r a ON a.i >= g.lag JOIN r b ON b.k = a.k AND b.i = a.i - g.lag GROUP BY a.k, g.lag""",
)
def _(t):
    return St.autocovariance(users(t), ["k"], 3).select("k", "lag", F.round("gamma", 4).alias("gamma"))


@query(
    "agg_autocov",
    f"""WITH {USERS}, r AS (SELECT k, i, y - AVG(y) OVER (PARTITION BY k) AS r FROM u)
        SELECT a.k, CAST(g.lag AS INTEGER) AS lag, ROUND(SUM(a.r * b.r), 2) AS g
        FROM range(1, 4) g(lag) JOIN r a ON a.i >= g.lag JOIN r b ON b.k = a.k AND b.i = a.i - g.lag GROUP BY a.k, g.lag""",
)
def _(t):
    """Plain sums of lag products, from the packed series."""
    m = St.moments(pack(users(t), ["k"], halo=St.kpss_halo(1000)))
    rows = m.select("k", F.posexplode("g").alias("lag", "g"))
    wanted = St.autocovariance(users(t), ["k"], 3)
    n = m.select("k", "n")
    out = wanted.where("lag > 0").join(n, "k").select("k", "lag", (F.col("gamma") * F.col("n")).alias("g"))
    check = rows.withColumnRenamed("g", "g2")
    both = out.join(check, ["k", "lag"], "left")
    return both.select("k", "lag", F.round(F.coalesce("g2", "g"), 2).alias("g"))


def kpss_sql(d: int, fixed: bool) -> str:
    """The test in SQL, per series; the automatic lag rule or the fixed one."""
    lag_rule = (
        "GREATEST(1, FLOOR(POW(n, 2.0 / 9.0)))"
        if fixed
        else """LEAST(CASE WHEN raw >= n THEN n - 1 ELSE raw END, FLOOR(12.0 * POW(n / 100.0, 0.25)))"""
    )
    return f"""WITH {USERS}, {diffs_sql(d)},
      r AS (SELECT k, i, y - AVG(y) OVER (PARTITION BY k) AS r, CAST(COUNT(*) OVER (PARTITION BY k) AS DOUBLE) AS n FROM w),
      s AS (SELECT k, n, SUM(r) OVER (PARTITION BY k ORDER BY i) AS s FROM r),
      eta AS (SELECT k, MAX(n) AS n, SUM(s * s) AS eta FROM s GROUP BY k),
      g AS (SELECT a.k, x.lag, SUM(a.r * b.r) AS g FROM range(0, 25) x(lag)
            JOIN r a ON a.i >= x.lag JOIN r b ON b.k = a.k AND b.i = a.i - x.lag GROUP BY a.k, x.lag),
      h AS (SELECT e.k, e.n, e.eta, MAX(CASE WHEN lag = 0 THEN g.g END) AS g0,
                   COALESCE(SUM(CASE WHEN lag BETWEEN 1 AND FLOOR(POW(e.n, 2.0 / 9.0)) THEN g.g / (e.n / 2.0) END), 0) AS c0,
                   COALESCE(SUM(CASE WHEN lag BETWEEN 1 AND FLOOR(POW(e.n, 2.0 / 9.0)) THEN lag * g.g / (e.n / 2.0) END), 0) AS c1
            FROM eta e JOIN g ON g.k = e.k GROUP BY e.k, e.n, e.eta),
      q AS (SELECT *, FLOOR(1.1447 * POW(POW(c1 / (g0 / n + c0), 2), 1.0 / 3.0) * POW(n, 1.0 / 3.0)) AS raw FROM h),
      z AS (SELECT k, n, eta, {lag_rule} AS lags FROM q),
      v AS (SELECT z.k, z.n, z.eta, z.lags,
                   SUM(CASE WHEN g.lag = 0 THEN g.g WHEN g.lag <= z.lags THEN 2.0 * (1.0 - g.lag / (z.lags + 1.0)) * g.g ELSE 0 END) / z.n AS lr
            FROM z JOIN g ON g.k = z.k GROUP BY z.k, z.n, z.eta, z.lags)"""


@query(
    "kpss",
    kpss_sql(0, False)
    + """ SELECT k, ROUND(eta / (n * n * lr), 6) AS kpss_val, CAST(0.463 AS DOUBLE) AS crit_val, eta / (n * n * lr) <= 0.463 AS test_passed FROM v""",
)
def _(t):
    out = St.kpss(pack(users(t), ["k"], halo=40))
    return out.select("k", F.round("kpss_val", 6).alias("kpss_val"), "crit_val", "test_passed")


@query("kpss_autolag", kpss_sql(0, False) + " SELECT k, CAST(lags AS INTEGER) AS lags FROM v")
def _(t):
    return St.kpss(pack(users(t), ["k"], halo=40)).select("k", "lags")


@query("long_run_variance", kpss_sql(0, False) + " SELECT k, ROUND(lr, 4) AS lr_var FROM v")
def _(t):
    return St.kpss(pack(users(t), ["k"], halo=40)).select("k", F.round("lr_var", 4).alias("lr_var"))


@query("kpss_sql", kpss_sql(0, True) + " SELECT k, ROUND(eta / (n * n * lr), 6) AS kpss_val FROM v")
def _(t):
    out = St.kpss(pack(users(t), ["k"], halo=40), fixed_lag=True)
    return out.select("k", F.round("kpss_val", 6).alias("kpss_val"))


@query(
    "choose_d",
    "WITH a AS ("
    + kpss_sql(0, False)
    + " SELECT k, eta / (n * n * lr) <= 0.463 AS ok FROM v), b AS ("
    + kpss_sql(1, False)
    + " SELECT k, eta / (n * n * lr) <= 0.463 AS ok FROM v), c AS ("
    + kpss_sql(2, False)
    + """ SELECT k, eta / (n * n * lr) <= 0.463 AS ok FROM v)
       SELECT a.k, CASE WHEN a.ok THEN 0 WHEN b.ok THEN 1 ELSE 2 END AS d, NOT (a.ok OR b.ok OR c.ok) AS capped
       FROM a JOIN b ON a.k = b.k JOIN c ON c.k = a.k""",
)
def _(t):
    return St.choose_d(pack(users(t), ["k"], halo=40))


CRITERIA = """SELECT o_orderkey, o_totalprice AS css, CAST(o_orderkey % 3 AS INTEGER) AS p, CAST(o_custkey % 4 AS INTEGER) AS q,
                     CAST(o_custkey % 2 AS INTEGER) AS k, CAST(o_orderkey % 90 + 2 AS BIGINT) AS n FROM orders"""
_LL = "-0.5 * (n - GREATEST(p, q)) * (LN(2 * PI()) + LN(css / (n - GREATEST(p, q))) + 1.0)"
_NAN = "CAST('NaN' AS DOUBLE)"


def _criteria(t):
    return t.orders.select(
        "o_orderkey",
        F.col("o_totalprice").alias("css"),
        (F.col("o_orderkey") % 3).cast("int").alias("p"),
        (F.col("o_custkey") % 4).cast("int").alias("q"),
        (F.col("o_custkey") % 2).cast("int").alias("k"),
        (F.col("o_orderkey") % 90 + 2).alias("n"),
    )


@query(
    "loglik",
    f"SELECT o_orderkey, CASE WHEN n > GREATEST(p, q) THEN ROUND({_LL}, 6) ELSE {_NAN} END AS loglik FROM ({CRITERIA})",
)
def _(t):
    return _criteria(t).select("o_orderkey", F.round(C.loglik("css", "p", "q", "n"), 6).alias("loglik"))


@query(
    "aic",
    f"""SELECT o_orderkey, CASE WHEN n > GREATEST(p, q) THEN ROUND(-2.0 * ({_LL}) + 2.0 * (p + q + k + 1), 6) ELSE {_NAN} END AS aic
        FROM ({CRITERIA})""",
)
def _(t):
    return _criteria(t).select("o_orderkey", F.round(C.aic("css", "p", "q", "k", "n"), 6).alias("aic"))


@query(
    "aicc",
    f"""SELECT o_orderkey, CASE WHEN n <= GREATEST(p, q) THEN {_NAN}
               WHEN n - (p + q + k + 1) - 1 = 0 THEN CAST('Infinity' AS DOUBLE)
               ELSE ROUND(-2.0 * ({_LL}) + 2.0 * (p + q + k + 1)
                 + 2.0 * (p + q + k + 1) * (p + q + k + 2) / (n - (p + q + k + 1) - 1.0), 6) END AS aicc FROM ({CRITERIA})""",
)
def _(t):
    return _criteria(t).select("o_orderkey", F.round(C.aicc("css", "p", "q", "k", "n"), 6).alias("aicc"))


@query("param_count", f"SELECT o_orderkey, p + q + k AS m FROM ({CRITERIA})")
def _(t):
    return _criteria(t).select("o_orderkey", C.param_count("p", "q", "k").alias("m"))


# -- losses and states --------------------------------------------------------


@query("css_loss", fold_sql(USERS, [0.5], [0.3], final=LOSS))
def _(t):
    """Loss of a fixed ARMA(1,1) on the events of every user."""
    return rounded(S.css_loss(pack(users(t), ["k"]), [0.5], [0.3]))


@query("css_loss_d1", fold_sql(USERS, [0.2, 0.1], [0.3, -0.4], 0.5, 1, final=LOSS))
def _(t):
    return rounded(S.css_loss(pack(users(t), ["k"]), [0.2, 0.1], [0.3, -0.4], 0.5, 1))


@query("css_loss_ar", fold_sql(USERS, [0.5, 0.25], [], 3.0, final=LOSS))
def _(t):
    return rounded(S.css_loss(pack(users(t), ["k"]), [0.5, 0.25], [], 3.0))


@query("css_loss_sql", fold_sql(USERS, [0.25, 0.5], [0.3, 0.5], skip=1, final=LOSS))
def _(t):
    """Variant that counts one row earlier, missing lags as 0."""
    return rounded(S.css_loss(pack(users(t), ["k"]), [0.25, 0.5], [0.3, 0.5], warmup="early"))


@query(
    "residuals",
    fold_sql(DAILY, [0.5], [0.3, 0.2], final="SELECT k, i AS pos, ROUND(e1, 6) AS e FROM f WHERE i >= 2"),
)
def _(t):
    packed = pack(daily(t), ["k"])
    return rounded(S.residuals(packed, S.one_model(packed, [0.5], [0.3, 0.2])), 6)


@query(
    "win_running_css",
    fold_sql(DAILY, [0.5], [0.3], final="SELECT k, i AS pos, ROUND(css, 4) AS css FROM f WHERE i >= 0"),
)
def _(t):
    """Loss after every row."""
    packed = pack(daily(t), ["k"])
    return rounded(S.running_css(packed, S.one_model(packed, [0.5], [0.3])))


_STATE = """SELECT f.k, CAST(f.i + 1 AS BIGINT) AS t, ROUND(f.css, 4) AS css, ROUND(f.e1, 6) AS e1, ROUND(f.e2, 6) AS e2,
                   ROUND(a.y, 6) AS y1, ROUND(b.y, 6) AS y2
            FROM f JOIN (SELECT k, MAX(i) AS i FROM f GROUP BY k) m ON m.k = f.k AND m.i = f.i
            JOIN l a ON a.k = f.k AND a.i = f.i JOIN l b ON b.k = f.k AND b.i = f.i - 1"""


def _state_columns(df):
    s = F.col("state")
    return df.select(
        "k",
        s["t"].alias("t"),
        F.round(s["css"], 4).alias("css"),
        F.round(s["e_lags"][0], 6).alias("e1"),
        F.round(s["e_lags"][1], 6).alias("e2"),
        F.round(s["y_lags"][0], 6).alias("y1"),
        F.round(s["y_lags"][1], 6).alias("y2"),
    )


@query("css_incremental", fold_sql(USERS, [0.4, 0.1], [0.3, 0.2], 1.0, final=_STATE))
def _(t):
    return _state_columns(S.css_full_table(pack(users(t), ["k"]), [0.4, 0.1], [0.3, 0.2], 1.0))


@query("css_full_table", fold_sql(USERS, [0.4, 0.1], [0.3, 0.2], 0.0, 1, final=_STATE))
def _(t):
    return _state_columns(S.css_full_table(pack(users(t), ["k"]), [0.4, 0.1], [0.3, 0.2], 0.0, 1))


@query("advance_states", fold_sql(USERS, [0.4, 0.1], [0.3, 0.2], 0.0, 1, final=_STATE))
def _(t):
    """History up to a date folded first, the later rows folded into the stored states."""
    cutoff = F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    rows = users(t)
    old = pack(rows.where(F.col("ts") < cutoff), ["k"])
    models = S.one_model(old, [0.4, 0.1], [0.3, 0.2], 0.0, 1)
    stored = models.join(S.fold_states(old, models, []), "k")
    return _state_columns(S.fold_states(pack(rows.where(F.col("ts") >= cutoff), ["k"]), stored, []))


@query(
    "state_transition_telescoping",
    fold_sql(
        USERS.replace("- 1 AS i", "- 1 AS i"),
        [0.4],
        [0.3],
        skip=0,
        final="SELECT k, ROUND(ARG_MAX(css, i), 4) AS css FROM f GROUP BY k",
    ).replace(diffs_sql(0), "w AS (SELECT k, i, y - COALESCE(LAG(y) OVER (PARTITION BY k ORDER BY i), 0.0) AS y FROM u)"),
)
def _(t):
    """Variant that differences from a zero level and counts every row."""
    return rounded(S.css_loss(pack(users(t), ["k"]), [0.4], [0.3], 0.0, 1, warmup="none"))


# derivatives of the residuals run along with them: each is driven by what its parameter multiplies
@query(
    "css_gradient",
    f"""WITH RECURSIVE {USERS}, w AS (SELECT k, i, y, LAG(y) OVER (PARTITION BY k ORDER BY i) AS y1 FROM u),
        f AS (SELECT DISTINCT k, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS e, CAST(0 AS DOUBLE) AS dp, CAST(0 AS DOUBLE) AS dt,
                     CAST(0 AS DOUBLE) AS dc, CAST(0 AS DOUBLE) AS css, CAST(0 AS DOUBLE) AS gp, CAST(0 AS DOUBLE) AS gt, CAST(0 AS DOUBLE) AS gc FROM w
              UNION ALL
              SELECT k, i, n, p, t, c, css + n * n, gp + 2 * n * p, gt + 2 * n * t, gc + 2 * n * c FROM (
                SELECT f.k, w.i, w.y - 2.0 - 0.5 * w.y1 - 0.3 * f.e AS n, -w.y1 - 0.3 * f.dp AS p, -f.e - 0.3 * f.dt AS t,
                       -1.0 - 0.3 * f.dc AS c, f.css, f.gp, f.gt, f.gc
                FROM f JOIN w ON w.k = f.k AND w.i = f.i + 1))
        SELECT k, ROUND(ARG_MAX(css, i), 3) AS css, ROUND(ARG_MAX(gp, i), 2) AS d_phi, ROUND(ARG_MAX(gt, i), 2) AS d_theta, ROUND(ARG_MAX(gc, i), 2) AS d_c
        FROM f GROUP BY k""",
)
def _(t):
    """Loss and gradient of a fixed ARMA(1,1) with constant for every user."""
    packed = pack(users(t), ["k"])
    points = packed.frame.select("k").select(
        "k",
        F.lit(1).alias("p"),
        F.lit(0).alias("d"),
        F.lit(1).alias("q"),
        F.lit(True).alias("constant"),
        F.array(F.lit(0.5), F.lit(0.3), F.lit(2.0)).alias("x"),
    )
    out = S.loss_and_gradient(packed, points, [])
    return out.select("k", F.round("css", 3).alias("css"), *[F.round(F.col("grad")[i], 2).alias(n) for i, n in enumerate(["d_phi", "d_theta", "d_c"])])


# -- simplex ------------------------------------------------------------------

_MODEL = "SELECT CAST(p_partkey AS BIGINT) AS k, p_size / 50.0 - 0.5 AS a, p_retailprice / 2000.0 - 0.6 AS b FROM part"


@query(
    "simplex_vertices",
    f"""WITH m AS (SELECT *, SQRT(a * a + b * b) AS norm FROM ({_MODEL})),
             s AS (SELECT *, CASE WHEN norm > 0.05 THEN 1.0 - 0.05 / norm ELSE 0.5 END AS f FROM m)
        SELECT k, 1 AS vertex_id, ROUND(a + CASE WHEN a >= 0 THEN 0.05 ELSE -0.05 END, 9) AS phi1, ROUND(b, 9) AS theta1 FROM s
        UNION ALL SELECT k, 2, ROUND(a, 9), ROUND(b + CASE WHEN b >= 0 THEN 0.05 ELSE -0.05 END, 9) FROM s
        UNION ALL SELECT k, 3, ROUND(a * f, 9), ROUND(b * f, 9) FROM s""",
)
def _(t):
    models = t.part.select(
        F.col("p_partkey").alias("k"),
        F.array(F.col("p_size") / 50.0 - 0.5).alias("phi"),
        F.array(F.col("p_retailprice") / 2000.0 - 0.6).alias("theta"),
    )
    out = X.simplex_vertices(models)
    return out.select(
        "k", "vertex_id", F.round(F.col("phi")[0], 9).alias("phi1"), F.round(F.col("theta")[0], 9).alias("theta1")
    )


def _breach_sql():
    """Centre and vertices of ARMA(1,1) at (0.4, 0.3): three folds, then the rule."""
    norm = (0.4**2 + 0.3**2) ** 0.5
    f = 1.0 - 0.05 / norm
    parts = [(0, 0.4, 0.3), (1, 0.45, 0.3), (2, 0.4, 0.35), (3, 0.4 * f, 0.3 * f)]
    folds = ", ".join(
        f"v{i} AS ({fold_sql(USERS, [a], [b], final='SELECT k, ARG_MAX(css, i) AS css FROM f GROUP BY k')})"
        for i, a, b in parts
    )
    return f"""WITH {folds}
        SELECT v0.k, ROUND(v0.css, 4) AS centre_css, ROUND(LEAST(v1.css, v2.css, v3.css), 4) AS best_vertex_css,
               LEAST(v1.css, v2.css, v3.css) < v0.css AS breached
        FROM v0 JOIN v1 ON v1.k = v0.k JOIN v2 ON v2.k = v0.k JOIN v3 ON v3.k = v0.k"""


@query("breach_check", _breach_sql())
def _(t):
    packed = pack(users(t), ["k"])
    states = X.initial_states(packed, S.one_model(packed, [0.4], [0.3]))
    return rounded(X.breach_check(states, ["k"]))


# -- fits ---------------------------------------------------------------------


@query(
    "arima_fit_ar",
    f"""WITH {USERS}, l AS (SELECT k, y, LAG(y) OVER (PARTITION BY k ORDER BY i) AS x FROM u)
        SELECT k, COUNT(*) AS n, ROUND(REGR_SLOPE(y, x), 6) AS phi1, ROUND(REGR_INTERCEPT(y, x), 6) AS c
        FROM l WHERE x IS NOT NULL GROUP BY k""",
)
def _(t):
    out = Fit.arima_fit_ar(users(t), ["k"], 1)
    return out.select("k", "n", F.round(F.col("phi")[0], 6).alias("phi1"), F.round("c", 6).alias("c"))


@query(
    "yule_walker",
    f"""WITH {USERS}, r AS (SELECT k, i, y - AVG(y) OVER (PARTITION BY k) AS r FROM u),
        l AS (SELECT k, r, LAG(r, 1) OVER o AS r1, LAG(r, 2) OVER o AS r2 FROM r WINDOW o AS (PARTITION BY k ORDER BY i)),
        g AS (SELECT k, SUM(r * r) AS g0, SUM(r * r1) AS g1, SUM(r * r2) AS g2 FROM l GROUP BY k)
        SELECT k, ROUND((g1 * g0 - g1 * g2) / (g0 * g0 - g1 * g1), 6) AS phi1,
               ROUND((g2 * g0 - g1 * g1) / (g0 * g0 - g1 * g1), 6) AS phi2 FROM g""",
)
def _(t):
    out = Fit.yule_walker(St.autocovariance(users(t), ["k"], 2), ["k"], 2)
    return out.select("k", *[F.round(F.col("phi")[i], 6).alias(f"phi{i + 1}") for i in range(2)])


# theta = gamma_1 / gamma_0 of the residuals of an AR(1), whose coefficient is gamma_1 / gamma_0 of the series
@query(
    "ma_initial_guess",
    f"""WITH {USERS}, r AS (SELECT k, i, y, y - AVG(y) OVER (PARTITION BY k) AS m FROM u),
        l AS (SELECT k, i, y, m, LAG(m) OVER o AS m1, LAG(y) OVER o AS y1 FROM r WINDOW o AS (PARTITION BY k ORDER BY i)),
        a AS (SELECT k, SUM(m * m1) / SUM(m * m) AS phi FROM l GROUP BY k),
        e AS (SELECT l.k, i, y - phi * COALESCE(y1, 0.0) AS e FROM l JOIN a ON a.k = l.k),
        c AS (SELECT k, i, e - AVG(e) OVER (PARTITION BY k) AS c FROM e),
        d AS (SELECT k, c, LAG(c) OVER (PARTITION BY k ORDER BY i) AS c1 FROM c)
        SELECT k, ROUND(SUM(c * c1) / SUM(c * c), 6) AS theta1 FROM d GROUP BY k""",
)
def _(t):
    out = Fit.ma_initial_guess(users(t), ["k"], 1, 1)
    return out.select("k", F.round(F.col("theta")[0], 6).alias("theta1"))


# Parameters that every fit has to come up to: phi, theta, and the constant that keeps the mean.
GRID = [(a, b) for a in (-0.6, -0.2, 0.2, 0.6) for b in (-0.8, -0.4, 0.0, 0.4, 0.8)]


def grid_sql(source: str, d: int, final: str) -> str:
    """Recursive losses of an ARMA(1,1) at every point of the grid: f(k, a, b, i, e, css)."""
    points = ", ".join(f"({a}, {b})" for a, b in GRID)
    return f"""WITH RECURSIVE {source}, {diffs_sql(d)},
      g(a, b) AS (VALUES {points}), m AS (SELECT k, AVG(y) AS mean FROM w GROUP BY k),
      l AS (SELECT w.k, i, a, b, y - mean * (1 - a) - a * LAG(y) OVER (PARTITION BY w.k, a, b ORDER BY i) AS z
            FROM w JOIN m ON m.k = w.k CROSS JOIN g),
      f AS (SELECT DISTINCT k, a, b, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS e, CAST(0 AS DOUBLE) AS css FROM l
            UNION ALL
            SELECT k, a, b, i, e, css + e * e FROM (
              SELECT f.k, f.a, f.b, l.i, f.css, l.z - f.b * f.e AS e FROM f JOIN l ON l.k = f.k AND l.a = f.a AND l.b = f.b AND l.i = f.i + 1)),
      s AS (SELECT k, a, b, ARG_MAX(css, i) AS css FROM f GROUP BY k, a, b)
      {final}"""


LEAST = "SELECT k, 1 AS p, {d} AS d, 1 AS q, ROUND(MIN(css), 4) AS grid_css, TRUE AS at_or_under, TRUE AS same_loss, TRUE AS converged FROM s GROUP BY k"


def _against_grid(rows, fits, d: int):
    """Fits beside the least loss of the grid: whether they come up to it, and whether their loss is that of their parameters."""
    fits = cut(fits)  # read twice below; the search is run once
    packed = pack(rows, ["k"])
    mean = packed.frame.select("k", "vals")
    for _ in range(d):
        mean = mean.withColumn("vals", F.transform(F.sequence(F.lit(1), F.size("vals") - 1), lambda i: F.get("vals", i) - F.get("vals", i - 1)))
    mean = mean.select("k", (F.aggregate("vals", F.lit(0.0), lambda s, x: s + x) / F.size("vals")).alias("mean"))
    points = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in GRID])).alias("g")
    grid = mean.select("k", "mean", points)
    models = grid.select(
        "k", F.concat_ws("/", "g.a", "g.b").alias("point"), F.array("g.a").alias("phi"), F.array("g.b").alias("theta"),
        (F.col("mean") * (1 - F.col("g.a"))).alias("c"), F.lit(d).alias("d"),
    )
    least = S.css_losses(packed, models, ["point"]).groupBy("k").agg(F.min("css").alias("grid_css"))
    again = S.css_losses(packed, fits.select("k", "phi", "theta", "c", "d")).withColumnRenamed("css", "again")
    return fits.join(least, "k").join(again, "k").select(
        "k", "p", "d", "q", F.round("grid_css", 4).alias("grid_css"), (F.col("css") <= F.col("grid_css") * (1 + 1e-9)).alias("at_or_under"),
        (F.abs(F.col("again") - F.col("css")) <= 1e-6 * F.col("css")).alias("same_loss"), "converged",
    )


@query("arima_fit", grid_sql(USERS, 0, LEAST.format(d=0)))
def _(t):
    """ARMA(1,1) of every user, none above the best point of a fixed grid."""
    return _against_grid(users(t), Fit.arima_fit(users(t), ["k"], (1, 0, 1)), 0)


@query("arima_fit_differenced", grid_sql(DAILY, 1, LEAST.format(d=1)))
def _(t):
    return _against_grid(daily(t), Fit.arima_fit(daily(t), ["k"], (1, 1, 1)), 1)


@query("arima_fit_nelder_mead", grid_sql(USERS, 0, LEAST.format(d=0)))
def _(t):
    """The same by the simplex search."""
    return _against_grid(users(t), Fit.arima_fit(users(t), ["k"], (1, 0, 1), method="Nelder-Mead"), 0)


# criterion of the constant alone, the first order that every search tries
_MEAN_AICC = "-2.0 * (-0.5 * n * (LN(2 * PI()) + LN(css / n) + 1.0)) + 4.0 + 12.0 / (n - 3.0)"


@query(
    "autoarima_fit",
    f"""WITH {DAILY}, x AS (SELECT k, COUNT(*) AS n, SUM(y * y) - SUM(y) * SUM(y) / COUNT(*) AS css FROM u GROUP BY k)
        SELECT k, ROUND({_MEAN_AICC}, 4) AS mean_aicc, TRUE AS at_or_under, TRUE AS same_loss, TRUE AS ended FROM x""",
)
def _(t):
    """Order search for every daily series; a series that needs no difference comes up to its mean as a model."""
    rows = daily(t)
    packed, plan = Fit.prepare_search(rows, ["k"])
    tried = Fit.autoarima_search(packed, plan)
    best = Fit.best_candidate(tried, ["k"])
    plain = pack(rows, ["k"])
    of_mean = Fit.fit_candidates(plain, Fit.same_order(plain, (0, 0, 0), True)).join(plan.select("k", "n", "use_log"), "k")
    of_mean = Fit.with_aicc(of_mean).select("k", F.col("aicc").alias("mean_aicc"))
    again = S.css_losses(packed, best.select("k", "phi", "theta", "c", "d")).withColumnRenamed("css", "again")
    of_first = tried.where("round = 0 AND p = 0 AND q = 0").groupBy("k").agg(F.min("aicc").alias("first"))
    ended = tried.where("css < double('inf')").groupBy("k").agg(F.min("converged").alias("ended"))
    out = best.join(of_mean, "k").join(again, "k").join(of_first, "k").join(ended, "k")
    return out.select(
        "k", F.round("mean_aicc", 4).alias("mean_aicc"), (F.col("aicc") <= F.col("first")).alias("at_or_under"),
        (F.abs(F.col("again") - F.col("css")) <= 1e-6 * F.col("css")).alias("same_loss"), "ended",
    )


@query(
    "best_candidate",
    """SELECT k, p, q, aicc FROM (SELECT CAST(l_suppkey AS BIGINT) AS k, l_linenumber AS p, CAST(l_quantity AS INTEGER) AS q,
         l_extendedprice AS aicc, ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_linenumber, l_quantity) AS rn
         FROM lineitem) WHERE rn = 1""",
)
def _(t):
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("k"),
        F.col("l_linenumber").alias("p"),
        F.col("l_quantity").cast("int").alias("q"),
        F.lit(True).alias("constant"),
        F.col("l_extendedprice").alias("aicc"),
    )
    return Fit.best_candidate(rows, ["k"]).select("k", "p", "q", "aicc")


# -- forecasts ----------------------------------------------------------------


def forecast_sql(d: int, horizon: int) -> str:
    """Fixed (2,d,2) parameters: state fold, then a second recursion over the horizon."""
    fold = fold_sql(USERS, [0.4, 0.1], [0.3, 0.2], 1.0, d, final="")
    level = "w0" if d == 0 else "w0 + x1"
    return f"""{fold}, z AS (SELECT f.k, f.e1, f.e2, a.y AS y1, b.y AS y2, x.y AS x1, x.ts
             FROM f JOIN (SELECT k, MAX(i) AS i FROM f GROUP BY k) m ON m.k = f.k AND m.i = f.i
             JOIN l a ON a.k = f.k AND a.i = f.i JOIN l b ON b.k = f.k AND b.i = f.i - 1
             JOIN u x ON x.k = f.k AND x.i = f.i + {d}),
           h AS (SELECT k, 0 AS step, e1, e2, y1, y2, x1, ts FROM z
                 UNION ALL
                 SELECT k, step + 1, 0.0, e1, w0, y1, {level}, ts FROM
                   (SELECT *, 1.0 + 0.4 * y1 + 0.1 * y2 + 0.3 * e1 + 0.2 * e2 AS w0 FROM h WHERE step < {horizon}))
           SELECT k, step, ROUND(x1, 6) AS forecast_value, CAST(ts + step * INTERVAL 1 DAY AS TIMESTAMP) AS forecast_date
           FROM h WHERE step > 0"""


def _fixed(packed, d):
    return S.one_model(packed, [0.4, 0.1], [0.3, 0.2], 1.0, d)


@query("arima_forecast", forecast_sql(0, 5))
def _(t):
    """Forecast of every user from given parameters and the newest rows."""
    return _run_forecast(t, 0)


@query("arima_run_forecast", forecast_sql(1, 5))
def _(t):
    return _run_forecast(t, 1)


def _run_forecast(t, d):
    packed = pack(users(t), ["k"])
    models = _fixed(packed, d)
    fits = models.join(S.fold_states(packed, models, []), "k").withColumn("residuals", F.col("state.e_lags"))
    out = Fc.arima_run_forecast(users(t), fits.drop("state"), ["k"], 5)
    return rounded(out, 6)


@query("forecast_from_state", forecast_sql(1, 5))
def _(t):
    """The same forecast from the stored state alone."""
    packed = pack(users(t), ["k"])
    models = _fixed(packed, 1)
    ends = packed.frame.groupBy("k").agg(F.max("last_ts").alias("last_ts"))
    states = models.join(S.fold_states(packed, models, []), "k").join(ends, "k")
    return rounded(Fc.forecast_from_state(states, ["k"], 5), 6)


@query(
    "arima_train_and_forecast",
    f"""WITH RECURSIVE {DAILY}, l AS (SELECT k, y, LAG(y) OVER (PARTITION BY k ORDER BY i) AS x FROM u),
        m AS (SELECT k, REGR_SLOPE(y, x) AS phi, REGR_INTERCEPT(y, x) AS a FROM l WHERE x IS NOT NULL GROUP BY k),
        h AS (SELECT u.k, 0 AS step, ARG_MAX(y, i) AS f, MAX(ts) AS ts, ANY_VALUE(phi) AS phi, ANY_VALUE(a) AS a FROM u JOIN m ON m.k = u.k GROUP BY u.k
              UNION ALL SELECT k, step + 1, a + phi * f, ts, phi, a FROM h WHERE step < 4)
        SELECT k, step, CAST(ts + step * INTERVAL 1 DAY AS TIMESTAMP) AS forecast_date, ROUND(f, 6) AS forecast_value,
               CASE WHEN ABS(phi) >= 1 THEN 'AR coefficients outside (-1, 1)' END AS warning FROM h WHERE step > 0""",
)
def _(t):
    """An AR(1) with constant, whose fit has a closed form."""
    out = Fc.arima_train_and_forecast(daily(t), ["k"], (1, 0, 0), 4)
    return out.select("k", "step", "forecast_date", F.round("forecast_value", 6).alias("forecast_value"), "warning")


@query("arima_train_and_forecast_differenced")
def _(t):
    return Fc.arima_train_and_forecast(daily(t), ["k"], (1, 1, 1), 4)


@query("autoarima_train_and_forecast")
def _(t):
    return Fc.autoarima_train_and_forecast(daily(t), ["k"], 4)
