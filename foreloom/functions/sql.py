"""The array functions for SQL users, as SQL functions that Spark inlines into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

# One residual, computed once: the lambda that receives it as ``r`` extends the sums and the newest residuals.
_RESIDUAL = """(vals[t - 1] - c
  - aggregate(sequence(1, greatest(p, 1)), CAST(0 AS DOUBLE), (a, j) -> a + CASE WHEN j <= p THEN phi[j - 1] * vals[t - 1 - j] ELSE 0 END)
  - aggregate(sequence(1, greatest(q, 1)), CAST(0 AS DOUBLE), (a, j) -> a + CASE WHEN j <= size(acc.e) THEN theta[j - 1] * acc.e[j - 1] ELSE 0 END))"""

_CSS = f"""aggregate(
  sequence(1, size(vals)),
  named_struct('s', CAST(0 AS DOUBLE), 'e', CAST(array() AS ARRAY<DOUBLE>)),
  (acc, t) -> CASE WHEN t <= greatest(p, q) THEN acc ELSE transform(array({_RESIDUAL}), r -> named_struct(
    's', acc.s + CASE WHEN isnan(r) OR abs(r) = double('Infinity') THEN 0 ELSE r * r END,
    'e', slice(array(r) || acc.e, 1, q)))[0] END,
  acc -> acc.s)"""

# weighted sum of the newest values, as far as both arrays go
_DOT = "aggregate(zip_with({a}, {b}, (x, y) -> coalesce(x * y, 0D)), CAST(0 AS DOUBLE), (s, x) -> s + x)"

_FORECAST = f"""aggregate(
  sequence(1, horizon),
  named_struct('y', slice(newest, 1, size(phi)), 'e', errors, 'x', slice(levels, 1, d), 'out', CAST(array() AS ARRAY<DOUBLE>)),
  (acc, i) -> transform(
    array(c + {_DOT.format(a="phi", b="acc.y")} + {_DOT.format(a="theta", b="acc.e")}),
    w -> transform(
      array(w + CASE d WHEN 0 THEN 0D WHEN 1 THEN acc.x[0] ELSE 2 * acc.x[0] - acc.x[1] END),
      level -> named_struct(
        'y', slice(array(w) || acc.y, 1, size(phi)), 'e', slice(array(0D) || acc.e, 1, size(theta)),
        'x', slice(array(level) || acc.x, 1, d), 'out', acc.out || array(level)))[0])[0],
  acc -> acc.out)"""

_STATE = "state STRUCT<t: BIGINT, p: INT, q: INT, y_lags: ARRAY<DOUBLE>, e_lags: ARRAY<DOUBLE>, css: DOUBLE, d: INT, n_diff: INT, diff_buf: ARRAY<DOUBLE>>"

FUNCTIONS = {
    "log10p1": "(x DOUBLE) RETURNS DOUBLE RETURN log10(x + 1)",
    "inv_log10p1": """(x DOUBLE) RETURNS DOUBLE RETURN
        CASE WHEN x IS NULL THEN NULL WHEN abs(x) <= 308 THEN power(10, x) - 1 ELSE double('Infinity') END""",
    "reverse_array": "(a ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN coalesce(reverse(a), CAST(array() AS ARRAY<DOUBLE>))",
    "array_norm": "(a ARRAY<DOUBLE>) RETURNS DOUBLE RETURN sqrt(aggregate(a, CAST(0 AS DOUBLE), (s, x) -> s + x * x))",
    "arima_difference": """(vals ARRAY<DOUBLE>, d INT) RETURNS ARRAY<DOUBLE> RETURN
        CASE WHEN d <= 0 THEN vals ELSE aggregate(sequence(1, d), vals,
          (a, i) -> zip_with(slice(a, 2, greatest(size(a) - 1, 0)), slice(a, 1, greatest(size(a) - 1, 0)), (x, y) -> x - y)) END""",
    "arima_integrate": """(diffs ARRAY<DOUBLE>, d INT, initial ARRAY<DOUBLE>) RETURNS ARRAY<DOUBLE> RETURN
        CASE WHEN d <= 0 THEN diffs
             WHEN size(initial) <> d THEN CAST(raise_error('a series needs as many first levels as it was differenced') AS ARRAY<DOUBLE>)
             ELSE aggregate(diffs, initial, (a, w) -> a || array(w
               + CASE WHEN d = 1 THEN element_at(a, -1) ELSE 2 * element_at(a, -1) - element_at(a, -2) END)) END""",
    "css_loss": f"""(vals ARRAY<DOUBLE>, phi ARRAY<DOUBLE>, theta ARRAY<DOUBLE>, p INT, q INT, c DOUBLE DEFAULT 0) RETURNS DOUBLE RETURN
        {_CSS}""",
    "arima_forecast": f"""(newest ARRAY<DOUBLE>, errors ARRAY<DOUBLE>, phi ARRAY<DOUBLE>, theta ARRAY<DOUBLE>, c DOUBLE, levels ARRAY<DOUBLE>, d INT, horizon INT)
        RETURNS ARRAY<DOUBLE> RETURN
        CASE WHEN horizon < 1 THEN CAST(raise_error('horizon must be positive') AS ARRAY<DOUBLE>)
             WHEN size(levels) < d THEN CAST(raise_error('forecast: the state holds fewer levels than its differences need') AS ARRAY<DOUBLE>)
             ELSE {_FORECAST} END""",
    "kpss": """(vals ARRAY<DOUBLE>, lags INT) RETURNS DOUBLE RETURN
        transform(array(transform(array(aggregate(vals, CAST(0 AS DOUBLE), (s, x) -> s + x) / size(vals)), m -> transform(vals, x -> x - m))[0]), e ->
          try_divide(
            aggregate(e, named_struct('run', CAST(0 AS DOUBLE), 'eta', CAST(0 AS DOUBLE)),
              (a, x) -> named_struct('run', a.run + x, 'eta', a.eta + (a.run + x) * (a.run + x)), a -> a.eta),
            size(e) * (aggregate(e, CAST(0 AS DOUBLE), (s, x) -> s + x * x)
              + 2 * aggregate(sequence(1, greatest(lags, 1)), CAST(0 AS DOUBLE), (s, k) -> s + CASE WHEN k > lags THEN 0D ELSE
                  (1 - k / (lags + 1D)) * aggregate(zip_with(slice(e, k + 1, greatest(size(e) - k, 0)), slice(e, 1, greatest(size(e) - k, 0)), (x, y) -> x * y),
                    CAST(0 AS DOUBLE), (a, x) -> a + x) END))))[0]""",
    "param_count": "(p INT, q INT, constant BOOLEAN) RETURNS INT RETURN p + q + CAST(constant AS INT)",
    "aicc": """(css DOUBLE, p INT, q INT, k INT, n INT) RETURNS DOUBLE RETURN
        CASE WHEN n <= greatest(p, q) THEN double('NaN')
             ELSE (n - greatest(p, q)) * (ln(2 * pi()) + ln(css / (n - greatest(p, q))) + 1)
               + 2.0D * (p + q + k + 1) + try_divide(2.0D * (p + q + k + 1) * (p + q + k + 2), n - (p + q + k + 1) - 1) END""",
    "kpss_critical": """(p_value DOUBLE) RETURNS DOUBLE RETURN
        CASE p_value WHEN 0.1D THEN 0.347D WHEN 0.05D THEN 0.463D WHEN 0.025D THEN 0.574D WHEN 0.01D THEN 0.739D
             ELSE CAST(raise_error('no critical value is known for this level') AS DOUBLE) END""",
    "forecast_dates": """(last TIMESTAMP_NTZ, horizon INT, step INTERVAL DAY TO SECOND) RETURNS TABLE (i INT, forecast_date TIMESTAMP_NTZ)
        RETURN SELECT i, last + step * i FROM (SELECT explode(sequence(1, horizon)) AS i)""",
    "run_forecast": f"""(last TIMESTAMP_NTZ, phi ARRAY<DOUBLE>, theta ARRAY<DOUBLE>, c DOUBLE, {_STATE}, horizon INT, step INTERVAL DAY TO SECOND)
        RETURNS TABLE (i INT, forecast_date TIMESTAMP_NTZ, forecast_value DOUBLE)
        RETURN SELECT n + 1, last + step * (n + 1), v FROM (SELECT posexplode(f) AS (n, v) FROM (SELECT
          arima_forecast(state.y_lags, state.e_lags, phi, theta, c, reverse(slice(state.diff_buf, 1, state.n_diff)), state.d, horizon) AS f))""",
}


def register(spark: SparkSession) -> None:
    """Create the temporary functions in the session; none of them leaves the JVM."""
    for name, text in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{text}")
