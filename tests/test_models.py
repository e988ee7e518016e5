"""Recorded values and properties of losses, fits, forecasts and states."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from foreloom.functions import sql as SQL
from foreloom.operators import css as C
from foreloom.operators import fit as Fit
from foreloom.operators import forecast as Fc
from foreloom.operators import kernel as K
from foreloom.operators import relational as R
from foreloom.operators import search as S
from foreloom.operators import simplex as X
from foreloom.operators import stats as St
from foreloom.plans.packed import pack
from foreloom.sources.files import generate_series_table
from foreloom.sources.registry import Conflict, Registry, Snapshot
from foreloom.streaming import incremental as I

BASIC = [10.0, 10.5, 10.8, 11.2, 11.5, 11.7, 11.9]


@pytest.fixture(scope="module")
def basic(spark):
    start = dt.datetime(2023, 1, 1)
    data = [("TestSeries", start + dt.timedelta(days=i), v) for i, v in enumerate(BASIC)]
    return spark.createDataFrame(data, "k string, ts timestamp_ntz, value double")


@pytest.mark.parametrize(
    "phi, theta, c, d, expected, tolerance",
    [
        ([0.5], [], 0.0, 0, 201.5075, 1e-3),
        ([], [0.3], 0.0, 0, 492.2989186, 1e-3),
        ([0.5], [0.3], 0.0, 0, 130.1938, 1e-3),
        ([0.5, 0.5], [0.3], 0.0, 0, 0.706344, 1e-3),
        ([0.5, 0.25], [0.3, 0.5], 0.0, 0, 23.0322, 1e-3),
        ([-0.107714174, 0.847949993], [2.0, -2.0], 3.464544387, 0, 0.000986208, 1e-6),
        ([0.099934682, 0.674069236], [2.0, -2.0], 0.0, 1, 0.001469628, 1e-6),
        ([0.450980392, 0.480392157], [2.0, -2.0], 0.0, 2, 0.00245098, 1e-6),
    ],
)
def test_recorded_losses(spark, basic, phi, theta, c, d, expected, tolerance):
    packed = pack(basic, ["k"])
    assert C.css_loss(packed, phi, theta, c, d).first()["css"] == pytest.approx(expected, abs=tolerance)
    state = C.css_full_table(packed, phi, theta, c, d).first()["state"]
    assert state["css"] == pytest.approx(expected, abs=tolerance)


def test_recorded_losses_of_sql_function(spark):
    SQL.register(spark)
    vals = "array(" + ",".join(f"{v}D" for v in BASIC) + ")"
    got = spark.sql(f"SELECT css_loss({vals}, array(0.5D), array(0.3D), 1, 1) AS v").first()["v"]
    assert got == pytest.approx(130.1938, abs=1e-3)


@pytest.mark.parametrize(
    "order, constant, bound",
    [((2, 0, 2), True, 0.000987), ((2, 1, 2), False, 0.00147), ((2, 2, 2), False, 0.00246)],
)
@pytest.mark.parametrize("method", ["L-BFGS", "Nelder-Mead"])
def test_fits_reach_the_recorded_losses(basic, order, constant, bound, method):
    got = Fit.arima_fit(basic, ["k"], order, include_mean=constant, method=method).first()
    assert got["css"] <= bound


def test_searches_end_by_their_rule(spark, folder, basic):
    """Series on which a hundred rounds of steps in all parameters had not ended (losses recorded from them)."""
    users = spark.read.parquet(f"{folder}/events.parquet").selectExpr("user_id AS k", "ts", "value")
    for order, sum_before in (((1, 0, 1), 1_944_238), ((1, 1, 1), 1_820_569), ((2, 0, 2), 1_537_111)):
        fits = Fit.arima_fit(users, ["k"], order).collect()
        assert all(r["converged"] for r in fits) and sum(r["css"] for r in fits) < sum_before
    assert Fit.arima_fit(basic, ["k"], (0, 0, 0)).first()["converged"] is True
    warned = Fc.arima_train_and_forecast(users.where("k = 1"), ["k"], (1, 0, 1), 2).first()
    assert "search not converged" not in (warned["warning"] or "")


def test_bounded_least_squares_against_a_fine_search():
    draw = np.random.default_rng(5)
    for _ in range(60):
        k = int(draw.integers(1, 5))
        r, b = draw.normal(size=(k + 3, k)), 4 * draw.normal(size=k + 3)
        low, high = -draw.random(k), draw.random(k)
        x = S.bounded_least_squares(r, b, low, high)
        assert ((low <= x) & (x <= high)).all()
        slope = -2 * r.T @ (b - r @ x)
        assert (np.where(x <= low, slope >= -1e-8, np.where(x >= high, slope <= 1e-8, np.abs(slope) < 1e-7))).all()


def test_slopes_of_the_projected_loss():
    y = np.cumsum(np.random.default_rng(2).normal(size=50)) * 0.1 + np.random.default_rng(3).normal(size=50)
    batch = K.Batch([(y[:0], y, 0)], 1, 2)
    _, low, high = K.bounds(np.array([y.mean()]), 1, 2, True)
    loss = S.Projected(batch, low, high, True)
    theta = np.array([[0.3, -0.2]])
    g = loss.at(theta)[1][0]
    for j in range(2):
        up, down = theta.copy(), theta.copy()
        up[0, j] += 1e-6
        down[0, j] -= 1e-6
        assert g[j] == pytest.approx((loss.at(up)[0][0] - loss.at(down)[0][0]) / 2e-6, rel=1e-5, abs=1e-6)


def test_unknown_method_and_order(basic):
    with pytest.raises(ValueError):
        Fit.arima_fit(basic, ["k"], (1, 0, 0), method="Newton")
    with pytest.raises(ValueError):
        Fit.arima_fit(basic, ["k"], (11, 0, 0))


def test_recorded_forecast(spark):
    row = spark.range(1).select(
        Fc.forecast_array(
            F.array(F.lit(0.914982910934596), F.lit(0.113555903738228)),
            F.array(F.lit(2.062502180358700), F.lit(0.710978584599870)),
            F.lit(0.0),
            F.array(F.lit(11.9), F.lit(11.7)),
            F.array(F.lit(-0.016511328), F.lit(-0.035082334)),
            F.array().cast("array<double>"),
            F.lit(0),
            4,
        ).alias("f")
    ).first()
    assert row["f"] == pytest.approx([12.15790328, 12.46384978, 12.78481125, 13.11322754], abs=1e-3)


def state_frame(spark, d, levels):
    buf = levels + [0.0] * (d + 1 - len(levels))
    data = [("a", dt.datetime(2023, 1, 7), [0.099934682, 0.674069236], [2.0, -2.0], 0.0,
             (7, 2, 2, [0.2, 0.2], [0.0, 0.0], 0.0, d, len(levels), buf))]
    schema = f"k string, last_ts timestamp_ntz, phi array<double>, theta array<double>, c double, state {C.STATE_TYPE}"
    return spark.createDataFrame(data, schema)


def test_recorded_state_forecast(spark):
    out = Fc.forecast_from_state(state_frame(spark, 1, [11.7, 11.9]), ["k"], 4).orderBy("step").collect()
    expected = [12.0548007836, 12.2050845979, 12.324449609, 12.4376800093]
    assert [r["forecast_value"] for r in out] == pytest.approx(expected, abs=1e-3)
    assert out[0]["forecast_date"] == dt.datetime(2023, 1, 8)


def test_state_without_levels_is_an_error(spark):
    with pytest.raises(Exception, match="fewer levels"):
        Fc.forecast_from_state(state_frame(spark, 1, []), ["k"], 4).collect()


def test_state_forecast_equals_full_forecast(basic):
    fits = Fit.arima_fit(basic, ["k"], (1, 1, 1))
    packed = pack(basic, ["k"])
    full = Fc.arima_run_forecast(basic, fits, ["k"], 6).orderBy("step").collect()
    states = fits.drop("residuals", "css").join(C.fold_states(packed, fits, []), "k").withColumn(
        "last_ts", F.lit(dt.datetime(2023, 1, 7)).cast("timestamp_ntz")
    )
    short = Fc.forecast_from_state(states, ["k"], 6).orderBy("step").collect()
    assert [r["forecast_value"] for r in full] == pytest.approx([r["forecast_value"] for r in short], abs=1e-9)


def serial_residuals(y, phi, theta, c):
    p, q, n0 = len(phi), len(theta), max(len(phi), len(theta))
    e = np.zeros(len(y))
    for t in range(n0, len(y)):
        past = sum(theta[j] * e[t - 1 - j] for j in range(min(t - n0, q)))
        e[t] = y[t] - c - sum(phi[j] * y[t - 1 - j] for j in range(p)) - past
    return e


@pytest.mark.parametrize("theta", [[0.4, 0.3, -0.2], [2.0, -2.0], []])
def test_filter_equals_the_serial_recursion(theta):
    y = np.random.default_rng(3).normal(size=37)
    batch = K.Batch([(y[:0], y, 0)], 2, len(theta))
    got = batch.residuals(np.array([[0.3, 0.2]]), np.array([theta]).reshape(1, -1), np.array([0.1]))[0]
    assert got == pytest.approx(serial_residuals(y, [0.3, 0.2], theta, 0.1), rel=1e-8, abs=1e-9)


def test_gradient_against_finite_differences(spark, short_groups):
    """Over chunks, so that derivatives are carried from chunk to chunk."""
    series = generate_series_table(spark, 90, "ar1_like").withColumn("k", F.lit("a"))
    packed = pack(series, ["k"])
    assert packed.long

    def at(x):
        points = packed.frame.select("k").distinct().select(
            "k", F.lit(1).alias("p"), F.lit(0).alias("d"), F.lit(2).alias("q"), F.lit(True).alias("constant"),
            F.array(*[F.lit(float(v)) for v in x]).alias("x"),
        )
        return C.loss_and_gradient(packed, points, []).first()

    x = np.array([0.4, 0.3, -0.2, 1.0])
    base = at(x)
    for i in range(4):
        up, down = x.copy(), x.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        slope = (at(up)["css"] - at(down)["css"]) / 2e-5
        assert base["grad"][i] == pytest.approx(slope, rel=1e-5, abs=1e-4)


def test_fit_over_chunks_equals_fit_in_one_piece(spark):
    series = generate_series_table(spark, 400, "ar1_like").withColumn("k", F.lit("a"))
    whole = Fit.arima_fit(series, ["k"], (1, 0, 1)).first()
    spark.conf.set("spark.foreloom.packRows", "60")
    spark.conf.set("spark.foreloom.groupRows", "60")
    try:
        parts = Fit.arima_fit(series, ["k"], (1, 0, 1)).first()
    finally:
        spark.conf.unset("spark.foreloom.packRows")
        spark.conf.unset("spark.foreloom.groupRows")
    assert parts["css"] == pytest.approx(whole["css"], rel=1e-6)
    assert parts["residuals"] == pytest.approx(whole["residuals"], abs=1e-3)


def made_series(spark, k, n, seed):
    """phi 0.6, theta 0.5 around 7."""
    noise, y = np.random.default_rng(seed).normal(size=n), []
    for t in range(n):
        y.append(noise[t] + (0.6 * y[-1] + 0.5 * noise[t - 1] if t else 0.0))
    start = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(k, start + dt.timedelta(hours=t), 7.0 + float(v)) for t, v in enumerate(y)], "k string, ts timestamp_ntz, value double")


@pytest.mark.parametrize("method", ["L-BFGS", "Nelder-Mead"])
def test_routes_agree_for_short_and_long_series(spark, method):
    """A series in chunks of twenty rows, and one that stays in one piece."""
    both = made_series(spark, "long", 100, 1).unionByName(made_series(spark, "short", 20, 2))
    want = {r["k"]: r for r in Fit.arima_fit(both, ["k"], (1, 0, 1), method=method).collect()}
    spark.conf.set("spark.foreloom.packRows", "20")
    try:
        got = {r["k"]: r for r in Fit.arima_fit(both, ["k"], (1, 0, 1), method=method).collect()}
    finally:
        spark.conf.unset("spark.foreloom.packRows")
    assert set(got) == set(want) and got["short"]["css"] == pytest.approx(want["short"]["css"], rel=1e-12)
    for k, fit in want.items():
        assert got[k]["converged"] and got[k]["css"] == pytest.approx(fit["css"], rel=1e-7)
        assert got[k]["theta"] == pytest.approx(fit["theta"], abs=1e-4)


def test_fold_of_a_long_line_equals_the_loss(spark):
    """A line of a hundred thousand rows in several chunks."""
    spark.conf.set("spark.foreloom.packRows", "30000")
    try:
        packed = pack(generate_series_table(spark, 100_001, "line").withColumn("k", F.lit(1)), ["k"])
        loss = C.css_loss(packed, [0.9], [0.4]).first()["css"]
        state = C.css_full_table(packed, [0.9], [0.4]).first()["state"]
    finally:
        spark.conf.unset("spark.foreloom.packRows")
    y = np.arange(100_001.0)
    assert loss == pytest.approx(float(np.sum(serial_residuals(y, [0.9], [0.4], 0.0) ** 2)), rel=1e-9)
    assert state["css"] == pytest.approx(loss, rel=1e-12)


def test_search_on_a_drifting_walk_needs_a_difference(spark):
    walk = generate_series_table(spark, 121, "random_walk").withColumn("k", F.lit("a"))
    best = Fit.autoarima_fit(walk, ["k"]).first()
    assert best["d"] > 0
    again = Fit.arima_fit(walk, ["k"], (best["p"], best["d"], best["q"]), include_mean=best["constant"]).first()
    if not best["use_log"]:
        assert again["css"] == pytest.approx(best["css"], rel=1e-3)


def test_search_on_the_decaying_series(spark):
    series = generate_series_table(spark, 101, "ar1_like").withColumn("k", F.lit("a"))
    packed, plan = Fit.prepare_search(series, ["k"])
    tried = Fit.autoarima_search(packed, plan).collect()
    first = {(r["p"], r["q"], r["constant"]) for r in tried if r["round"] == 0}
    assert first == {(0, 0, True), (2, 2, True), (1, 0, True), (0, 1, True), (0, 0, False)}
    best = Fit.autoarima_fit(series, ["k"]).first()
    assert best["css"] <= 350
    assert best["aicc"] == min(r["aicc"] for r in tried)


def test_vertices_of_a_zero_vector(spark):
    df = spark.createDataFrame([("a", [0.0], [])], "k string, phi array<double>, theta array<double>")
    got = {r["vertex_id"]: r["phi"] for r in X.simplex_vertices(df).collect()}
    assert got == {1: [0.05], 2: [0.0]}


def test_kpss_rejects_other_levels():
    with pytest.raises(ValueError):
        St.critical_value(0.2)


def test_life_cycle_and_outlier(spark, basic, tmp_path):
    registry = Registry(spark, str(tmp_path / "registry"))
    with pytest.raises(ValueError):
        registry.create_forecast("prophet", "t", basic, "ts", "value", "k")
    key = ("autoarima", "t", "ts", "value")
    assert registry.run_forecast(*key, 3).count() == 0
    registry.create_forecast("autoarima", "t", basic, "ts", "value", "k")
    assert registry.run_forecast(*key, 3).count() == 3
    before = registry.arima_get_active_id(*key).first()["arima_id"]
    rows = basic.select(F.col("k").alias("series_id"), "ts", "value")
    outlier = spark.createDataFrame(
        [("TestSeries", dt.datetime(2023, 1, 8), 500.0), ("TestSeries", dt.datetime(2023, 1, 2), 1.0)],
        "series_id string, ts timestamp_ntz, value double",
    )
    version = registry.versions()[-1] + 1
    snap = I.process_batch(outlier, registry, version, lambda: rows.unionByName(outlier.limit(1)), *key)
    after = snap.active().first()
    assert after["arima_id"] != before and after["last_ts"] == dt.datetime(2023, 1, 8)
    assert snap.stats.where("is_active").count() == 1 and snap.stats.count() == 2
    # the row that came too late is set aside, the same batch again finds its snapshot
    assert [r["value"] for r in registry.late().collect()] == [1.0]
    assert registry.write(snap, version) == version
    # a batch is known by its name, not by the number that another writer may have taken
    registry.write(snap, None, "stream-0")
    assert registry.holds("stream-0") and not registry.holds("stream-1")
    unseen = rows.withColumn("series_id", F.lit("Unseen"))
    snap = I.process_batch(unseen, registry, None, lambda: rows.unionByName(unseen), *key, "fixed", "stream-1")
    assert {r["series_id"] for r in snap.active().collect()} == {"TestSeries", "Unseen"}
    assert registry.holds("stream-1")
    assert registry.remove_forecast(*key) and not registry.remove_forecast(*key)


def test_registry_writes_what_a_batch_changes(spark, tmp_path):
    """Forty models, batches that touch one: runs stay few and small, and the state is that of all batches."""
    start = dt.datetime(2024, 1, 1)
    rows = [(f"s{k}", start + dt.timedelta(hours=t), float((k * 7 + t * t) % 13)) for k in range(40) for t in range(12)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, value double")
    packed = pack(df.where("ts < timestamp_ntz'2024-01-01 06:00:00'"), ["series_id"])
    models = C.one_model(packed, [0.4], [0.3], 1.0, 0)
    states = X.initial_states(packed, models)
    ids = packed.frame.groupBy("series_id").agg(F.max("last_ts").alias("last_ts")).withColumn(
        "model_id", F.xxhash64(F.lit("autoarima"), F.lit("t"), F.lit("ts"), F.lit("value"), "series_id")
    ).withColumn("arima_id", F.xxhash64("model_id", F.lit(0)))
    joined = states.join(ids, "series_id")
    names = ids.select("model_id", F.lit("autoarima").alias("model_type"), F.lit("t").alias("input_table"), F.lit("ts").alias("date_column"), F.lit("value").alias("value_column"), "series_id")
    stats = joined.where("vertex_id = 0").select("arima_id", "model_id", F.lit(0).alias("version"), "phi", "theta", "d", "c", F.lit(False).alias("use_log"), F.lit(True).alias("is_active"), "last_ts", "state")
    around = joined.where("vertex_id > 0").select("arima_id", "vertex_id", "phi", "theta", "state")
    registry = Registry(spark, str(tmp_path / "log"))
    registry.write(Snapshot(names, stats, around))
    key = ("autoarima", "t", "ts", "value")
    for n, t in enumerate(range(6, 12)):
        late = spark.createDataFrame([("s4", start, -1.0)], df.schema)
        batch = df.where((F.hour("ts") == t) & F.col("series_id").isin("s3", "s4")).unionByName(late)
        I.process_batch(batch, registry, None, lambda: df, *key, "fixed", f"feed-{n}")
        runs = registry._head()[1]["runs"]
        assert runs[0]["rows"] == 40 and sum(r["rows"] for r in runs[1:]) <= 6 and len(runs) <= 3
    assert len(registry.versions()) <= 5 and registry.holds("feed-5") and registry.holds("feed-2") and not registry.holds("feed-6")
    assert registry.late().count() == 6
    got = {r["series_id"]: r for r in registry.read().active().collect()}
    assert len(got) == 40 and got["s3"]["last_ts"] == start + dt.timedelta(hours=11) and got["s5"]["last_ts"] == start + dt.timedelta(hours=5)
    whole = {r["series_id"]: r for r in C.fold_states(pack(df, ["series_id"]), models, []).collect()}
    assert got["s3"]["state"]["css"] == pytest.approx(whole["s3"]["state"]["css"], rel=1e-12)
    assert registry.read().vertices.count() == 40 * 3
    with pytest.raises(Conflict):
        registry._commit(registry.versions()[-1], {"runs": [], "marks": {}, "late": None})
    one = names.where("series_id = 's5'")
    registry.append(Snapshot(*[p.limit(0) for p in (names, stats, around)]), one)
    assert registry.read().models.count() == 39 and registry.read().vertices.count() == 39 * 3
    assert registry.remove_forecast(*key) and registry.read().stats.count() == 0


def test_copies_are_numbered_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "COPIES", 3)
    df = spark.createDataFrame([("a",)] * 8 + [("b",)] * 2 + [(None,)], "k string")
    got = sorted((r["k"] or "", r["nth"]) for r in R.cumcount(df).collect())
    assert got == [("", 1)] + [("a", i) for i in range(1, 9)] + [("b", 1), ("b", 2)]


def test_highest_score_with_ties_and_gaps(spark):
    rows = [("a", 1.0, 2), ("a", 3.0, 5), ("a", 3.0, 4), ("a", None, 0), ("b", None, 1), ("c", float("nan"), 1), ("c", 9.0, 0)]
    got = R.argmax_per_group(spark.createDataFrame(rows, "k string, score double, t int"), ["k"], "score", ["t"])
    assert sorted((r["k"], r["t"]) for r in got.collect()) == [("a", 4), ("c", 1)]


def test_attach_spreads_heavy_keys_only(spark):
    """Keys with most rows, with few, without partner, and none at all, on the route of large lookups."""
    from foreloom.plans.joins import attach

    rows = spark.range(4000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 7 WHEN id % 5 = 0 THEN NULL ELSE id % 300 END AS k")
    lookup = spark.range(250).selectExpr("id AS k", "id * id AS v")
    for limit in ("100", "100000"):
        spark.conf.set("spark.foreloom.groupRows", limit)
        spark.conf.set("spark.foreloom.broadcastRows", "50")
        try:
            for how in ("inner", "left"):
                want = sorted(map(repr, rows.join(lookup, ["k"], how).select("id", "k", "v").collect()))
                assert sorted(map(repr, attach(rows, lookup, ["k"], how).select("id", "k", "v").collect())) == want
        finally:
            spark.conf.unset("spark.foreloom.groupRows")
            spark.conf.unset("spark.foreloom.broadcastRows")
