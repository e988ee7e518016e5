"""Trees over a join graph against a plain tree on the joined table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foreloom.operators.joingraph import JoinGraph, JoinGraphError
from foreloom.operators.trees import DecisionTree, GradientBoosting, RandomForest


def graph(spark, folder):
    def t(name):
        return spark.read.parquet(f"{folder}/{name}.parquet")

    g = JoinGraph()
    g.add_relation("lineitem", t("lineitem"), X=["l_quantity", "l_tax"], y="l_extendedprice")
    g.add_relation("part", t("part"), X=["p_size"])
    g.add_relation("orders", t("orders"), X=["o_totalprice"])
    g.add_relation("customer", t("customer"), X=["c_acctbal"])
    g.add_join("lineitem", "part", ["l_partkey"], ["p_partkey"])
    g.add_join("lineitem", "orders", ["l_orderkey"], ["o_orderkey"])
    g.add_join("orders", "customer", ["o_custkey"], ["c_custkey"])
    return g


FEATURES = ["l_quantity", "l_tax", "p_size", "o_totalprice", "c_acctbal"]


@pytest.fixture(scope="module")
def joined(spark, folder):
    full = graph(spark, folder).full_join()
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", *FEATURES]
    found = {c.split("__")[1]: c for c in full.columns}
    return full.select(*[F.col(found[n]).alias(n) for n in names]).toPandas()


def test_predicates_on_dimensions_limit_training(spark, folder, joined):
    g = graph(spark, folder).annotate("part", F.col("p_size") > 25).annotate("customer", F.col("c_acctbal") > 0)
    kept = joined[(joined.p_size > 25) & (joined.c_acctbal > 0)]
    model = DecisionTree(num_leaves=2, max_depth=1, learning_rate=1.0).fit(g)
    y = kept.l_extendedprice.to_numpy()
    assert model.count == len(kept) < len(joined) and model.constant == pytest.approx(y.mean())
    _, feature, value = best_split(kept, y - y.mean())
    split = model.trees[0].nodes[1].split
    assert (split.feature, split.value) == (feature, value)
    assert model.predict(g).count() == len(kept)


def best_split(x, y):
    best = (0.0, None, None)
    base = y.sum() ** 2 / len(y)
    for f in FEATURES:
        order = np.argsort(x[f].to_numpy(), kind="stable")
        v, r = x[f].to_numpy()[order], y[order]
        s, c = np.cumsum(r), np.arange(1, len(r) + 1)
        cut = np.flatnonzero(v[:-1] != v[1:])
        if not len(cut):
            continue
        score = s[cut] ** 2 / c[cut] + (s[-1] - s[cut]) ** 2 / (len(r) - c[cut]) - base
        i = int(np.argmax(score))
        if score[i] > best[0] + 1e-6:
            best = (score[i], f, v[cut[i]])
    return best


def plain_tree(x, y, leaves, depth):
    """Best-first growth on the joined rows; returns the fitted values."""
    nodes = [(np.arange(len(y)), 0)]
    done = []
    while nodes and len(nodes) + len(done) < leaves:
        scored = [(best_split(x.iloc[i], y[i]) if d < depth else (0.0, None, None), i, d) for i, d in nodes]
        at = max(range(len(scored)), key=lambda k: scored[k][0][0])
        (gain, f, v), rows, d = scored[at]
        if gain <= 0:
            break
        nodes.pop(at)
        left = x[f].to_numpy()[rows] <= v
        nodes += [(rows[left], d + 1), (rows[~left], d + 1)]
    out = np.empty(len(y))
    for rows, _ in nodes + done:
        out[rows] = y[rows].mean()
    return out


KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]


def predicted(model, spark, folder):
    out = model.predict(graph(spark, folder)).select(*KEYS, "prediction").toPandas()
    return out.sort_values(KEYS).reset_index(drop=True)


@pytest.mark.parametrize("leaves, depth", [(4, 3), (5, 4)])
def test_tree_equals_tree_on_the_join(spark, folder, joined, leaves, depth):
    model = DecisionTree(num_leaves=leaves, max_depth=depth).fit(graph(spark, folder))
    y = joined["l_extendedprice"].to_numpy()
    want = joined.assign(want=y.mean() + plain_tree(joined, y - y.mean(), leaves, depth)).sort_values(KEYS)
    got = predicted(model, spark, folder)
    assert got["prediction"].to_numpy() == pytest.approx(want["want"].to_numpy(), rel=1e-8)


def test_boosting_lowers_the_error_and_equals_trees_on_residuals(spark, folder, joined):
    model = GradientBoosting(num_leaves=3, learning_rate=0.5, max_depth=2, n_estimators=2).fit(graph(spark, folder))
    y = joined["l_extendedprice"].to_numpy()
    fit = np.full(len(y), y.mean())
    for _ in range(2):
        fit = fit + 0.5 * plain_tree(joined, y - fit, 3, 2)
    want = joined.assign(want=fit).sort_values(KEYS)
    got = predicted(model, spark, folder)
    assert got["prediction"].to_numpy() == pytest.approx(want["want"].to_numpy(), rel=1e-8)


def test_warm_start_adds_trees_for_new_rows(spark, folder):
    g = graph(spark, folder)
    model = GradientBoosting(3, 0.5, 2, n_estimators=1, incremental_estimators=2).fit(g)
    before = predicted(model, spark, folder)
    model.fit(g, warm_start=True, where=F.col("l_quantity") > 25)
    assert len(model.trees) == 3
    after = predicted(model, spark, folder)
    big = spark.read.parquet(f"{folder}/lineitem.parquet").where("l_quantity > 25").select(*KEYS).toPandas()

    def error(p):
        m = big.merge(p, on=KEYS)
        return ((m["l_extendedprice"] - m["prediction"]) ** 2).sum()

    assert error(after) < error(before)


def test_forest_averages_its_trees(spark, folder):
    model = RandomForest(num_leaves=3, max_depth=2, subsample=0.5, n_estimators=3).fit(graph(spark, folder))
    assert len(model.trees) == 3 and all(t.rate == pytest.approx(1 / 3) for t in model.trees)
    got = predicted(model, spark, folder)
    assert got["prediction"].mean() == pytest.approx(got["l_extendedprice"].mean(), rel=0.05)


@pytest.mark.parametrize("growth", ["depthwise", "levelwise"])
def test_other_growths_split_and_respect_the_limit(spark, folder, growth):
    model = DecisionTree(num_leaves=3, max_depth=3, growth=growth).fit(graph(spark, folder), skip_check=True)
    assert len(model.trees[0].leaves()) == 3


def test_set_and_missing_value_splits(spark):
    rows = [("a", 1.0, None), ("b", 10.0, 1.0), ("c", 1.2, 1.0), ("d", 11.0, 1.0), ("a", 1.0, 2.0)] * 4
    df = spark.createDataFrame(rows, "cat string, y double, x double")
    g = JoinGraph().add_relation("t", df, categorical=["cat"], y="y")
    split = DecisionTree(num_leaves=2, max_depth=1).fit(g).trees[0].nodes[1].split
    assert split.kind == "LCAT" and split.value == ["a", "c"]
    rows = [(5.0, None)] * 5 + [(1.0, 1.0), (1.0, 2.0)] * 5
    df = spark.createDataFrame(rows, "y double, x double")
    model = DecisionTree(num_leaves=2, max_depth=1).fit(JoinGraph().add_relation("t", df, X=["x"], y="y"))
    # "x is missing" and "x is at most its largest value" part the rows in the same way
    assert model.trees[0].nodes[1].split.kind in ("NULL", "NUM")
    assert model.rmse(df).first()["rmse"] == pytest.approx(0.0, abs=1e-9)


def test_reserved_names(spark):
    df = spark.createDataFrame([(float(i), float(i % 2)) for i in range(10)], "s double, c double")
    model = DecisionTree(num_leaves=2, max_depth=1).fit(JoinGraph().add_relation("t", df, X=["c"], y="s"))
    assert model.rmse(df).first()["rmse"] < 3.0


def test_graph_errors(spark, folder):
    g = graph(spark, folder)
    with pytest.raises(JoinGraphError):
        g.add_relation("part", g.relations["part"].frame)
    with pytest.raises(JoinGraphError):
        g.add_relation("x", g.relations["part"].frame, X=["nothing"])
    with pytest.raises(JoinGraphError, match="cyclic"):
        graph(spark, folder).add_join("part", "customer", ["p_partkey"], ["c_custkey"]).check_shape()
    with pytest.raises(JoinGraphError, match="disjoint"):
        graph(spark, folder).add_relation("nation", spark.range(3).toDF("n")).check_shape()
    missing = graph(spark, folder)
    missing.relations["part"].frame = missing.relations["part"].frame.where("p_size > 10")
    with pytest.raises(JoinGraphError, match="missing"):
        missing.validate()


def test_messages_do_not_join_the_fact_table_with_its_dimensions(spark, folder):
    """The plan of a level has no product, and the fact rows are reduced before any join."""
    from foreloom.operators import messages as M

    g = graph(spark, folder)
    plan = M.calibrate(g, M.lift(g))["customer"]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert plan.index("Join") < plan.index("HashAggregate")




def set_graph(spark, n):
    """Facts with a text feature of ``n`` values, and a dimension with another."""
    facts = spark.range(4 * n).select(
        "id", (F.col("id") % n).cast("string").alias("code"), (F.col("id") % 97).alias("key"),
        (F.pmod(F.col("id") * 7919, F.lit(1009)) + F.when(F.col("id") % n % 3 == 0, 500.0).otherwise(0.0)).alias("y"),
    )
    dim = spark.range(97).select(F.col("id").alias("key"), F.concat(F.lit("d"), F.pmod(F.col("id") * 31, F.lit(53))).alias("kind"))
    g = JoinGraph().add_relation("facts", facts, categorical=["code"], y="y").add_relation("dim", dim, categorical=["kind"])
    return g.add_join("facts", "dim", ["key"], ["key"])


def test_long_sets_predict_as_listed_ones(spark, monkeypatch):
    from foreloom.operators import trees as T

    def predictions(listed):
        monkeypatch.setattr(T, "MAX_LISTED", listed)
        g = set_graph(spark, 60)
        model = GradientBoosting(num_leaves=4, max_depth=2, learning_rate=0.5, n_estimators=2).fit(g)
        splits = [s for t in model.trees for s in t.splits()]
        warm = GradientBoosting(num_leaves=2, max_depth=1, n_estimators=1).fit(g)
        warm.fit(g, warm_start=True)
        joined = g.full_join()
        names = {c.split("__")[1]: c for c in joined.columns}
        flat = joined.select(*[F.col(names[c]).alias(c) for c in ("code", "kind", "y")])
        of = lambda m: sorted((r["id"], round(r["prediction"], 6)) for r in m.predict(g).collect())
        return splits, of(model), of(warm), model.rmse(flat).first()["rmse"], model

    listed, tables = predictions(1000), predictions(3)
    assert all(s.table is None for s in listed[0]) and any(s.table is not None for s in tables[0])
    assert listed[1:3] == tables[1:3] and listed[3] == pytest.approx(tables[3], rel=1e-12)
    assert "IN (" in listed[4].to_sql()
    with pytest.raises(ValueError, match="too long"):
        tables[4].to_sql()


def test_fifty_thousand_categories(spark):
    g = set_graph(spark, 50_000)
    model = DecisionTree(num_leaves=2, max_depth=1).fit(g)
    split = model.trees[0].nodes[1].split
    assert split.feature == "code" and split.value is None and split.table.count() > 20_000
    rows = model.predict(g)
    means = rows.groupBy("prediction").agg(F.avg("y").alias("m"), F.count("*").alias("n")).collect()
    assert len(means) == 2 and all(r["prediction"] == pytest.approx(r["m"], rel=1e-9) for r in means)
