"""Frequent keys of the fact rows are counted once for all levels and trees."""

from foreloom.operators import trees
from foreloom.operators.trees import GradientBoosting
from foreloom.plans.joins import heavy_keys
from foreloom.suite import Tables, graph


def test_heavy_keys_are_counted_once_for_all_trees(spark, folder, short_groups, monkeypatch):
    asked = []

    def counted(rows, on):
        asked.append(tuple(on))
        return heavy_keys(rows, on)

    monkeypatch.setattr(trees, "heavy_keys", counted)
    g = graph._lone(Tables(spark, folder), X=["p_size"])
    model = GradientBoosting(num_leaves=2, max_depth=1, learning_rate=0.5, n_estimators=3).fit(g, skip_check=True)
    assert len(model.trees) == 3 and all(t.chosen for t in model.trees)
    assert asked == [("l_partkey",)]


def test_heavy_keys(spark, short_groups):
    rows = spark.range(300).selectExpr("id % 100 % 7 % 3 AS k", "id")
    few = spark.range(300).selectExpr("id AS k")
    spark.conf.set("spark.foreloom.groupRows", "100")
    want = {r["k"] for r in rows.groupBy("k").count().where("count > 100").collect()}
    assert want and {r["k"] for r in heavy_keys(rows, ["k"]).collect()} == want
    assert heavy_keys(few, ["k"]) is None
