"""Groupings of many keys and slices take as many tasks as their rows need, however few partitions a session has."""

from pyspark.sql import functions as F

from foreloom.plans import ordered
from foreloom.suite import Tables, graph


def test_sums_of_splits_are_spread_by_the_size_of_the_input(spark, folder, monkeypatch):
    spark.conf.set("spark.foreloom.groupRows", "500")
    seen, wide = [], graph.cut

    def watched(df):
        seen.append((int(spark.conf.get("spark.sql.shuffle.partitions")), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")))
        return wide(df)

    monkeypatch.setattr(graph, "cut", watched)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        t = Tables(spark, folder)
        graph._scored(t, graph._numeric_star(t))
        rows = t.lineitem.count()
    finally:
        spark.conf.unset("spark.foreloom.groupRows")
    assert len(seen) == 1 and seen[0][0] >= rows / 500 and seen[0][1] == "false"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_slices_are_spread_over_as_many_tasks(spark):
    rows = spark.range(1000).select(F.lit("a").alias("k"), "id", F.lit(1).alias("v"))
    got = ordered.running_sums(rows, ["k"], ["id"], {"s": "v"}, limit=20)
    assert got.rdd.getNumPartitions() >= 50
    assert got.where("s <> id + 1").count() == 0 and got.count() == 1000
