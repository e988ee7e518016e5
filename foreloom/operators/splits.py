"""Best splits of all nodes of a tree level, found in one query."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreloom.operators.joingraph import CAT, LCAT, NUM
from foreloom.plans.ordered import running_sums

NULL_SPLIT = "NULL"
GROUP = ["tree", "node", "rel", "feat"]


def feature_items(rel: int, features: dict[str, tuple[int, str]]) -> Column:
    """Array of the feature values of a row; numbers go to ``num``, categories to ``cat``."""
    items = []
    for name, (number, kind) in features.items():
        numeric = kind == NUM
        items.append(
            F.struct(
                F.lit(rel).alias("rel"),
                F.lit(number).alias("feat"),
                F.lit(kind).alias("kind"),
                (F.col(name).cast("double") if numeric else F.lit(None).cast("double")).alias("num"),
                (F.lit(None).cast("string") if numeric else F.col(name).cast("string")).alias("cat"),
            )
        )
    return F.array(*items)


def long_features(relations: Sequence[tuple[DataFrame, int, dict[str, tuple[int, str]]]]) -> DataFrame:
    """Sums of s and c per (tree, node, relation, feature, value).

    The feature values of all relations go through one shuffle, and are added
    up per task before it.
    """
    parts = []
    for rows, rel, features in relations:
        items = feature_items(rel, features)
        # a single feature needs no array of its row
        item = F.explode(items) if len(features) > 1 else items[0]
        parts.append(rows.select("tree", "node", item.alias("f"), "s", "c"))
    every = reduce(DataFrame.unionAll, parts)
    fields = [F.col(f"f.{n}").alias(n) for n in ("rel", "feat", "kind", "num", "cat")]
    return every.groupBy("tree", "node", *fields).agg(F.sum("s").alias("s"), F.sum("c").alias("c"))


def score(s: Column, c: Column, total_s: Column, total_c: Column) -> Column:
    """s^2/c + (S-s)^2/(C-c), only where both sides have rows."""
    inside = (c > 0) & (c < total_c)
    other_s, other_c = total_s - s, total_c - c
    return F.when(inside, F.try_divide(s * s, c) + F.try_divide(other_s * other_s, other_c))


def scored_splits(values: DataFrame, totals: DataFrame, long_groups: bool = False) -> DataFrame:
    """Every candidate split with its score.

    ``values`` comes from ``long_features``; ``totals`` has tree, node, total_s
    and total_c.  Numbers are cut after each value, low-cardinality categories
    after each prefix in the order of their mean, other categories are taken one
    by one, and missing values of any feature against the rest.
    """
    present = F.when(F.col("kind") == NUM, F.col("num").isNotNull()).otherwise(F.col("cat").isNotNull())
    place = F.when(F.col("kind") == NUM, F.col("num")).when(F.col("kind") == LCAT, F.col("s") / F.col("c"))
    marked = values.select(
        *GROUP,
        F.when(present, F.col("kind")).otherwise(NULL_SPLIT).alias("kind"),
        "num",
        "cat",
        place.alias("place"),
        "s",
        "c",
    )
    # rows taken one by one get a place of their own instead of a running sum
    ranked = F.col("kind").isin(NUM, LCAT)
    if long_groups:
        sums = running_sums(marked, [*GROUP, "kind"], ["place", "cat"], {"rs": "s", "rc": "c"})
    else:
        alone = F.when(~ranked, F.col("cat"))  # a window of its own, so that a feature of many values spreads
        w = Window.partitionBy(*GROUP, "kind", alone).orderBy("place", "cat").rowsBetween(Window.unboundedPreceding, 0)
        sums = marked.select("*", F.sum("s").over(w).alias("rs"), F.sum("c").over(w).alias("rc"))
    joined = sums.join(F.broadcast(totals), ["tree", "node"])
    left_s = F.when(ranked, F.col("rs")).otherwise(F.col("s"))
    left_c = F.when(ranked, F.col("rc")).otherwise(F.col("c"))
    scored = joined.select(
        *GROUP,
        "kind",
        "num",
        "cat",
        "place",
        left_s.alias("ls"),
        left_c.alias("lc"),
        score(left_s, left_c, F.col("total_s"), F.col("total_c")).alias("score"),
    )
    return scored.where(F.col("score").isNotNull())


def best_splits(scored: DataFrame) -> DataFrame:
    """The best split of every node; ties go to the first relation, feature and value."""
    chosen = F.struct("rel", "feat", "kind", "num", "cat", "place", "ls", "lc", "score")
    rank = F.struct(-F.col("score"), "rel", "feat", "kind", "num", "cat")
    return scored.groupBy("tree", "node").agg(F.min_by(chosen, rank).alias("b")).select("tree", "node", "b.*")


def left_categories(values: DataFrame, chosen: DataFrame) -> DataFrame:
    """The exact set of categories left of each chosen prefix split: tree, node, cat."""
    picked = chosen.select(*GROUP, F.col("place").alias("edge"), F.col("cat").alias("edge_cat"))
    mean = F.col("s") / F.col("c")
    rows = values.where(F.col("cat").isNotNull()).join(F.broadcast(picked), GROUP)
    inside = (mean < F.col("edge")) | ((mean == F.col("edge")) & (F.col("cat") <= F.col("edge_cat")))
    return rows.where(inside).select("tree", "node", "cat")
