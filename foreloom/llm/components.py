"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreloom.llm.common import discard, park, small


def _large(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node, and no other, to the least of the node and its neighbours."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")).withColumnRenamed("a", "n")
    out = both.join(least, F.col("a") == F.col("n")).where(F.col("b") > F.col("a"))
    return out.select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of these; here ``a`` is the larger end of every link."""
    least = edges.groupBy("a").agg(F.min("b").alias("least")).withColumnRenamed("a", "n")
    moved = edges.join(least, F.col("a") == F.col("n")).where(F.col("b") > F.col("least"))
    out = moved.select(F.col("b").alias("a"), F.col("least").alias("b"))
    return out.unionAll(least.select(F.col("n").alias("a"), F.col("least").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every larger end is linked once, to a node that is nobody's larger end: stars around their least nodes."""
    one, no = F.lit(1), F.lit(0)
    ends = edges.select(F.col("a").alias("node"), one.alias("up"), no.alias("down")).unionAll(
        edges.select("b", no, one)
    )
    open_ = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0")
    return open_.agg(F.count(F.lit(1))).first()[0] == 0


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node that it reaches.

    Each round writes its links to the shared folder, none of them more than the links it got.  It ends when the links
    are stars around their smallest nodes; links that are so from the start take no round.
    """
    edges = park(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _settled(edges):
        large = park(_large(edges), "large")
        nxt = park(_small(large), "small")
        discard(edges, large)
        edges = nxt
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components of ``roots`` (node, component) after more links (a, b): only the components themselves are linked anew."""
    of = lambda end: roots.select(F.col("node").alias(end), F.col("component").alias(f"{end}_in"))
    between = links.join(of("b"), "b", "left").join(of("a"), "a", "left")
    between = between.select(F.coalesce("a_in", "a").alias("a"), F.coalesce("b_in", "b").alias("b"))
    moved = park(components(between), "moved")
    nodes = roots.unionAll(moved.select("node", F.col("node").alias("component"))).distinct()
    moved = small(moved.select(F.col("node").alias("component"), F.col("component").alias("to")))
    return nodes.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
