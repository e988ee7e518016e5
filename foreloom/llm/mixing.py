"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foreloom.llm.common import discard, park, same, small, word_count
from foreloom.llm.prefix import prefixes

WEIGHTS = (5, 2, 1)


def offset(source: Column, seed: str) -> Column:
    """The one random offset of a source, in [0, 1): the first 32 bits of an md5 of seed and name."""
    name = F.coalesce(F.concat(F.lit(":"), source), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), name)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Target words of each source from (source, source_size).

    Sources by name, null last, weigh ``weights`` in turn and share ``share`` times all words; a target stops at
    ``cap`` times its source's size and the excess goes to the others by weight.  The level at which this comes to
    rest is found from running sums in order of size by weight, so the sources may be many.
    """
    named = prefixes(sizes, [], [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") - 1).cast("int") % len(weights) + 1)
    named = park(named.withColumn("weight", weight.cast("long")).drop("rank"), "weights")
    ratio = F.col("source_size") / F.col("weight")
    lined = prefixes(named, [], [ratio.asc(), F.col("source").asc_nulls_last()], ("source_size", "weight"))
    total = named.agg(F.sum("source_size").alias("_words"), F.sum("weight").alias("_weights"))
    level = (F.lit(share) * F.col("_words") - F.lit(cap) * F.col("before_source_size")) / (F.col("_weights") - F.col("before_weight"))
    # the first source, by size over weight, that the level leaves under its cap; none: all stop at their caps
    open_ = lined.crossJoin(F.broadcast(total)).withColumn("_level", level)  # one row on the right
    open_ = open_.where(F.col("_level") * F.col("weight") <= F.lit(cap) * F.col("source_size"))
    found = open_.agg(F.min_by("_level", "rank").alias("_level"))
    full = F.lit(cap) * F.col("source_size")
    return named.crossJoin(F.broadcast(found)).select(
        "source", "source_size", F.coalesce(F.least(full, F.col("_level") * F.col("weight")), full).alias("target")
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights=WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """Copies that the mix takes of each document: (doc_id, source, size, source_size, target, copies, taken).

    Every document of a source has the same expected copies, target over source size.  Their running sum in order of
    (size descending, id) plus the source's random offset crosses ``copies`` integers at the document.  The order by
    size keeps the words taken within the largest document of the target.

    Null or empty text: size 0, copied like the others, nothing taken.  Null source: a source of its own, last in
    order.  Null ids and repeated rows: each row counts; which of equal rows is copied does not matter.  An empty
    table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    rows = park(rows, "words")  # a range partitioning reads its input twice; this way the texts are read once
    ranked = prefixes(rows, ["source"], [F.col("size").desc(), F.col("doc_id").asc_nulls_last()])
    ranked = park(ranked, "sizes")
    sizes = park(ranked.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    aims = park(targets(sizes, weights, share, cap), "targets")
    discard(sizes)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    aims = aims.select(F.col("source").alias("_source"), "source_size", "target", expected.alias("_each"), offset(F.col("source"), seed).alias("_offset"))
    out = ranked.join(small(aims), same(F.col("source"), F.col("_source")))
    here = F.floor(F.col("rank") * F.col("_each") + F.col("_offset"))
    ahead = F.floor((F.col("rank") - 1) * F.col("_each") + F.col("_offset"))
    out = out.withColumn("copies", (here - ahead).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, taken: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The mixed corpus itself: every document as often as the mix takes it (``taken`` has distinct ids)."""
    k = taken.where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("copies").alias("_copies"))
    out = docs.join(k, same(F.col(doc_id), F.col("_id")))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_id", "_copies", "_copy")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight FROM s),
l AS (
  SELECT *, row_number() OVER o AS place, sum(source_size) OVER o - source_size AS words_ahead, sum(weight) OVER o - weight AS weight_ahead,
         sum(source_size) OVER () AS words, sum(weight) OVER () AS weights
  FROM w WINDOW o AS (ORDER BY source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
v AS (SELECT *, (1.5 * CAST(words AS DOUBLE) - 2.0 * CAST(words_ahead AS DOUBLE)) / CAST(weights - weight_ahead AS DOUBLE) AS level FROM l),
f AS (SELECT arg_min(level, place) AS level FROM v WHERE level * weight <= 2.0 * CAST(source_size AS DOUBLE)),
t AS (
  SELECT w.source, source_size, coalesce(least(2.0 * CAST(source_size AS DOUBLE), f.level * weight), 2.0 * CAST(source_size AS DOUBLE)) AS target,
         CAST('0x' || substr(md5('mix' || coalesce(':' || w.source, '')), 1, 8) AS BIGINT) / 4294967296.0 AS off
  FROM w CROSS JOIN f),
r AS (SELECT d.*, row_number() OVER (PARTITION BY source ORDER BY size DESC, doc_id) AS k FROM d),
e AS (
  SELECT r.doc_id, r.source, r.size, t.source_size, t.target, r.k, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS expected, CAST(t.off AS DOUBLE) AS off
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(floor(k * expected + off) - floor((k - 1) * expected + off) AS BIGINT) AS copies FROM e)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM c
"""
