"""Ranks and running sums within groups of any size, by range partitions instead of one task a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foreloom.llm.common import park, same, small


def prefixes(df: DataFrame, group: list[str], order: list[Column], sums: tuple[str, ...] = ()) -> DataFrame:
    """Add ``rank`` (from 1) and, for each column of ``sums``, ``before_<column>`` (sum over the rows ahead).

    ``order`` must be total.  Rows are range-partitioned by group and order, so a group of any size spreads over
    tasks; the runs of a group inside each partition are added up in a table of one row per run and joined back.
    """
    keys = [F.col(c).asc_nulls_last() for c in group]
    rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    rows = park(rows.withColumn("_at", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_at", 33))
    runs = rows.groupBy(*group, "_part").agg(
        F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_sum_{c}") for c in sums]
    )
    ahead = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(
        *[F.col(c).alias(f"_g_{c}") for c in group],
        F.col("_part").alias("_run"),
        "_low",
        F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"),
        *[F.coalesce(F.sum(f"_sum_{c}").over(ahead), F.lit(0)).alias(f"_ahead_{c}") for c in sums],
    )
    on = F.col("_part") == F.col("_run")
    for c in group:
        on = on & same(F.col(c), F.col(f"_g_{c}"))
    out = rows.join(small(park(runs, "runs")), on)
    within = W.partitionBy("_part", *group).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    out = out.withColumn("rank", F.col("_at") - F.col("_low") + F.col("_ahead") + 1)
    for c in sums:
        out = out.withColumn(f"before_{c}", F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_ahead_{c}"))
    return out.select(*df.columns, "rank", *[f"before_{c}" for c in sums])


def numbered(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with ``_row``, unique and in the order of ids: the id itself where it can serve.

    Otherwise (nulls, ids used twice, ids that are no integers) the rows are ranked and written once with their ranks.
    """
    if docs.schema[doc_id].dataType.simpleString() in ("bigint", "int"):
        ids = docs.select(F.col(doc_id).cast("long").alias("_row")).groupBy("_row").agg(F.count(F.lit(1)).alias("n"))
        if ids.where("n > 1 OR _row IS NULL").isEmpty():
            return docs.withColumn("_row", F.col(doc_id).cast("long"))
    return prefixes(docs, [], [F.col(doc_id).asc_nulls_last()]).withColumnRenamed("rank", "_row")
