"""The query layer: select-project-join-aggregate, set operations and reshapes."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foreloom.functions.expressions import every
from foreloom.functions.scalars import micros
from foreloom.plans.ordered import peer_running_sums
from foreloom.session import cut

# Copies of one row that are numbered at a time.
COPIES = 65_536


@dataclass
class Query:
    """One block: FROM and JOIN, WHERE, GROUP BY with aggregates, ORDER BY, LIMIT, sample.

    ``joins`` lists (frame, keys, how); ``columns`` are the projected columns,
    or the aggregates when ``group_by`` is not None (an empty list is a global
    aggregate).
    """

    source: DataFrame
    columns: Sequence[Column | str] = ("*",)
    joins: Sequence[tuple[DataFrame, object, str]] = ()
    where: Sequence[Column] = ()
    group_by: Sequence[str] | None = None
    order_by: Sequence[Column | str] = ()
    limit: int | None = None
    sample: float | None = None
    seed: int = 0
    distinct: bool = False
    settings: dict = field(default_factory=dict)

    def frame(self) -> DataFrame:
        df = self.source
        if self.sample is not None:
            df = df.sample(fraction=self.sample, seed=self.seed)
        for other, keys, how in self.joins:
            df = df.join(other, keys, how)
        if self.where:
            df = df.where(every(self.where))
        if self.group_by is None:
            df = df.select(*self.columns)
        else:
            df = df.groupBy(*self.group_by).agg(*self.columns)
        if self.distinct:
            df = df.distinct()
        if self.order_by:
            df = df.orderBy(*self.order_by)
        return df.limit(self.limit) if self.limit is not None else df


def materialize(df: DataFrame, mode: str, name: str | None = None):
    """Run a block as a table, a view, inline, or fetch its rows.

    ``fetch`` hands rows to the driver and is meant for results of a few rows.
    """
    if mode == "table":
        if name is None:
            return cut(df)
        df.write.mode("overwrite").saveAsTable(name)
        return df.sparkSession.table(name)
    if mode == "view":
        df.createOrReplaceTempView(name)
        return df.sparkSession.table(name)
    if mode == "inline":
        return df
    if mode == "fetch":
        return df.collect()
    raise ValueError(f"unknown mode {mode}")


def recursive_steps(start: DataFrame, steps: DataFrame, keys: Sequence[str], at: str, values: dict[str, str]) -> DataFrame:
    """Rows of a recursion along ordinals: keys, ``at`` and ``values``, written once.

    ``start`` has the first rows.  Each turn joins the rows of the last one with the row of ``steps`` that has their keys
    and the next ordinal; ``values`` are SQL expressions over ``f`` (the row so far) and ``s`` (the step).  A turn takes a
    join of all groups, so that the number of turns is the length of the longest group: for long series the chunked
    evaluations of ``foreloom.operators.css`` are the better way.
    """
    spark = steps.sparkSession
    mark = uuid.uuid4().hex
    names = [*keys, at, *values]
    start.select(*names).createOrReplaceTempView(f"start_{mark}")
    steps.createOrReplaceTempView(f"steps_{mark}")
    longest = steps.agg(F.max(at) - F.min(at)).first()[0] or 0
    limits = {"spark.sql.cteRecursionLevelLimit": str(longest + 3), "spark.sql.cteRecursionRowLimit": "-1"}
    before = {k: spark.conf.get(k) for k in limits}
    same = " AND ".join(f"s.`{k}` = f.`{k}`" for k in keys) or "TRUE"
    moved = ", ".join([*[f"s.`{k}`" for k in keys], f"s.`{at}`", *[f"{v} AS `{n}`" for n, v in values.items()]])
    try:
        for k, v in limits.items():
            spark.conf.set(k, v)
        return cut(
            spark.sql(
                f"""WITH RECURSIVE f({", ".join(f"`{n}`" for n in names)}) AS (
                      SELECT * FROM start_{mark}
                      UNION ALL SELECT {moved} FROM f JOIN steps_{mark} s ON {same} AND s.`{at}` = f.`{at}` + 1)
                    SELECT * FROM f"""
            )
        )
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.catalog.dropTempView(f"start_{mark}")
        spark.catalog.dropTempView(f"steps_{mark}")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b.select(*a.columns))


def intersect_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersectAll(b.select(*a.columns))


def difference_set(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b.select(*a.columns))


def difference_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b.select(*a.columns))


SET_OPERATIONS = {
    "UNION": union,
    "UNION ALL": union_all,
    "INTERSECT": intersect,
    "INTERSECT ALL": intersect_all,
    "EXCEPT": difference_set,
    "EXCEPT ALL": difference_all,
}


def set_query(operation: str, a: DataFrame, b: DataFrame) -> DataFrame:
    if operation not in SET_OPERATIONS:
        raise ValueError(f"unsupported set operation {operation}")
    return SET_OPERATIONS[operation](a, b)


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], key: str = "key", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), key, value)


def concat(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other)
    return out


def cumsum_by_value(df: DataFrame, value: str, sums: dict[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Running sums ordered by an attribute; equal values share one total."""
    return peer_running_sums(df, list(keys), [value], sums)


def cumcount(df: DataFrame, name: str = "nth") -> DataFrame:
    """Which occurrence of its full row each row is.

    Copies are counted first and then numbered in blocks of ``COPIES``; the blocks
    of a row with more copies than that are dealt to many tasks.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__copies"))
    last = F.floor((F.col("__copies") - 1) / COPIES)
    few = counted.where(F.col("__copies") <= COPIES).withColumn("__block", F.lit(0).cast("long"))
    many = counted.where(F.col("__copies") > COPIES)
    many = many.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    blocks = few.unionByName(many.repartition(*df.columns, "__block"))
    start = F.col("__block") * COPIES
    numbers = F.explode(F.sequence(start + 1, F.least(F.col("__copies"), start + COPIES)))
    return blocks.select(*df.columns, numbers.alias(name))


def argmax_per_group(df: DataFrame, groups: Sequence[str], score: str, ties: Sequence[str]) -> DataFrame:
    """The row with the highest score of each group; ties go to the smallest other columns."""
    rest = [c for c in df.columns if c not in groups]
    rank = F.struct(F.col(score), *[F.col(c) for c in ties])
    if not ties:
        return df.groupBy(*groups).agg(F.max_by(F.struct(*rest), rank).alias("b")).select(*groups, "b.*")
    # a score that is not a number counts as the highest, as in the order of Spark
    rank = F.struct(~F.isnan(score), -F.col(score), *[F.col(c) for c in ties])
    picked = df.where(F.col(score).isNotNull()).groupBy(*groups).agg(F.min_by(F.struct(*rest), rank).alias("b"))
    return picked.select(*groups, "b.*")


def latest_rows(df: DataFrame, keys: Sequence[str], ts: str, k: int) -> DataFrame:
    """The newest k rows of each group.

    Spark keeps at most k rows per group before the shuffle (group limit on the
    window), so a long group does not travel as a whole.
    """
    spec = Window.partitionBy(*keys) if keys else Window.partitionBy()
    if not keys:
        return df.orderBy(F.col(ts).desc()).limit(k)
    ranked = df.withColumn("__rn", F.row_number().over(spec.orderBy(F.col(ts).desc())))
    return ranked.where(F.col("__rn") <= k).drop("__rn")


def last_step(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """Seconds between the last two timestamps of each group."""
    newest = latest_rows(df.select(*keys, ts), keys, ts, 2)
    at = micros(ts)
    gap = F.try_divide((F.max(at) - F.min(at)).cast("double"), F.lit(1e6))
    grouped = newest.groupBy(*keys) if keys else newest.groupBy()
    return grouped.agg(F.max(ts).alias("last_ts"), F.when(F.count(ts) > 1, gap).alias("step_seconds"))
