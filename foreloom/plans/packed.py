"""Series packed into arrays: one row per (series, chunk), each of bounded length."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foreloom.plans.joins import attach
from foreloom.plans.ordered import group_sizes, positions
from foreloom.session import pack_rows


@dataclass(frozen=True)
class Packed:
    """``frame`` has the keys and

    chunk    number of the chunk in its series, from 0
    first    position of the first own value in the series
    halo     the values just before it, oldest first (empty in chunk 0)
    vals     the own values, oldest first
    n_total  length of the series
    last_ts  time of the last own value

    ``tasks`` is the number of tasks that its values are worth, however few bytes they are.
    """

    frame: DataFrame
    keys: list[str]
    long: bool
    tasks: int | None = None

    def persist(self) -> "Packed":
        return replace(self, frame=self.frame.persist())


# Values that one task packs and evaluates, as long as there are tasks enough.
TASK_VALUES = 50_000
# Values of a task on average, however many there are: about 64 MB of times and values.
TASK_LIMIT = 4_000_000


def measured(rows: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(length of the longest series, number of all values), in one pass over the keys."""
    row = group_sizes(rows, keys).agg(F.max("n").alias("longest"), F.sum("n").alias("total")).first()
    return row["longest"] or 0, row["total"] or 0


def task_count(df: DataFrame, total: int) -> int:
    """At least one task per core; the shuffle partitions of the session while tasks stay under ``TASK_LIMIT``, then more."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores)
    return max(min(most, max(cores, -(-total // TASK_VALUES))), -(-total // TASK_LIMIT))


def pack(
    df: DataFrame,
    keys: list[str],
    ts: str = "ts",
    value: str = "value",
    halo: int = 16,
    limit: int | None = None,
) -> Packed:
    """Pack the non-null values of each series in time order.

    Series up to the limit of the session become one row after one shuffle.
    If any series is longer, positions are computed over slices and the series
    are cut into chunks of exactly the limit, each with ``halo`` values of the
    chunk before it.
    """
    rows = df.select(*keys, F.col(ts).alias("ts"), F.col(value).cast("double").alias("value"))
    rows = rows.where(F.col("value").isNotNull())
    limit = limit or pack_rows(df.sparkSession)
    longest, total = measured(rows, keys)
    if longest <= limit:
        ordered = F.array_sort(F.collect_list(F.struct("ts", "value")))
        # an explicit number of partitions: the arrays are few bytes but much work per row
        tasks = task_count(df, total)
        spread = rows.repartition(tasks, *keys) if keys else rows
        whole = spread.groupBy(*keys).agg(ordered.alias("o"))
        frame = whole.select(
            *keys,
            F.lit(0).cast("long").alias("chunk"),
            F.lit(0).cast("long").alias("first"),
            F.array().cast("array<double>").alias("halo"),
            F.col("o.value").alias("vals"),
            F.size("o").cast("long").alias("n_total"),
            F.element_at("o", -1)["ts"].alias("last_ts"),
        )
        return Packed(frame, keys, False, tasks)

    length = max(limit, halo + 1)
    placed = positions(rows, keys, ["ts", "value"], "pos", limit)
    chunk = F.floor(F.col("pos") / length)
    near_end = F.col("pos") % length >= length - halo
    spread = placed.withColumn(
        "chunk", F.explode(F.when(near_end, F.array(chunk, chunk + 1)).otherwise(F.array(chunk)))
    ).withColumn("own", chunk == F.col("chunk"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "value", "own")))
    grouped = spread.repartition(task_count(df, total), *keys, "chunk").groupBy(*keys, "chunk").agg(
        ordered.alias("o"), F.max(F.when(F.col("own"), F.col("ts"))).alias("last_ts")
    )
    own = F.filter("o", lambda x: x["own"])
    before = F.filter("o", lambda x: ~x["own"])
    cut_up = grouped.where(F.exists("o", lambda x: x["own"])).select(
        *keys,
        F.col("chunk").cast("long").alias("chunk"),
        (F.col("chunk") * length).cast("long").alias("first"),
        F.transform(before, lambda x: x["value"]).alias("halo"),
        F.transform(own, lambda x: x["value"]).alias("vals"),
        "last_ts",
    )
    sizes = group_sizes(rows, keys, "n_total").where(F.col("n_total") > 0)
    frame = attach(cut_up, sizes, keys, spread="chunk") if keys else cut_up.withColumn("n_total", F.lit(total))
    return Packed(
        frame.select(*keys, "chunk", "first", "halo", "vals", "n_total", "last_ts"), keys, True
    )
