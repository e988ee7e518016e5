"""Reading and writing tables: CSV relations, star schemas, layouts, append-style tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Schemas of the star-schema CSV files, in file order.
STAR_SCHEMAS = {
    "holidays": "date date, htype string, locale string, locale_name string, description string, transferred boolean",
    "items": "item_nbr int, family string, class string, perishable int",
    "oil": "date date, dcoilwtico decimal(18,6)",
    "stores": "store_nbr int, city string, state string, stype string, cluster int",
    "trans": "date date, store_nbr int, transactions int",
    "sales": "id int, date date, store_nbr int, item_nbr int, unit_sales decimal(18,6), onpromotion boolean",
}
# Columns that the loader adds, empty at first.
STAR_DEFAULTS = {
    "holidays": ("f2", "int"),
    "items": ("f1", "int"),
    "oil": ("f3", "int"),
    "stores": ("f4", "int"),
    "trans": ("f5", "int"),
    "sales": ("target", "double"),
}


def read_csv_relation(spark: SparkSession, path: str, schema: str | None = None, name: str | None = None) -> DataFrame:
    """A CSV file with a header as a relation; without a schema the types are inferred."""
    reader = spark.read.option("header", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if name:
        df.createOrReplaceTempView(name)
    return df


def bulk_load_star(spark: SparkSession, folder: str, out: str | None = None, names: Sequence[str] = tuple(STAR_SCHEMAS)) -> dict[str, DataFrame]:
    """Load the star-schema CSV files, add the empty extra columns, optionally store as Parquet."""
    loaded = {}
    for name in names:
        extra, kind = STAR_DEFAULTS[name]
        df = read_csv_relation(spark, f"{folder}/{name}.csv", STAR_SCHEMAS[name])
        df = df.withColumn(extra, F.lit(None).cast(kind))
        if out:
            df.write.mode("overwrite").parquet(f"{out}/{name}")
            df = spark.read.parquet(f"{out}/{name}")
        loaded[name] = df
    return loaded


def read_long_csv(spark: SparkSession, path: str, index: bool = False) -> DataFrame:
    """``date,data,cols`` files; ``index`` says that date is a number."""
    schema = f"date {'int' if index else 'timestamp_ntz'}, data double, cols string"
    return read_csv_relation(spark, path, schema)


def append_rows(df: DataFrame, path: str) -> None:
    """Add rows to an append-only table; a file stream on the folder sees them."""
    df.write.mode("append").parquet(path)


def insert_ignore(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is neither in the table nor earlier in the batch."""
    fresh = new.dropDuplicates(list(keys))
    return fresh.join(existing.select(*keys), list(keys), "left_anti")


def delete_rows(df: DataFrame, condition: Column) -> DataFrame:
    """The table without the rows that satisfy the condition (a NULL condition keeps a row)."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def truncate(df: DataFrame) -> DataFrame:
    return df.limit(0)


def rewrite(df: DataFrame, root: str) -> str:
    """Store a new snapshot of a table beside the old one and return its path."""
    path = f"{root}/snapshot-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def export_training_join(df: DataFrame, path: str, order: str = "id", fmt: str = "parquet") -> None:
    """Write a joined table in the order of an id: range-partitioned, sorted, one file per range."""
    ordered = df.orderBy(order)
    writer = ordered.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.parquet(path)


def table_layout(
    df: DataFrame,
    path: str,
    time: str,
    sort: Sequence[str],
    files_per_chunk: int = 8,
    chunk: str = "month",
) -> None:
    """Fact layout: one folder per time chunk, zstd files sorted by the join keys.

    Rows of a chunk are spread over ``files_per_chunk`` tasks by a hash of the
    whole sort key, so that neither a busy month nor a hot key fills one task.
    """
    stamped = df.withColumn("chunk", F.date_format(F.date_trunc(chunk, F.col(time)), "yyyy-MM-dd"))
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(files_per_chunk))
    spread = stamped.withColumn("__salt", salt).repartition("chunk", "__salt").drop("__salt")
    local = spread.sortWithinPartitions("chunk", *sort)
    local.write.mode("overwrite").option("compression", "zstd").partitionBy("chunk").parquet(path)


def bucketed(df: DataFrame, table: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Fact table bucketed and sorted on its join key, for joins without a shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)


def benchmark_sink(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def generate_series_table(spark: SparkSession, n: int, kind: str = "uniform", seed: int = 42) -> DataFrame:
    """Synthetic series: i, ts, value; the noise comes from a hash of the row, so it is repeatable."""
    base = spark.range(n).select(F.col("id").alias("i"))
    noise = F.pmod(F.xxhash64(F.lit(seed), "i"), F.lit(1_000_003)).cast("double") / 1_000_003.0
    start = F.lit("2023-01-01 00:00:00").cast("timestamp_ntz")
    stamped = base.withColumn("ts", start + F.expr("INTERVAL 1 MINUTE") * F.col("i"))
    if kind == "line":
        return stamped.withColumn("value", F.col("i").cast("double"))
    if kind == "uniform":
        return stamped.withColumn("value", noise)
    if kind == "ar1_like":
        decay = 10.0 * F.pow(F.lit(0.8), (F.col("i") % 10).cast("double"))
        return stamped.withColumn("value", decay + 0.1 * noise)
    if kind == "random_walk":
        from foreloom.plans.ordered import running_sums

        step = F.when(F.col("i") == 0, F.lit(10.0)).otherwise(0.5 + (noise - 0.5) * 0.1)
        rows = stamped.withColumn("step", step)
        return running_sums(rows, [], ["i"], {"value": "step"}).drop("step")
    raise ValueError(f"unknown kind {kind}")


def generated_series(rows: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str = "ar1_like", seed: int = 42) -> DataFrame:
    """Series of made-up values as long as those of ``rows``: its columns, ``i`` (from 0 in each series) and ``made``.

    The noise is arithmetic on the place, so that it is the same on every run and in every engine.
    """
    from foreloom.plans.ordered import positions

    placed = positions(rows, list(keys), list(order), "i")
    noise = F.pmod(F.col("i") * 7919 + seed, F.lit(1009)).cast("double") / 1009.0
    if kind == "line":
        return placed.withColumn("made", F.col("i").cast("double"))
    if kind == "uniform":
        return placed.withColumn("made", noise)
    if kind == "ar1_like":
        return placed.withColumn("made", 10.0 * F.pow(F.lit(0.8), F.pmod(F.col("i"), F.lit(10)).cast("double")) + 0.1 * noise)
    raise ValueError(f"no series of kind {kind} is made")


def empty_like(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
