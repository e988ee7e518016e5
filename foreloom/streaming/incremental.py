"""Models kept up to date by a stream: advance states, test for a breach, refit what breached."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foreloom.functions.scalars import log10p1
from foreloom.operators import simplex as X
from foreloom.operators.css import fold_states
from foreloom.plans.joins import attach
from foreloom.plans.packed import pack
from foreloom.session import cut
from foreloom.sources.registry import Registry, Snapshot, changes, model_id, train

# naive: refit with every batch; geometric: refit on a breach; fixed: never refit
POLICIES = ("naive", "geometric", "fixed")
# Fixed value: relative margin of the second kind of model.
MARGINS = {"autoarima": 0.0, "pyautoarima": 1e-12}
# Columns of a parameter set that a fold hands through, so that its states need no join to become rows of the registry.
OF_A_SET = ("arima_id", "model_id", "version", "phi", "theta", "d", "c", "use_log", "is_active")


def split_late(batch: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to fold, late rows): a state depends on order, so a row must be newer than the last one."""
    known = active.select("series_id", "last_ts", "use_log")
    marked = cut(attach(batch.dropDuplicates(["series_id", "ts"]), known, ["series_id"]))
    newer = F.col("ts") > F.col("last_ts")
    return marked.where(newer).drop("last_ts"), marked.where(~newer).drop("last_ts")


def advance_states(batch: DataFrame, active: DataFrame, vertices: DataFrame) -> DataFrame:
    """Centre and vertices after the new rows: the columns of ``OF_A_SET``, vertex_id, state, new_last_ts.

    ``batch`` has series_id, ts, value and use_log.  Rows are folded in time order; the
    history is not read.
    """
    shared = [c for c in OF_A_SET if c not in ("phi", "theta")]
    centre = active.select("series_id", *OF_A_SET, F.lit(X.CENTRE).alias("vertex_id"), "state")
    around = vertices.join(active.select("series_id", *shared), "arima_id").select(*centre.columns)
    points = centre.unionByName(around)
    logged = F.when(F.col("use_log"), log10p1("value")).otherwise(F.col("value"))
    packed = pack(batch.withColumn("value", logged), ["series_id"])
    carry = [c for c in OF_A_SET if c != "arima_id"]
    states = fold_states(packed, points, ["arima_id", "vertex_id"], carry, True)
    return states.withColumn("new_last_ts", F.col("last_ts").cast("timestamp_ntz")).drop("last_ts")


def breached(states: DataFrame, policy: str, margin: float = 0.0) -> DataFrame:
    """series_id and arima_id of the models to refit."""
    checked = X.breach_check(states, ["series_id", "arima_id"], margin)
    if policy == "naive":
        return checked.select("series_id", "arima_id")
    if policy == "fixed":
        return checked.select("series_id", "arima_id").limit(0)
    return checked.where("breached").select("series_id", "arima_id")


def process_batch(
    batch: DataFrame,
    registry: Registry,
    version: int | None,
    history: Callable[[], DataFrame],
    model_type: str,
    table: str,
    date_column: str,
    value_column: str,
    policy: str = "geometric",
    mark: str | None = None,
) -> Snapshot:
    """Fold one micro-batch into the newest state and commit what it changes.

    Only the models of the batch are read, and only their rows are written.  ``history`` returns series_id, ts, value
    with the batch included; it is read for breached series, and for series without a model, which get their first
    one whatever the policy.  Rows too late for a state are kept beside it (``Registry.late``).  ``mark`` names the
    batch in the state.
    """
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy}")
    named = model_id(F.lit(model_type), F.lit(table), F.lit(date_column), F.lit(value_column), F.col("series_id"))
    touched = cut(batch.select("series_id").distinct().withColumn("model_id", named))
    old = registry.read(series=touched)
    active = cut(old.active())
    around = cut(old.vertices)
    fresh, late = split_late(batch, active)
    states = cut(advance_states(fresh, active, around))
    stale = cut(breached(states, policy, MARGINS[model_type]))

    after = states.withColumnRenamed("new_last_ts", "last_ts")
    stats = after.where(F.col("vertex_id") == X.CENTRE).select(*old.stats.columns)
    vertices = after.where(F.col("vertex_id") != X.CENTRE).select(*around.columns, "model_id")
    models = active.select(*old.models.columns).join(stats.select("model_id"), "model_id", "left_semi")
    new = Snapshot(models, stats, vertices)
    unseen = touched.select("series_id").join(active.select("series_id"), "series_id", "left_anti")
    wanted = cut(stale.select("series_id").unionByName(unseen))
    if not wanted.isEmpty():
        rows = attach(history().dropDuplicates(["series_id", "ts"]), wanted, ["series_id"])
        trained = train(rows, model_type, table, date_column, value_column)
        # retired rows are those after this batch; models that are refitted here bring their own
        current = Snapshot(old.models, cut(_over(old.stats, stats)), around)
        fitted = changes(current, *trained)
        again = trained[0].select("model_id")
        gone = stats.join(again, "model_id", "left_semi").select("arima_id")
        new = Snapshot(
            models.join(again, "model_id", "left_anti").unionByName(fitted.models),
            stats.join(again, "model_id", "left_anti").unionByName(fitted.stats),
            vertices.drop("model_id").join(gone, "arima_id", "left_anti").unionByName(fitted.vertices),
        )
    return registry.read(registry.append(new, None, mark, late.select("series_id", "ts", "value"), version))


def _over(old, new):
    """Rows of ``old`` with those of ``new`` in the place of the ones with their keys."""
    return old.join(new.select("arima_id"), "arima_id", "left_anti").unionByName(new)


def on_insert(
    spark: SparkSession,
    folder: str,
    schema: str,
    registry: Registry,
    checkpoint: str,
    table: str,
    series: str,
    date_column: str,
    value_column: str,
    model_type: str = "autoarima",
    policy: str = "geometric",
    seed: DataFrame | None = None,
    files_per_batch: int = 1,
):
    """Stream of appended files that keeps the registered models up to date.

    A state carries the ids of the stream and of its newest batch, so a batch that is
    run again after a failure finds itself there, whoever else wrote to the
    registry in between.
    """

    def rows_of(df: DataFrame) -> DataFrame:
        return df.select(
            F.col(series).cast("string").alias("series_id"),
            F.col(date_column).cast("timestamp_ntz").alias("ts"),
            F.col(value_column).cast("double").alias("value"),
        )

    stream_id = _stream_id(spark, checkpoint)

    def handle(batch: DataFrame, batch_id: int) -> None:
        mark = f"{stream_id}-{batch_id}"
        if registry.holds(mark):
            return

        def history() -> DataFrame:
            seen = rows_of(spark.read.schema(schema).parquet(folder))
            # files that arrive later are beyond the newest row of this batch
            limit = rows_of(batch).groupBy("series_id").agg(F.max("ts").alias("upto"))
            current = seen.join(limit, "series_id").where(F.col("ts") <= F.col("upto")).drop("upto")
            return current if seed is None else rows_of(seed).unionByName(current)

        process_batch(
            rows_of(batch), registry, None, history, model_type, table, date_column, value_column, policy, mark
        )

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """A name for the stream, remembered beside its checkpoint."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/stream-id")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        return spark.read.text(f"{checkpoint}/stream-id").first()[0]
    name = uuid.uuid4().hex
    out = fs.create(path, True)
    out.write(bytearray(name.encode()))
    out.close()
    return name
