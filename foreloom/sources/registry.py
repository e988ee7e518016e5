"""Stored models: a log of changed rows, a pointer to the newest state, and the life cycle of models.

models   model_id, model_type, input_table, date_column, value_column, series_id
stats    arima_id, model_id, version, phi, theta, d, c, use_log, is_active, state
vertices arima_id, vertex_id, phi, theta, state

A commit writes the rows that it changes as one run, in folders by ranges of model ids.  A head names the runs that
make up a state, oldest first; of rows with one key the newest run's counts.  Runs of similar size are merged as they
come, so that a state has few of them and a row is rewritten a few times only, however many commits there are.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foreloom.operators import simplex as X
from foreloom.operators.css import STATE_TYPE
from foreloom.operators.fit import autoarima_search, best_candidate, prepare_search
from foreloom.operators.forecast import DAY, forecast_from_state
from foreloom.session import cut

# Kinds of models.
MODEL_KINDS = ("autoarima", "pyautoarima")

MODELS = "model_id long, model_type string, input_table string, date_column string, value_column string, series_id string"
STATS = (
    "arima_id long, model_id long, version int, phi array<double>, theta array<double>, d int, c double, "
    f"use_log boolean, is_active boolean, last_ts timestamp_ntz, state {STATE_TYPE}"
)
VERTICES = f"arima_id long, vertex_id int, phi array<double>, theta array<double>, state {STATE_TYPE}"
LATE = "series_id string, ts timestamp_ntz, value double"
REMOVED = "model_id long"
# parts of a run, the columns that make a row unique, and whether their rows name their model themselves
PARTS = {"models": (MODELS, ["model_id"]), "stats": (STATS, ["arima_id"]), "vertices": (VERTICES, ["arima_id", "vertex_id"])}

#: Folders of a run; a batch opens only those of the models it touches.
BUCKETS = 16
#: The two newest runs are merged when the older one has fewer than this many times the rows of the newer.
TIER = 4
#: Heads that stay readable.
HEADS = 5


@dataclass(frozen=True)
class Snapshot:
    models: DataFrame
    stats: DataFrame
    vertices: DataFrame

    def active(self) -> DataFrame:
        """Models with their one active row: the newest active version per model."""
        live = self.stats.where("is_active")
        rest = [c for c in live.columns if c != "model_id"]
        newest = live.groupBy("model_id").agg(F.max_by(F.struct(*rest), "version").alias("a"))
        return self.models.join(newest.select("model_id", "a.*"), "model_id")


class Conflict(RuntimeError):
    """Another writer has taken the number of a commit; nothing of it is visible."""


class Registry:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- files ----------------------------------------------------------------

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path(".").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _text(self, name: str) -> str | None:
        fs, path = self._fs(), self._path(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _store(self, name: str, text: str, over: bool) -> None:
        out = self._fs().create(self._path(name), over)
        out.write(bytearray(text.encode()))
        out.close()

    # -- heads ----------------------------------------------------------------

    def versions(self) -> list[int]:
        """Numbers of the heads that can still be read, a bounded number of them."""
        fs, folder = self._fs(), self._path("heads")
        if not fs.exists(folder):
            return []
        found = [int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()]
        # a head that is being written has no text yet
        return sorted(n for n in found if self._text(f"heads/{n:010d}"))

    def _head(self, version: int | None = None) -> tuple[int, dict]:
        known = self.versions()
        if version is None:
            version = known[-1] if known else None
        if version is None:
            return -1, {"runs": [], "marks": {}, "late": None}
        return version, json.loads(self._text(f"heads/{version:010d}"))

    def _commit(self, version: int, head: dict) -> int:
        """Make a state visible; a number can be taken once, by one writer."""
        name = f"heads/{version:010d}"
        fs = self._fs()
        if fs.exists(self._path(name)):
            raise Conflict(f"version {version} was taken by another writer")
        try:
            self._store(name, json.dumps(head), False)
        except Exception as e:
            if "exist" in str(e):
                raise Conflict(f"version {version} was taken by another writer") from e
            raise
        self._prune()
        return version

    def _prune(self) -> None:
        """Drop old heads and the runs that only they name."""
        known = self.versions()
        old, kept = known[:-HEADS], known[-HEADS:]
        if not old:
            return
        used = {r["name"] for v in kept for r in self._head(v)[1]["runs"]}
        for v in old:
            for run in self._head(v)[1]["runs"]:
                if run["name"] not in used:
                    self._fs().delete(self._path(f"runs/{run['name']}"), True)
            self._fs().delete(self._path(f"heads/{v:010d}"), False)

    # -- runs -----------------------------------------------------------------

    def _write_run(self, parts: dict[str, DataFrame], stats_of: DataFrame, floor: bool) -> dict | None:
        """Write changed rows; ``stats_of`` names the models of their parameter sets, where vertices do not.  A run on the ``floor`` has nothing
        under it, and needs no record of what was removed."""
        name = uuid.uuid4().hex
        bucket = F.pmod(F.col("model_id"), F.lit(BUCKETS)).cast("int").alias("bucket")
        rows = 0
        for part, df in parts.items():
            if part == "removed" and floor:
                continue
            if part == "vertices" and "model_id" not in df.columns:
                owners = stats_of.select("arima_id", "model_id").distinct()
                df = df.join(owners, "arima_id")
            df.select("*", bucket).write.partitionBy("bucket").parquet(f"{self.root}/runs/{name}/{part}")
            if part in ("stats", "removed"):
                path = f"{self.root}/runs/{name}/{part}"
                rows += self.spark.read.schema(self._schema(part)).parquet(path).count()
        return {"name": name, "rows": rows}

    def _schema(self, part: str) -> T.StructType:
        text = {"removed": REMOVED}.get(part) or PARTS[part][0] + (", model_id long" if part == "vertices" else "")
        return T._parse_datatype_string(text + ", bucket int")

    def _part(self, runs: list[dict], part: str, touched: DataFrame | None) -> DataFrame:
        """Rows of a part with the number of their run; only those of the ``touched`` models where they are named."""
        out = None
        for number, run in enumerate(runs):
            path = f"{self.root}/runs/{run['name']}/{part}"
            if part == "removed" and not self._fs().exists(self._path(f"runs/{run['name']}/{part}")):
                continue
            rows = self.spark.read.schema(self._schema(part)).parquet(path)
            if touched is not None:
                # folders of other models are not opened
                rows = rows.join(touched, ["bucket", "model_id"], "left_semi")
            rows = rows.withColumn("_run", F.lit(number))
            out = rows if out is None else out.unionByName(rows)
        return self._empty(self._schema(part)).withColumn("_run", F.lit(0)) if out is None else out

    def _empty(self, schema: T.StructType) -> DataFrame:
        """No rows, which the planner knows: what joins them costs nothing."""
        return self.spark.range(1).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])

    def _latest(self, runs: list[dict], part: str, touched: DataFrame | None = None) -> DataFrame:
        """Of each key the row of its newest run, without models that were removed then or later.  Only keys of newer runs
        are compared with the rows of a run, so that the newest run is handed on as it is."""
        keys, out = PARTS[part][1], None
        for number, run in enumerate(runs):
            rows = self._part([run], part, touched).withColumn("_run", F.lit(number))
            if runs[number + 1 :]:
                rows = rows.join(self._part(runs[number + 1 :], part, touched).select(*keys), keys, "left_anti")
            out = rows if out is None else out.unionByName(rows)
        if out is None:
            return self._part(runs, part, touched)
        if len(runs) > 1:
            removed = self._part(runs, "removed", touched).groupBy("model_id").agg(F.max("_run").alias("_gone"))
            out = out.join(removed, "model_id", "left").where(F.col("_gone").isNull() | (F.col("_run") > F.col("_gone")))
        return out

    def _newest(self, runs: list[dict], touched: DataFrame | None = None) -> Snapshot:
        """The state that runs make up: of each key the newest row, models that were removed later left out, vertices of
        active parameter sets only."""
        found = {part: self._latest(runs, part, touched) for part in PARTS}
        live = found["stats"].where("is_active").select("arima_id")
        found["vertices"] = found["vertices"].join(live, "arima_id", "left_semi")
        names = {part: [f.name for f in T._parse_datatype_string(text).fields] for part, (text, _) in PARTS.items()}
        return Snapshot(*[found[part].select(*names[part]) for part in PARTS])

    def _settle(self, runs: list[dict]) -> list[dict]:
        """Merge the newest runs while they are of similar size."""
        while len(runs) > 1 and runs[-2]["rows"] < TIER * runs[-1]["rows"]:
            two, below = runs[-2:], runs[:-2]
            state = self._newest(two)
            # vertices of sets whose statistics lie in older runs stay: the two runs alone cannot tell
            vertices = self._latest(two, "vertices").select("arima_id", "vertex_id", "phi", "theta", "state", "model_id")
            parts = {"models": state.models, "stats": state.stats, "vertices": vertices}
            if any(self._fs().exists(self._path(f"runs/{run['name']}/removed")) for run in two):
                parts["removed"] = self._part(two, "removed", None).select("model_id").distinct()
            runs = [*below, self._write_run(parts, state.stats, not below)]
        return runs

    # -- states ---------------------------------------------------------------

    def read(self, version: int | None = None, series: DataFrame | None = None) -> Snapshot:
        """The state of a head, the newest by default; with ``series`` (model_id) only of these models."""
        _, head = self._head(version)
        touched = None
        if series is not None:
            touched = series.select("model_id").distinct().withColumn("bucket", F.pmod(F.col("model_id"), F.lit(BUCKETS)).cast("int"))
        return self._newest(head["runs"], touched)

    def write(
        self, snapshot: Snapshot, version: int | None = None, mark: str | None = None, late: DataFrame | None = None
    ) -> int:
        """Store a whole state in place of the newest one; a version that exists already is left as it is."""
        now, head = self._head()
        if version is not None and version <= now:
            return version
        run = self._write_run({"models": snapshot.models, "stats": snapshot.stats, "vertices": snapshot.vertices}, snapshot.stats, True)
        return self._commit(now + 1 if version is None else version, self._next(head, [run], mark, late))

    def append(
        self, changed: Snapshot, removed: DataFrame | None = None, mark: str | None = None, late: DataFrame | None = None,
        version: int | None = None,
    ) -> int:
        """Commit changed rows: they take the place of those with the same keys.  A version that exists is left as it is.

        ``mark`` names the micro-batch, ``late`` are rows of that batch that came too late for their states; both become
        visible with the state.  ``removed`` (model_id) are models that go with all their rows.  The cost is that of the
        changed rows, and of merges of runs of their size.
        """
        now, head = self._head()
        if version is not None and version <= now:
            return version
        parts = {"models": changed.models, "stats": changed.stats, "vertices": changed.vertices}
        if removed is not None:
            parts["removed"] = removed.select("model_id")
        run = self._write_run(parts, changed.stats, not head["runs"])
        runs = self._settle([*head["runs"], run]) if run["rows"] else head["runs"]
        return self._commit(now + 1 if version is None else version, self._next(head, runs, mark, late))

    def _next(self, head: dict, runs: list[dict], mark: str | None, late: DataFrame | None) -> dict:
        marks = dict(head["marks"])
        if mark is not None:
            stream, _, batch = mark.rpartition("-")
            marks[stream] = int(batch)
        if head["late"]:  # what the state before named becomes part of the table now
            fs, held = self._fs(), self._path(f"held/{head['late']}")
            if fs.exists(held):
                fs.mkdirs(self._path("late"))
                fs.rename(held, self._path(f"late/part={head['late']}"))
        name = None
        if late is not None:
            name = uuid.uuid4().hex
            late.write.parquet(f"{self.root}/held/{name}")
        return {"runs": runs, "marks": marks, "late": name}

    def holds(self, mark: str) -> bool:
        """Whether the newest state holds the micro-batch of this name (``stream-number``), or a later one of its stream."""
        stream, _, batch = mark.rpartition("-")
        return self._head()[1]["marks"].get(stream, -1) >= int(batch)

    def late(self) -> DataFrame:
        """series_id, ts and value: the rows that streams set aside as late."""
        _, head = self._head()
        out = self.spark.createDataFrame([], LATE)
        fs = self._fs()
        held = [f"held/{head['late']}"] if head["late"] else []
        for name in ["late", *held]:
            if fs.exists(self._path(name)):
                out = out.unionByName(self.spark.read.schema(LATE).parquet(f"{self.root}/{name}").select(*out.columns))
        return out

    # -- life cycle -----------------------------------------------------------

    def create_forecast(
        self, model_type: str, table: str, df: DataFrame, date_column: str, value_column: str, series: str | None = None
    ) -> int:
        """Search a model per series, register it as the active one, and store its vertices."""
        if model_type not in MODEL_KINDS:
            raise ValueError(f"{model_type} is none of the kinds {MODEL_KINDS}")
        name = F.col(series).cast("string") if series else F.lit(table)
        rows = df.select(name.alias("series_id"), F.col(date_column).cast("timestamp_ntz").alias("ts"), F.col(value_column).cast("double").alias("value"))
        trained = train(rows, model_type, table, date_column, value_column)
        return self.append(changes(self.read(series=trained[0]), *trained))

    def remove_forecast(self, model_type: str, table: str, date_column: str, value_column: str) -> bool:
        """Drop the models of a table and column with everything that belongs to them."""
        gone = cut(self.read().models.where(self._key(model_type, table, date_column, value_column)).select("model_id"))
        if gone.isEmpty():
            return False
        empty = Snapshot(*[self.spark.createDataFrame([], T._parse_datatype_string(text)) for text, _ in PARTS.values()])
        self.append(empty, gone)
        return True

    @staticmethod
    def _key(model_type, table, date_column, value_column):
        return (
            (F.col("model_type") == model_type)
            & (F.col("input_table") == table)
            & (F.col("date_column") == date_column)
            & (F.col("value_column") == value_column)
        )

    def model_get_id(self, model_type: str, table: str, date_column: str, value_column: str) -> DataFrame:
        found = self.read().models.where(self._key(model_type, table, date_column, value_column))
        return found.select("series_id", "model_id")

    def model_get_loss(self, model_type: str, table: str, date_column: str, value_column: str) -> DataFrame:
        active = self.read().active().where(self._key(model_type, table, date_column, value_column))
        return active.select("series_id", F.col("state.css").alias("css"))

    def arima_get_active_id(self, model_type: str, table: str, date_column: str, value_column: str) -> DataFrame:
        active = self.read().active().where(self._key(model_type, table, date_column, value_column))
        return active.select("series_id", "arima_id")

    def arima_has_vertices(self) -> DataFrame:
        """Every stored parameter set and whether it has vertices."""
        snap = self.read()
        have = snap.vertices.select("arima_id").distinct().withColumn("has_vertices", F.lit(True))
        out = snap.stats.select("arima_id").join(have, "arima_id", "left")
        return out.select("arima_id", F.coalesce("has_vertices", F.lit(False)).alias("has_vertices"))

    def run_forecast(
        self, model_type: str, table: str, date_column: str, value_column: str, horizon: int, step=DAY,
        history: DataFrame | None = None,
    ) -> DataFrame:
        """Forecast of every active model from its stored state; no rows when there is none.

        ``step="infer"`` takes the distance of the last two timestamps of the
        history of each series.
        """
        active = self.read().active().where(self._key(model_type, table, date_column, value_column))
        if isinstance(step, str) and step == "infer":
            from foreloom.functions.scalars import seconds_interval
            from foreloom.operators.relational import last_step

            steps = last_step(history.select("series_id", "ts"), ["series_id"], "ts")
            active = active.join(steps.select("series_id", "step_seconds"), "series_id")
            step = seconds_interval("step_seconds")
        out = forecast_from_state(active, ["series_id"], horizon, step)
        return out.select("series_id", "forecast_date", "forecast_value")


def model_id(*parts) -> F.Column:
    """Identifier from the natural key, the same on every run."""
    return F.xxhash64(*parts)


def train(rows: DataFrame, model_type: str, table: str, date_column: str, value_column: str, version: int = 0):
    """Best model per series as (models, stats, vertices) rows.

    ``rows`` has series_id, ts and value.
    """
    packed, plan = prepare_search(rows, ["series_id"])
    best = best_candidate(autoarima_search(packed, plan), ["series_id"]).drop("n")
    best = cut(best.join(plan.select("series_id", "use_log"), "series_id"))
    states = cut(X.initial_states(packed, best))
    ends = packed.frame.groupBy("series_id").agg(F.max("last_ts").cast("timestamp_ntz").alias("last_ts"))
    ids = best.join(ends, "series_id").select(
        "series_id",
        "use_log",
        "last_ts",
        model_id(F.lit(model_type), F.lit(table), F.lit(date_column), F.lit(value_column), "series_id").alias("model_id"),
    )
    ids = ids.withColumn("arima_id", F.xxhash64("model_id", F.lit(version)))
    models = ids.select(
        "model_id",
        F.lit(model_type).alias("model_type"),
        F.lit(table).alias("input_table"),
        F.lit(date_column).alias("date_column"),
        F.lit(value_column).alias("value_column"),
        "series_id",
    )
    joined = states.join(ids, "series_id")
    stats = joined.where(F.col("vertex_id") == X.CENTRE).select(
        "arima_id", "model_id", F.lit(version).alias("version"), "phi", "theta", F.col("d").cast("int").alias("d"), "c", "use_log",
        F.lit(True).alias("is_active"), "last_ts", "state",
    )
    vertices = joined.where(F.col("vertex_id") != X.CENTRE).select("arima_id", "vertex_id", "phi", "theta", "state")
    models, stats, vertices = cut(models), cut(stats), cut(vertices)
    packed.frame.unpersist()
    return models, stats, vertices


def changes(old: Snapshot, models: DataFrame, stats: DataFrame, vertices: DataFrame) -> Snapshot:
    """What an upsert changes: new rows become the active ones of their models, older versions stay, inactive and without
    vertices.  ``old`` has these models at least."""
    before = old.stats.join(models.select("model_id"), "model_id", "left_semi")
    last = before.groupBy("model_id").agg(F.max("version").alias("last"))
    numbered = stats.join(last, "model_id", "left").withColumn(
        "version", F.coalesce(F.col("last") + 1, F.col("version"))
    ).drop("last")
    renamed = numbered.withColumn("new_id", F.xxhash64("model_id", "version"))
    mapping = renamed.select("arima_id", "new_id")
    new_stats = renamed.withColumn("arima_id", F.col("new_id")).select(*stats.columns)
    new_vertices = vertices.join(mapping, "arima_id").withColumn("arima_id", F.col("new_id")).select(*vertices.columns)
    retired = before.where("is_active").withColumn("is_active", F.lit(False))
    return Snapshot(models, retired.unionByName(new_stats), new_vertices)
