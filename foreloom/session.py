"""Session settings the package reads, and the one way it cuts lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Largest ordered group that a single task may hold.  Groups above it take the
# sliced route in ``foreloom.plans``; nothing is dropped either way.
GROUP_ROWS_KEY = "spark.foreloom.groupRows"
GROUP_ROWS_DEFAULT = 1_000_000

# Longest array of one packed series chunk; it bounds a row handed to Python.
PACK_ROWS_KEY = "spark.foreloom.packRows"
PACK_ROWS_DEFAULT = 262_144

# Largest table (in rows) that may be broadcast by an explicit hint.
BROADCAST_ROWS_KEY = "spark.foreloom.broadcastRows"
BROADCAST_ROWS_DEFAULT = 200_000


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_foreloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="foreloom-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/foreloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    sc.addPyFile(archive)
    sc._foreloom_shipped = True


def build_session(app: str = "foreloom", cores: str = "*", shuffle: int = 8) -> SparkSession:
    """A local session for tests, benches and the shell."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


def group_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(GROUP_ROWS_KEY, str(GROUP_ROWS_DEFAULT)))


def pack_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(PACK_ROWS_KEY, str(PACK_ROWS_DEFAULT)))


def broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_ROWS_KEY, str(BROADCAST_ROWS_DEFAULT)))


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the cluster; a temporary one only in local mode."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc.getCheckpointDir()
    if named:
        if current is None:
            sc.setCheckpointDir(named)
        return named
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        own = tempfile.mkdtemp(prefix="foreloom-")
        # only this process, which made the folder, reads it
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
        current = sc.getCheckpointDir()
    return current


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write an intermediate once as Parquet in the shared folder and read it back.

    Unlike ``checkpoint`` this computes the frame once, keeps column pruning for
    its readers, and survives the loss of executors all the same.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/foreloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """End the lineage of a result that several later steps read."""
    return stage(df, "cut")


def fits(df: DataFrame, rows: int) -> bool:
    """Measured size check: stops reading once more than ``rows`` rows were seen."""
    return df.limit(rows + 1).count() <= rows


@contextmanager
def planned_once(spark: SparkSession, when: bool):
    """Plan the enclosed queries once instead of stage by stage.

    For many queries in a row over inputs that were measured to be small, where
    re-planning between stages costs more than the stages do.
    """
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    if when:
        spark.conf.set(key, "false")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@contextmanager
def spread_over(spark: SparkSession, rows: int):
    """Shuffle the enclosed queries so that no more of ``rows`` rows than a task should hold go to one partition.

    A fixed number of partitions, or one that is merged again by bytes, makes the tasks of a grouping of many distinct
    keys grow with the input.  Queries run with the setting only if they are run inside.
    """
    wanted = -(-rows // group_rows(spark))
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(k) for k in keys]
    if wanted > 1:
        spark.conf.set(keys[0], str(max(wanted, shuffle_partitions(spark))))
        spark.conf.set(keys[1], "false")
    try:
        yield
    finally:
        for k, v in zip(keys, before):
            spark.conf.set(k, v)
