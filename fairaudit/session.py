"""Spark session, shared scratch storage and size-checked broadcast.

Nothing here is specific to fairness: these are the few helpers every job in
the package shares so that it behaves the same on ``local[8]`` and on a
cluster.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Session settings used by tests and the benchmark. On a cluster the
# deployment owns these; the package never overrides a setting it finds.
DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}

# Largest number of rows a derived table may have before it is broadcast.
# Broadcast sides here are aggregates (groups x labels, slices x groups), so
# the bound is checked on the materialised aggregate, never assumed.
BROADCAST_MAX_ROWS = 2_000_000

# Bytes of rows, about, that a Python worker gets as one Arrow batch in passes over
# long texts. The executor and the worker both hold a batch, once for each core.
ARROW_BYTES = "4m"
ARROW_BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def build_session(master: str | None = None, app: str = "fairaudit",
                  shuffle_partitions: int | None = None,
                  driver_memory: str = "16g",
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the package defaults."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions or int(cpus))
    conf["spark.driver.memory"] = driver_memory
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_base(spark)
    return spark


def checkpoint_base(spark: SparkSession) -> str:
    """Shared folder for checkpoints and scratch tables.

    Uses the folder the cluster names in ``spark.checkpoint.dir`` (or one
    already set on the context). Only when neither exists and the master is
    ``local`` is a private folder created; a cluster without a shared folder
    raises, because executors cannot read the driver's disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        try:
            named = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            named = None
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="fairaudit-ckpt-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per Spark context.

    Needed wherever Python functions of the package run on executors that
    were not started with the package on their path.
    """
    sc = spark.sparkContext
    if getattr(sc, "_fairaudit_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(root)
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="fairaudit-zip-")), "fairaudit.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(d, name)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(path)
    sc._fairaudit_shipped = True


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts lineage like a checkpoint, and the reread table also has a known
    size, so the planner broadcasts it only under its own threshold.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables that one job writes to the shared folder and deletes again.

    ``staged`` works like the function; ``drop`` deletes tables by name once their
    last reader has written its result. Leaving the context deletes what is left,
    except names given to ``keep``: tables that the job's result still reads.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: dict[str, list[str]] = {}
        self.kept: set[str] = set()

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error) -> None:
        self.drop(*[name for name in self.paths if name not in self.kept])

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        self.paths.setdefault(name, []).append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, *names: str) -> None:
        self.kept.update(names)

    def drop(self, *names: str, but_last: int = 0) -> None:
        """Delete the tables of these names, except the ``but_last`` latest of each."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            paths = self.paths.get(name, [])
            old = paths[:len(paths) - but_last]
            self.paths[name] = paths[len(old):]
            for path in old:
                place = jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(conf).delete(place, True)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside hands rows to Python workers in batches of about ``ARROW_BYTES``.

    Batches are bounded by rows and by 64 MB otherwise. A setting of the session stays.
    """
    found = spark.conf.get(ARROW_BYTES_CONF, None)
    if found is None:
        spark.conf.set(ARROW_BYTES_CONF, ARROW_BYTES)
    try:
        yield
    finally:
        if found is None:
            spark.conf.unset(ARROW_BYTES_CONF)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return f"{checkpoint_base(spark)}/fairaudit/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder."""
    checkpoint_base(df.sparkSession)
    return df.checkpoint(eager=True)


def reuse(df: DataFrame) -> DataFrame:
    """Persist a table that several later steps read, computing it once now.

    The cached plan fixes its physical RDD (including any sampled range
    bounds), so a block lost with an executor is recomputed by that same
    lineage and agrees with the blocks that survived.
    """
    from pyspark import StorageLevel
    out = df.persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    return out


def on_disk(df: DataFrame) -> DataFrame:
    """``reuse`` on the executors' disks only, for tables that several steps read.

    Makes no files in the shared folder: there a file per task and table costs more
    than the rows when tasks are small. Meant for tables whose rows do not depend on
    the order of their input, so that a block lost with an executor comes out the same.
    """
    from pyspark import StorageLevel
    out = df.persist(StorageLevel.DISK_ONLY)
    out.count()
    return out


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> tuple[DataFrame, bool]:
    """Checkpoint a derived table and broadcast it only if its size is proven.

    Returns ``(table, broadcast_used)``. Above the bound the table is returned
    without a hint and the planner falls back to a shuffle join (AQE may still
    switch strategies from runtime statistics).
    """
    small = materialize(df)
    n = small.limit(max_rows + 1).count()
    if n <= max_rows:
        return F.broadcast(small), True
    return small, False
