"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# A local session without spark.checkpoint.dir gets one temporary folder per application.
_local_roots: dict[str, str] = {}
# Removes the files of a shuffle when the job that wrote it is done, not when the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_step = threading.local()


def configure(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on. Cluster sizing stays with the deployment."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def build_local(cpus: str = "*", partitions: int = 8, app: str = "flowlake") -> SparkSession:
    """Session for tests and the benchmark on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """New path below spark.checkpoint.dir, the folder every executor can reach.

    Only a local session may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        app = spark.sparkContext.applicationId
        if app not in _local_roots:
            _local_roots[app] = tempfile.mkdtemp(prefix="flowlake-")
        root = _local_roots[app]
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result no longer depends on how its rows were computed, so a lost
    executor re-reads files instead of re-running a partitioning that could
    come out differently.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    if getattr(_step, "tables", None) is not None:
        _step.tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``scratch_path`` named, if it is there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def released(spark: SparkSession, tables: bool = True) -> Iterator[None]:
    """A step that leaves no disk behind: stage tables cut within are deleted at its end, shuffle files after each job.

    For steps whose results are written out or collected within; what is still to run afterwards must not read its
    tables. With ``tables=False`` those are left to the step around.
    """
    outer, before = getattr(_step, "tables", None), spark.conf.get(SHUFFLE_CLEANUP, None)
    if tables:
        _step.tables = []
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)
        if tables:
            done, _step.tables = _step.tables, outer
            for path in done:
                discard(spark, path)


def spread(df: DataFrame, rows_mb: int = 4) -> DataFrame:
    """Give an expensive per-row stage over a small stored table a task per core.

    Decided by the planner's size estimate, without running anything: a table of
    less than ``rows_mb`` per core comes in too few splits. Larger ones keep theirs.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * rows_mb * 2**20 else df
