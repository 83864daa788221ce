"""Session settings and durable intermediate storage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

# Adaptive execution carries most of the load at scale: it merges small
# shuffle partitions, splits skewed join partitions and turns a sort-merge
# join into a broadcast join once the measured size is below the threshold.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Checkpoint files go away with the frames that use them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # Recording the Python call site of every column costs more than planning.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def get_session(app: str = "siftrank", master: str | None = None, **conf: str) -> SparkSession:
    """Build a session; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only where none is named and the master is local (single-machine tests) a
    fresh local folder is made and set; on a cluster that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(configured)
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    fresh = tempfile.mkdtemp(prefix="siftrank-shared-", dir=os.environ.get("TMPDIR"))
    spark.sparkContext.setCheckpointDir(fresh)
    return fresh


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a frame without lineage.

    A reliable checkpoint: losing an executor later costs nothing, and values
    that depend on partition numbers are frozen.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give an input of few file splits enough partitions for heavy per-row work.

    Only inputs with fewer splits than the cluster has task slots are moved, so
    never more than ``slots`` splits of data.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots, key) if df.rdd.getNumPartitions() < slots else df


_SCRATCH: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the application's own scratch folder in the shared one.

    The folder goes away when the process that made it ends.
    """
    root = f"{shared_dir(spark)}/siftrank-{spark.sparkContext.applicationId}"
    if root not in _SCRATCH:
        _SCRATCH.add(root)
        atexit.register(_remove, spark._jvm, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def _remove(jvm, root: str) -> None:
    try:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)
    except (Py4JError, OSError):
        pass  # the engine is gone already; the folder stays in the cluster's scratch area


def columnar(df: DataFrame, name: str = "step", most: int = 0) -> DataFrame:
    """Like :func:`durable`, as Parquet: later readers take only the columns they use and push filters down.

    A file has ``most`` rows at most (0: any number).
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", most).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
