"""Sessions and the folder that their executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "tallyspark", **conf: str) -> SparkSession:
    """A session with what the engine counts on: UTC, adaptive plans that split skewed partitions, and checkpoints whose files
    go with the last reference to them (a session made elsewhere keeps them unless it sets the same)."""
    builder = SparkSession.builder.appName(name).config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, a local session takes a temporary folder and a cluster one below its warehouse."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        local = sc.master == "local" or sc.master.startswith("local[")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tallyspark-") if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_checkpoints")
    return sc.getCheckpointDir()


#: What a task should read of a shuffle, and how finely shuffles are dealt out before AQE joins partitions up to that.
TASK_BYTES, FINEST = 8 << 20, 400


def fine_partitions(spark: SparkSession) -> None:
    """Has AQE make tasks of TASK_BYTES. Cells and runs take many times (by the point at which a2_rows spilled, some 20) the room of their shuffled form once they are sorted and
    gathered, so partitions of the usual size spill. A session that has its own number of initial partitions keeps its settings."""
    finest = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if spark.conf.get(finest, None) is None:
        spark.conf.set(finest, str(FINEST))
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", f"{TASK_BYTES}b")


def settle(df: DataFrame) -> DataFrame:
    """df, computed once: what several plans read is written to the shared folder, where it outlives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def forget(df: DataFrame) -> None:
    """Deletes the files of a settled df that nothing reads any more."""
    saved = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if saved.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(saved.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A new folder below the shared one, deleted at the end; settle what is to outlive it."""
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
