"""Tables written once and read again where a result is used several times."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    A session on one machine (``local``, ``local[n]``) may leave it unset, as tests do;
    it is then set to a temporary folder.  Any cluster must name it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = f"file://{tempfile.mkdtemp(prefix='keysift-shared-')}"
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A path of its own inside the shared folder; nothing is made there yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, path: str | None = None, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet and read it back: computed once, columns pruned by later readers.

    Survives lost executors: later stages read files instead of repeating the work.
    ``path`` defaults to a new one in the shared folder.
    """
    path = path or scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now instead of at its next collection.

    Spark deletes them when the driver's objects behind them are collected; a long chain
    of jobs would otherwise hold the sum of all its shuffles on disk.  The last job is
    reported to listeners a moment after it ended, so one collection is not enough.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)
