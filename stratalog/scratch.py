"""Staging tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from stratalog.model import StorageFailure

#: Paths of the staging tables of this process that are still there.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A local folder is set where the session names none, but only if all tasks run in this very process: on a
    cluster each executor would write to a disk of its own, so StorageFailure is raised there."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise StorageFailure(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        local = tempfile.mkdtemp(prefix="stratalog-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        named = f"file://{local}"
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as its object."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def new_path(spark: SparkSession, what: str) -> str:
    """A path for a new staging table, deleted when the driver's JVM ends, if not before by ``scope`` or ``release``."""
    path = f"{shared_dir(spark)}/stratalog-{what}-{uuid.uuid4().hex}"
    fs, p = filesystem(spark, path)
    fs.deleteOnExit(p)
    _made.append(path)
    return path


def staged(df: DataFrame, what: str) -> DataFrame:
    """df written once as a table in the shared folder and read from there: its lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, keep: int = 0) -> int:
    """Deletes the staging tables made so far but the first ``keep``; returns how many. Results that read them can't be read any more."""
    old, _made[keep:] = _made[keep:], []
    for path in old:
        fs, p = filesystem(spark, path)
        fs.delete(p, True)
    return len(old)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the staging tables that are made inside when it ends. Results must be written or collected by then."""
    n = len(_made)
    try:
        yield
    finally:
        release(spark, n)
