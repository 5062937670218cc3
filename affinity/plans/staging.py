"""Intermediate results written once as Parquet and read back.

A staged table cuts lineage, outlives lost executors (it sits in the shared
checkpoint folder) and gives the optimizer a true size to plan later joins with.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where it is unset a local session gets a scratch folder of its own; on a
    cluster that would not be shared, so it is an error there.
    """
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="affinity-stage-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other table uses."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark).rstrip('/')}/{app}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete what this application staged; for the end of a job."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    folder = hadoop.Path(f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what was staged inside; for a job that returns none of it."""
    _open.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in map(hadoop.Path, _open.pop()):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A :func:`new_path` that goes with the :func:`scratch` around it."""
    path = new_path(spark, name)
    if _open:
        _open[-1].append(path)
    return path


def drop_unused(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and cached blocks nothing refers to any more.

    It does so when the driver collects its garbage, which a large heap puts off for long.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Compute ``df`` once and return the written copy."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
