"""Cutting lineage with a written table.

A table that several later steps read is written once to the shared checkpoint
folder of the cluster and read back. Unlike a cache it survives lost executors,
and unlike an RDD checkpoint it keeps column pruning and size statistics. Staged
folders are deleted when the session's JVM ends, or earlier with ``discard``. What is
staged inside a ``workspace`` goes with it; its result is staged with ``lasting``.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# Folders staged in the workspaces that are open, innermost last.
_workspaces: list[list[str]] = []


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Where it is unset, a folder in the warehouse, which a session shares with all its
    executors as well. Never a folder of one machine's own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return named or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_staged"


def _path(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def staging_path(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one, deleted when the session's JVM ends."""
    folder = f"{checkpoint_folder(spark)}/tradelark-{uuid.uuid4().hex}-{label}"
    files, path = _path(spark, folder)
    files.deleteOnExit(path)
    if _workspaces:
        _workspaces[-1].append(folder)
    return folder


def discard(spark: SparkSession, folder: str) -> None:
    """Delete a staged folder that nothing reads any more."""
    files, path = _path(spark, folder)
    files.delete(path, True)


def staged(frame: DataFrame, label: str, *, compression: str = "zstd", settle: bool = False, rows: int | None = None) -> DataFrame:
    """Write the frame now and return the same rows read from the written table.

    With ``settle`` the driver collects its garbage afterwards, upon which Spark deletes
    the shuffle files of finished steps that nothing refers to any more. Worth it after a
    step that shuffled much; nothing but disk space depends on it. ``rows`` are the most of a row
    group, which is written and read as a whole: for long rows.
    """
    spark = frame.sparkSession
    folder = staging_path(spark, label)
    grouped = {"parquet.block.row.count.limit": rows} if rows else {}
    frame.write.options(compression=compression, **grouped).parquet(folder)
    if settle:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(frame.schema).parquet(folder)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Delete what is staged inside at the end. Frames that read it cannot be used after."""
    folders: list[str] = []
    _workspaces.append(folders)
    try:
        yield
    finally:
        _workspaces[:] = [other for other in _workspaces if other is not folders]
        for folder in folders:
            discard(spark, folder)


def lasting(frame: DataFrame, label: str) -> DataFrame:
    """Stage the result of a workspace, so that it outlives it."""
    inner = _workspaces.pop()
    try:
        return staged(frame, label)
    finally:
        _workspaces.append(inner)
