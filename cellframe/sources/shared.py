"""Folders that all executors can reach, and tables written there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: The paths handed out since each open ``dropping`` began.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where it is unset and the master is local."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cellframe-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    for paths in _open:
        paths.append(path)
    return path


@contextmanager
def dropping(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all that was written to the shared folder within: the caller's way to clean up.

    What is to stay has to be written elsewhere before.
    """
    paths: list[str] = []
    _open.append(paths)
    try:
        yield
    finally:
        _open.remove(paths)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows that one task writes of a table whose number of rows is known.
TASK_ROWS = 100_000


def written(frame: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """The frame as a Parquet table in the shared folder: lineage ends here and a lost executor loses nothing.

    ``rows`` is a bound of how many there are, where one is known. A small table is then written by as many
    tasks as there are cores, not by all shuffle partitions: on a local file system every file
    starts processes that set its permissions.
    """
    spark = frame.sparkSession
    if rows is not None:
        frame = frame.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))
    path = shared_path(spark, what)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
