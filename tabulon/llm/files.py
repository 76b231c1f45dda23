"""Files that tasks write to and read from the shared folder, through Arrow's file systems (local, HDFS, object stores)."""

from __future__ import annotations

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession


def opened(path: str, mode: str):
    """An output ("w") or random-access input ("r") stream of a URI or an absolute path."""
    store, at = fs.FileSystem.from_uri(path)
    if mode == "w":
        store.create_dir(at.rpartition("/")[0], recursive=True)
        return store.open_output_stream(at, compression=None)
    return store.open_input_file(at)


def attempt_path(folder: str, suffix: str) -> str:
    """A name of this task attempt's own: a rerun attempt never touches a file that a listed attempt wrote."""
    at = TaskContext.get()
    return f"{folder}/part-{at.partitionId():05d}-{at.stageId()}-{at.taskAttemptId()}{suffix}"


def one_task_each(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table (one row a file) dealt out one row to a task."""
    return spark.createDataFrame(rows, schema).coalesce(1).repartition(max(1, len(rows)))
