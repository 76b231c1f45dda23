"""The folder that driver and executors share, and what is written there to be read more than once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder if all tasks run in this process (``local``). A cluster has to name it."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
    return _own_folder()


@lru_cache(1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-shared-")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` as ``saved``, whatever its columns are called; ``df`` itself where Parquet has no type for one."""
    if any(word in f.dataType.simpleString() for f in df.schema for word in ("void", "interval")):
        return df
    return saved(df.toDF(*[f"c{i}" for i in range(len(df.columns))]), label).toDF(*df.columns)


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a folder of intermediate results."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored_rows(path: str) -> Iterator[dict]:
    """The rows of a Parquet folder of the shared folder, one at a time, in the same order for every task that reads them."""
    store, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    for info in sorted(store.get_file_info(fs.FileSelector(at)), key=lambda x: x.path):
        if info.base_name.endswith(".parquet"):
            with store.open_input_file(info.path) as stream:
                for batch in pq.ParquetFile(stream).iter_batches(batch_size=1):
                    yield from batch.to_pylist()


def vector_blocks(df: DataFrame, path: str, size: int) -> tuple[int, int]:
    """Writes ``df`` (v array<double>, code int, w double: how many rows a row stands for; without it, one) to ``path``, ``size`` rows at most
    a record (n, x, codes, w: binary); returns (rows stood for, length of a vector)."""
    if "w" not in df.columns:
        df = df.withColumn("w", F.lit(1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).astype(float)
                codes = part.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
                w = part.column(2).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([part.num_rows]), pa.array([x.tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary()), pa.array([w.sum()])], ["n", "x", "codes", "w", "rows"])

    df.select("v", "code", "w").mapInArrow(run, "n bigint, x binary, codes binary, w binary, rows double").write.parquet(path)
    r = df.sparkSession.read.parquet(path).selectExpr("cast(sum(rows) AS bigint) AS n", "max(octet_length(x) div (8 * n)) AS d").first()
    return r["n"] or 0, r["d"] or 0
