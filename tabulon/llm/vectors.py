"""What the searches over vectors share: which rows take part, and blocks of rows in the shared folder that every task can stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a block, which bounds what a task holds of the table at once.
BLOCK = 8192


def sound(df: DataFrame, id_col: str, vector_col: str, **more: Column) -> tuple[DataFrame, int, float, float, int]:
    """(rows, length, largest norm, largest absolute component, number): rows are (id long, v, more) without those whose id, vector or
    component is null, or whose component is not finite. The most frequent length (the smaller of equals) is the table's; rows of another
    length, which have no inner product with the rest, take no part. v is array<float> where the column is, else array<double>."""
    single = isinstance(df.schema[vector_col].dataType, T.ArrayType) and isinstance(df.schema[vector_col].dataType.elementType, T.FloatType)
    name = lambda c: F.col("`" + c.replace("`", "``") + "`")
    rows = df.select(name(id_col).cast("long").alias("id"), name(vector_col).cast("array<float>" if single else "array<double>").alias("v"), *[c.alias(k) for k, c in more.items()])
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).where(whole)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    top = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    found = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("norm"), F.max(top).alias("top")).orderBy(F.desc("n"), "d").first()
    if found is None:
        return rows, 0, 0.0, 0.0, 0
    return rows.where(F.size("v") == found["d"]), found["d"], found["norm"], found["top"], found["n"]


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column of ``d`` values each."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition, ``size`` at a time."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - n)
            batch = batch.slice(part.num_rows)
            held.append(part)
            n += part.num_rows
            if n == size:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def stored_rows(path: str) -> Iterator[dict]:
    """The rows of a Parquet folder that Spark wrote to the shared folder, one at a time and in the same order for every reader."""
    store, at = fs.FileSystem.from_uri(path)
    for info in sorted(store.get_file_info(fs.FileSelector(at)), key=lambda x: x.path):
        if info.base_name.endswith(".parquet"):
            with store.open_input_file(info.path) as stream:
                for batch in pq.ParquetFile(stream).iter_batches(batch_size=1):
                    yield from batch.to_pylist()


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, highest first, the smaller id of equals."""
    if len(score) > 4 * k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= kth)
        return near[np.lexsort((ids[near], -score[near]))[:k]]
    return np.lexsort((ids, -score))[:k]
