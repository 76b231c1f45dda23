"""Helpers that the corpus operators share: tables, the shared folder, Arrow maps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch that goes to a Python worker: rows of whole texts are too long for a limit by their number.
BATCH_BYTES = 8 << 20
_BYTES_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of bytes in an Arrow batch to BATCH_BYTES; a lower one stays."""
    if int(spark.conf.get(_BYTES_SETTING).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BYTES_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one, if all tasks run in this
    process (``local[...]``, as in tests); a cluster has to name it."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
    return _own_folder()


@lru_cache(1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-shared-")


def new_path(spark: SparkSession, label: str) -> str:
    bounded_batches(spark)
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Applies ``fn`` to every Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """Texts as str; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def slices(texts: list, limit: int = 1 << 20):
    """(from, to) of runs of about ``limit`` characters."""
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups, from batches sorted by ``keys``: a batch's last group waits for the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1] for k in keys]
        cut = batch.num_rows
        same = None
        for k, v in zip(keys, last, strict=True):
            eq = pc.equal(batch.column(k), v)
            same = eq if same is None else pc.and_(same, eq)
        cut = pc.index(same, True).as_py()
        if held and cut == 0:
            first = [held[-1].column(k)[held[-1].num_rows - 1] for k in keys]
            if first != last:
                yield pa.Table.from_batches(held)
                held = []
        elif cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def without(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``id_col`` is among the values of ``gone``, a table of one column. Rows with a null id stay, and so do
    all columns, whatever they are called."""
    name = "gone"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return docs.join(gone.toDF(name).distinct(), docs[f"`{id_col}`"] == F.col(name), "left_anti")
