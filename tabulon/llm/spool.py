"""Texts spooled once to files in the shared folder, so that later passes meet them by file instead of shuffling them again.

A row is named by ``f`` (its file's number: partition and count) and ``row`` (its place there), the same in every run over the same partitions. A pass takes a small side table keyed by f, deals it out so
that all of a file's side rows reach one task, and reads the file there. A file holds about FILE_BYTES of text, which bounds both."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, saved, utf8
from .files import attempt_path, opened

FILE_BYTES, GROUP_ROWS = 32 << 20, 256


class Spool:
    """``rows``: (f, row, k1, k2, n): a 128-bit digest and the byte length of each text. ``files``: (f, path)."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.spark, folder, kind = docs.sparkSession, new_path(docs.sparkSession, "spool"), docs.schema[id_col].dataType
        self.id_type = kind.simpleString()

        def run(batches):
            out = path = schema = None
            n_rows = size = files = 0
            partition = TaskContext.get().partitionId()
            for batch in batches:
                schema = schema or pa.schema([("id", batch.schema.field(0).type), ("text", pa.large_binary())])
                at = 0
                while at < batch.num_rows:
                    raw = utf8(batch.column(1).slice(at, GROUP_ROWS))
                    if out is None:
                        path, files = attempt_path(folder, f"-{files}.parquet"), files + 1
                        stream = opened(path, "w")
                        out, n_rows, size = pq.ParquetWriter(stream, schema, compression="zstd", use_dictionary=False, write_statistics=False), 0, 0
                    out.write_table(pa.Table.from_arrays([pa.chunked_array([batch.column(0).slice(at, len(raw))]), pa.array(raw, pa.large_binary())], schema=schema))
                    keys = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in raw), np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(raw)), pa.array(np.full(len(raw), partition << 20 | files)), pa.array(np.arange(n_rows, n_rows + len(raw))), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), pa.array([len(x) for x in raw]), batch.column(0).slice(at, len(raw))], ["path", "f", "row", "k1", "k2", "n", "id"])
                    n_rows, size, at = n_rows + len(raw), size + sum(map(len, raw)), at + len(raw)
                    if size >= FILE_BYTES:
                        out.close()
                        stream.close()
                        out = None
            if out is not None:
                out.close()
                stream.close()

        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
        rows = saved(texts.mapInArrow(run, f"path string, f bigint, row bigint, k1 bigint, k2 bigint, n bigint, id {self.id_type}"), "spool-rows")
        self._ids = rows.select("f", "row", "id")
        self.files = rows.select("f", "path").distinct()
        self.rows = rows.select("f", "row", "k1", "k2", "n")
        self.n_files = self.files.count()

    def rows_with_id(self) -> DataFrame:
        """(f, row, id)."""
        return self._ids

    def copies(self) -> DataFrame:
        """(f, row, first): the rows whose text occurs again; first marks one of each text."""
        again = self.rows.groupBy("k1", "k2").agg(F.min(F.struct("f", "row")).alias("top"), F.count("*").alias("c")).where("c > 1")
        own = (F.col("f") == F.col("top.f")) & (F.col("row") == F.col("top.row"))
        return self.rows.join(again, ["k1", "k2"]).select("f", "row", own.alias("first"))

    def each(self, side: DataFrame, fn: Callable, schema: str) -> DataFrame:
        """``fn(f, rows, side)`` for every file: ``rows`` yields (ids, texts as bytes, number of the first) group by group; ``side`` maps each
        column of the side table (longs or binary; f and row among them) to its array, in order of row."""
        cols, kinds = side.columns, {c: "binary" if kind == "binary" else "long" for c, kind in side.dtypes}
        files = self.files.select("f", "path", *[F.lit(None).cast(kinds[c]).alias(c) for c in cols if c != "f"])
        dealt = files.unionByName(side.select(*[F.col(c).cast(kinds[c]).alias(c) for c in cols]).withColumn("path", F.lit(None).cast("string")))
        dealt = dealt.repartition(max(1, 2 * self.n_files), "f").sortWithinPartitions("f", "path", "row", *(["pos"] if "pos" in cols else []))

        def groups(path):
            with opened(path, "r") as stream:
                f, n = pq.ParquetFile(stream), 0
                for i in range(f.num_row_groups):
                    t = f.read_row_group(i)
                    yield t.column(0).combine_chunks(), t.column(1).to_pylist(), n
                    n += t.num_rows

        def run(batches):
            now, path, held = None, None, []

            def finish():
                if now is not None:
                    if path is None:
                        raise RuntimeError("side rows of an unknown file")
                    own = pa.Table.from_batches(held)
                    yield from fn(now, groups(path), {c: own[c].to_numpy() for c in cols if c != "f"} if own.num_rows else {c: np.zeros(0, np.int64) for c in cols if c != "f"})

            for batch in batches:
                f = batch.column(batch.schema.get_field_index("f")).to_numpy()
                names = batch.column(batch.schema.get_field_index("path"))
                ends = [0, *(np.flatnonzero(f[1:] != f[:-1]) + 1), len(f)]
                for a, b in zip(ends, ends[1:], strict=False):
                    if a == b:
                        continue
                    if f[a] != now:
                        yield from finish()
                        now, path, held = f[a], None, []
                    part = batch.slice(a, b - a)
                    own = pc.is_valid(names.slice(a, b - a))
                    named = part.filter(own)
                    if named.num_rows:
                        path = named.column(named.schema.get_field_index("path"))[0].as_py()
                    held.append(part.filter(pc.invert(own)))
            yield from finish()

        return dealt.mapInArrow(run, schema)
