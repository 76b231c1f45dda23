"""CSV records of files of any size, cut at their true ends by all tasks at once.

A quoted field may hold line ends, so whether a line begins a record depends on all bytes before it. Here each split of a file is read once
under both assumptions, that it begins outside a quoted field or inside one, and yields what state it ends in under each. These maps are
composed in the order of splits (a window over one small row a split), which settles every split's true beginning; the same pass counts
fields and looks for bytes that are not of an encoding. A second reading then cuts records: a split that begins inside a field leaves the
lines up to the first record's end to the split where that record began, which has been handed those lines. Nothing is shuffled, and the
rows stay in the order of the file.

A quote opens a field only at the field's start; two quotes in a row, or the escape character and any other, stand for themselves. A record
longer than RECORD_BYTES, as a quote that is never closed makes, is an error. Lines end at a line feed, a carriage return before it is
dropped at a record's end; files with carriage returns alone are cut there."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD_BYTES = 64 << 20
#: Bytes of record ends that are broadcast; beyond, they are written to the shared folder and each task looks up its own.
HELD_BYTES = 32 << 20
_SURVEY = "path string, start bigint, out_end boolean, in_end boolean, out_width bigint, in_width bigint, out_breaks boolean, in_breaks boolean, utf8 boolean, cp1252 boolean, quoted boolean"
_NO_CP1252 = re.compile(rb"[\x81\x8d\x8f\x90\x9d]")
BOM = b"\xef\xbb\xbf"


@dataclass(frozen=True)
class Dialect:
    separator: bytes = b","
    quote: bytes = b'"'
    escape: bytes = b'"'
    line_end: bytes = b"\n"

    def scanner(self):
        """``scan(line, inside)``: (whether the line ends inside a quoted field, separators outside quoted fields)."""
        sep, q = self.separator, self.quote
        if self.escape == q or not self.escape:
            body = re.compile(b"[^%b]*(?:%b[^%b]*)*" % (re.escape(q), re.escape(q + q), re.escape(q)))
        else:
            both = re.escape(q) + re.escape(self.escape)
            body = re.compile(b"[^%b]*(?:(?:%b.|%b)[^%b]*)*" % (both, re.escape(self.escape), re.escape(q + q), both), re.DOTALL)
        opening = sep + q

        def scan(line: bytes, inside: bool) -> tuple[bool, int]:
            at = seps = 0
            if not inside:
                if line.startswith(q):
                    at = len(q)
                else:
                    found = line.find(opening)
                    if found < 0:
                        return False, line.count(sep)
                    seps, at = line.count(sep, 0, found) + 1, found + len(opening)
            while True:
                at = body.match(line, at).end()
                if at >= len(line):
                    return True, seps
                found = line.find(opening, at)
                if found < 0:
                    return False, seps + line.count(sep, at)
                seps, at = seps + line.count(sep, at, found) + 1, found + len(opening)

        return scan


def lines(spark: SparkSession, path: str, dialect: Dialect) -> DataFrame:
    """(path, start, value): the lines of each split in order, as bytes."""
    text = spark.read.text(path, lineSep=dialect.line_end.decode())
    return text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int] | None, pa.Array]]:
    """((path, start), lines) of every run of lines of one split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        start, path = batch.column(1).to_numpy(), pc.dictionary_encode(batch.column(0))
        code = path.indices.to_numpy()
        ends = [0, *(np.flatnonzero((start[1:] != start[:-1]) | (code[1:] != code[:-1])) + 1), batch.num_rows]
        for a, b in zip(ends, ends[1:], strict=False):
            yield (path.dictionary[code[a]].as_py(), int(start[a])), batch.column(2).slice(a, b - a)


class _Track:
    """One assumption about a split's beginning, followed to its end."""

    def __init__(self, inside: bool):
        self.inside, self.seps, self.width, self.breaks = inside, 0, 0, False

    def plain(self, counts: np.ndarray) -> None:
        """Lines without a quote."""
        if not self.inside and len(counts):
            self.width = max(self.width, int(counts.max()) + 1)

    def line(self, scan, text: bytes) -> None:
        self.inside, more = scan(text, self.inside)
        self.seps += more
        if self.inside:
            self.breaks = True
        else:
            self.width, self.seps = max(self.width, self.seps + 1), 0


def survey(spark: SparkSession, path: str, dialect: Dialect) -> DataFrame:
    """A row for each split, with ``inside``: whether it begins inside a quoted field."""
    names = [c.split()[0] for c in _SURVEY.split(", ")]

    def run(batches):
        scan = dialect.scanner()
        key = tracks = None
        utf8 = cp1252 = True
        quoted = False

        def row():
            a, b = tracks
            said = (key[0], key[1], a.inside, b.inside, a.width, b.width, a.breaks, b.breaks, utf8, cp1252, quoted)
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in said], names)

        for now, part in _splits(batches):
            if now != key:
                if key is not None:
                    yield row()
                key, tracks, utf8, cp1252, quoted = now, (_Track(False), _Track(True)), True, True, False
            if utf8:
                try:
                    part.cast(pa.large_binary()).cast(pa.large_string())
                except pa.ArrowInvalid:
                    utf8 = False
            if cp1252:
                cp1252 = not any(_NO_CP1252.search(x) for x in part.to_pylist()) if not utf8 else cp1252
            counts = pc.count_substring(part, dialect.separator).to_numpy(zero_copy_only=False)
            marked = np.flatnonzero(pc.count_substring(part, dialect.quote).to_numpy(zero_copy_only=False))
            quoted |= bool(len(marked))
            at = 0
            for i in marked:
                text = part[int(i)].as_py()
                for t in tracks:
                    t.plain(counts[at:i])
                    t.line(scan, text)
                at = i + 1
            for t in tracks:
                t.plain(counts[at:])
        if key is not None:
            yield row()

    found = lines(spark, path, dialect).mapInArrow(run, _SURVEY)
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum((F.col("out_end") & ~F.col("in_end")).cast("int")).over(before), F.lit(0))
    settled = F.last(F.when(F.col("out_end") == F.col("in_end"), F.struct("out_end", "swaps")), ignorenulls=True).over(before)
    found = found.withColumn("swaps", swaps).withColumn("settled", settled)
    odd = (F.col("swaps") - F.coalesce(F.col("settled.swaps"), F.lit(0))) % 2 == 1
    inside = F.coalesce(F.col("settled.out_end"), F.lit(False)) != odd
    return found.withColumn("inside", inside).drop("swaps", "settled")


@dataclass(frozen=True)
class Found:
    """What a survey says of all files together."""

    width: int
    breaks: bool
    quoted: bool
    utf8: bool
    cp1252: bool


def told(surveyed: DataFrame) -> Found:
    inside = F.col("inside")
    r = surveyed.agg(
        F.max(F.when(inside, F.col("in_width")).otherwise(F.col("out_width"))).alias("width"), F.max(F.when(inside, F.lit(True)).otherwise(F.col("out_breaks"))).alias("breaks"),
        F.max("quoted").alias("quoted"), F.min("utf8").alias("utf8"), F.min("cp1252").alias("cp1252"),
    ).first()
    return Found(r["width"] or 0, bool(r["breaks"]), bool(r["quoted"]), r["utf8"] is not False, r["cp1252"] is not False)


def _held(spark: SparkSession, rows: DataFrame, folder):
    """``look((path, start))``: the other columns of that row of ``rows`` (path, start, ...), or None; for tasks. Up to HELD_BYTES are
    broadcast, more are written to ``folder()``."""
    size = rows.agg(F.sum(F.octet_length("path") + 64 + (F.coalesce(F.aggregate("rest", F.lit(0), lambda a, x: a + F.octet_length(x)), F.lit(0)) if "rest" in rows.columns else F.lit(0)))).first()[0] or 0
    if size <= HELD_BYTES:
        held = spark.sparkContext.broadcast({(r["path"], r["start"]): tuple(r)[2:] for r in rows.collect()})
        return lambda key: held.value.get(key)
    at = folder()
    rows.orderBy("path", "start").write.parquet(at)

    def look(key):
        import pyarrow.dataset as ds
        from pyarrow import fs

        store, place = fs.FileSystem.from_uri(at)
        got = ds.dataset(place, format="parquet", filesystem=store).to_table(filter=(ds.field("path") == key[0]) & (ds.field("start") == key[1])).to_pylist()
        return tuple(got[0].values())[2:] if got else None

    return look


def _heads(spark: SparkSession, path: str, dialect: Dialect, surveyed: DataFrame, folder) -> DataFrame:
    """(path, start, head): of every split that begins inside a quoted field, the lines up to the first that ends outside."""
    look = _held(spark, surveyed.where("inside").select("path", "start"), lambda: folder() + "-inside")

    def run(batches):
        scan = dialect.scanner()
        key, inside, head = None, False, []

        def row():
            return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([dialect.line_end.join(head)], pa.binary())], ["path", "start", "head"])

        for now, part in _splits(batches):
            if now != key:
                if head:
                    yield row()
                key, inside, head, size = now, look(now) is not None, [], 0
            if not inside:
                continue
            for i, line in enumerate(part):
                head.append(line.as_py())
                size += len(head[-1])
                if dialect.quote in head[-1]:
                    inside, _ = scan(head[-1], True)
                if not inside:
                    break
                if size > RECORD_BYTES:
                    raise ValueError(f"{key[0]}: a quoted field of over {RECORD_BYTES} bytes; is {dialect.quote.decode()} the quote?")
        if head:
            yield row()

    return lines(spark, path, dialect).mapInArrow(run, "path string, start bigint, head binary")


def _ends(surveyed: DataFrame, heads: DataFrame) -> DataFrame:
    """(path, start, inside, rest): of every split that begins or ends inside a field; ``rest``: the lines after it that belong to its last
    record, those of splits that are inside throughout included."""
    throughout = F.col("inside") & (F.col("in_width") == 0)
    rows = surveyed.withColumn("opens", F.when(F.col("inside"), F.col("in_end")).otherwise(F.col("out_end")) & ~throughout)
    rows = rows.where("inside or opens").withColumn("n", F.sum(F.col("opens").cast("int")).over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)))
    pieces = rows.where("inside").select("path", "start", "n").join(heads, ["path", "start"]).groupBy("path", "n").agg(F.array_sort(F.collect_list(F.struct("start", "head"))).alias("parts"))
    opened = rows.where("opens").select("path", "start", (F.coalesce("n", F.lit(0)) + 1).alias("n")).join(pieces, ["path", "n"]).select("path", "start", F.col("parts.head").alias("rest"))
    return rows.select("path", "start", "inside").join(opened, ["path", "start"], "left")


def records(spark: SparkSession, path: str, dialect: Dialect, surveyed: DataFrame, encoding: str, folder) -> DataFrame:
    """(value): the text of each record but every file's first, in the order of the files. ``folder()``: the name of a new one
    that tasks can read."""
    look = _held(spark, _ends(surveyed, _heads(spark, path, dialect, surveyed, folder)).persist(), lambda: folder() + "-ends")
    end = dialect.line_end

    def run(batches):
        scan = dialect.scanner()
        key, rest, inside, skip, first, open_, size = None, None, False, False, False, [], 0

        def text(parts: list[bytes]) -> bytes:
            out = end.join(parts)
            return out[:-1] if out.endswith(b"\r") else out

        def kept(parts: list[bytes]) -> list[bytes]:
            nonlocal first
            out = [text(parts)]
            if first:
                out[0] = out[0].removeprefix(BOM)
            if not out[0].strip():
                return []
            if first:
                first = False
                return []
            return out

        def last() -> list[bytes]:
            if not open_:
                return []
            return kept([*open_, *(rest or [])])

        def batch_of(out: list[bytes]):
            return pa.RecordBatch.from_arrays([pa.array([x.decode(encoding, "replace") for x in out], pa.string())], ["value"])

        for now, part in _splits(batches):
            if now != key:
                if out := last():
                    yield batch_of(out)
                key, found = now, look(now)
                inside, rest = (bool(found[0]), found[1]) if found else (False, None)
                skip, first, open_, size = inside, now[1] == 0, [], 0
            marked = pc.greater(pc.count_substring(part, dialect.quote), 0).to_numpy(zero_copy_only=False)
            out: list[bytes] = []
            for line, quoted in zip(part.to_pylist(), marked, strict=True):
                if quoted:
                    inside, _ = scan(line, inside)
                if skip:
                    skip = inside
                elif inside or open_:
                    open_.append(line)
                    size += len(line)
                    if not inside:
                        out += kept(open_)
                        open_, size = [], 0
                    elif size > RECORD_BYTES:
                        raise ValueError(f"{key[0]}: a quoted field of over {RECORD_BYTES} bytes; is {dialect.quote.decode()} the quote?")
                else:
                    out += kept([line])
            if out:
                yield batch_of(out)
        if out := last():
            yield batch_of(out)

    return lines(spark, path, dialect).mapInArrow(run, "value string")
