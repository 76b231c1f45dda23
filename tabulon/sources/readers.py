"""Sources: CSV, JSON, Excel and Parquet to DataFrames with tidy, distinct column names."""

from __future__ import annotations

import io
import re
import zipfile
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import records
from ..functions.shared import shared_dir
from ..functions.values import INDEX, NUMBER, col, is_missing, with_index

HEAD = 64 << 10
ALIASES = {"csv": "csv", "txt": "csv", "tsv": "csv", "json": "json", "jsonl": "json", "ndjson": "json", "xlsx": "excel", "excel": "excel", "parquet": "parquet"}
SEPARATORS = (",", ";", "\t", "|")
#: Encodings that are checked over all bytes; others are taken as named.
ENCODINGS = ("utf-8", "utf8", "utf-8-sig", "windows-1252", "cp1252", "latin-1", "iso-8859-1")
ORIENTS = ("records", "columns", "index", "split", "values")
#: What windows-1252 has where ISO-8859-1 has control characters; five bytes stand for nothing there.
_CP1252 = {chr(b): x for b in range(0x80, 0xA0) if (x := bytes([b]).decode("cp1252", "ignore"))}
#: Number formats of workbooks that are dates or times without a code of their own.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


@dataclass(frozen=True)
class Options:
    format: str | None = None
    separator: str | None = None
    encoding: str | None = None
    quote: str = '"'
    escape: str = '"'
    multiline: bool | None = None  # None: where some quoted field holds a line end; False: no field does
    orient: str | None = None  # of JSON; None: records, or columns where one object holds them
    sheet: str | int | None = None
    rows: int | None = None
    drop_empty_rows: bool = False
    allow_empty: bool = False
    index: bool = False


def tidy_names(names: list) -> list[str]:
    """Stripped; blanks become ``unnamed_column_{place}``; repeats get ``__1``, ``__2``, avoiding names that are there."""
    base = [(str(n).strip() if n is not None else "") or f"unnamed_column_{i}" for i, n in enumerate(names)]
    out: list[str] = []
    for n in base:
        new, k = n, 1
        while new in out or (k > 1 and new in base):
            new, k = f"{n}__{k}", k + 1
        out.append(new)
    return out


def _head(spark: SparkSession, path: str, size: int = HEAD) -> bytes:
    """The first bytes of the first file at ``path``, through Hadoop's file systems."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    status = fs.globStatus(at)
    if not status:
        raise FileNotFoundError(path)
    first = status[0]
    while first.isDirectory():
        first = next(s for s in sorted(fs.listStatus(first.getPath()), key=lambda s: s.getPath().getName()) if s.getPath().getName()[0] not in "_.")
    stream = fs.open(first.getPath())
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(size, first.getLen())))
    finally:
        stream.close()


def format_of(path: str, head: bytes, asked: str | None = None) -> str:
    if asked:
        if asked.lower().lstrip(".") not in ALIASES:
            raise ValueError(f"unknown format: {asked}")
        return ALIASES[asked.lower().lstrip(".")]
    end = path.lower().removesuffix(".gz").rpartition(".")[2]
    if end == "xls":
        raise ValueError("old .xls workbooks are not read; save as .xlsx")
    if end in ALIASES:
        return ALIASES[end]
    if head[:4] == b"PAR1":
        return "parquet"
    start = head.lstrip()[:2]
    return "json" if start[:1] in (b"{", b"[") else "excel" if start == b"PK" else "csv"


def separator_of(text: str) -> str:
    """The separator that cuts the first lines into most fields of equal number; a comma if none does."""
    lines = [re.sub(r'"[^"]*"', "", x) for x in text.splitlines()[:20] if x.strip()][: -1 if len(text.splitlines()) > 2 else None]
    best = (0, ",")
    for s in SEPARATORS:
        n = {x.count(s) for x in lines}
        if len(n) == 1 and (k := n.pop()) > best[0]:
            best = (k, s)
    return best[1]


def _csv(spark: SparkSession, path: str, o: Options, head: bytes) -> DataFrame:
    """Encodings and separators are candidates: one pass over all bytes tells whether they read every line as valid characters and with no
    more fields than the header has, else the next is taken. Where no quoted field holds a line end, Spark's reader cuts the lines; else
    records are cut at their true ends (see ``records``), by all tasks alike."""
    enc = (o.encoding or "utf-8").lower().replace("_", "-")
    if enc not in ENCODINGS:
        return _spark_csv(spark, path, o, head, enc, o.separator or separator_of(head.decode(enc, "replace")), o.quote in head.decode(enc, "replace") if o.multiline is None else o.multiline)
    enc = {"utf8": "utf-8", "utf-8-sig": "utf-8", "cp1252": "windows-1252", "iso-8859-1": "latin-1"}.get(enc, enc)
    text = head.decode("utf-8", "replace").removeprefix("\ufeff")
    first = [o.separator] if o.separator else list(dict.fromkeys([separator_of(text), *sorted(SEPARATORS, key=lambda s: s not in text.partition("\n")[0])]))
    best = None
    for sep in first:
        plain = records.Dialect(sep.encode(), o.quote.encode(), o.escape.encode(), b"\r" if b"\r" in head and b"\n" not in head else b"\n")
        surveyed = records.survey(spark, path, plain).persist()
        found = records.told(surveyed)
        taken = enc if enc != "utf-8" or found.utf8 else "windows-1252" if found.cp1252 else "latin-1"
        taken = "latin-1" if taken == "windows-1252" and not found.cp1252 and not found.utf8 else taken
        header = _header(head, taken, sep, o)
        fits = found.width <= len(header) or o.separator is not None
        if fits or best is None:
            if best is not None:
                best[0].unpersist()
            best = (surveyed, found, taken, sep, plain, header)
        else:
            surveyed.unpersist()
        if fits:
            break
    else:
        raise ValueError(f"{path}: lines with more fields than the header has, whichever of {first} parts them")
    surveyed, found, taken, sep, plain, header = best
    try:
        if not (found.breaks if o.multiline is None else o.multiline) or not header:
            return _spark_csv(spark, path, o, head, taken, sep, False, plain.line_end.decode())
        cut = records.records(spark, path, plain, surveyed, taken, lambda: f"{shared_dir(spark)}/inline/{uuid.uuid4().hex}")
    finally:
        surveyed.unpersist()
    reader = lambda: spark.read.options(sep=sep, quote=o.quote, escape=o.escape)
    strings = lambda df: getattr(df._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    wide = spark.createDataFrame([(sep * (len(header) - 1),)], "value string") if len(header) > 1 else cut.limit(0)
    schema = DataFrame(reader().option("inferSchema", True)._jreader.csv(strings(wide.union(cut))), spark).schema if len(header) > 1 or not cut.isEmpty() else T.StructType([T.StructField("_c0", T.StringType())])
    raw = DataFrame(reader().schema(schema)._jreader.csv(strings(cut)), spark)
    return raw.toDF(*tidy_names(header if len(header) == len(raw.columns) else raw.columns))


def _header(head: bytes, enc: str, sep: str, o: Options) -> list[str]:
    import csv

    text = head.decode(enc, "replace").removeprefix("\ufeff").lstrip("\r\n")
    return next(csv.reader(io.StringIO(text, newline=""), delimiter=sep, quotechar=o.quote), [])


def _spark_csv(spark: SparkSession, path: str, o: Options, head: bytes, enc: str, sep: str, multiline: bool, line_end: str | None = None) -> DataFrame:
    header = _header(head, enc, sep, o)
    windows = enc == "windows-1252"
    enc = {"windows-1252": "ISO-8859-1", "latin-1": "ISO-8859-1"}.get(enc, enc)  # of the encodings Spark's reader takes, the one that reads each byte
    raw = spark.read.csv(path, sep=sep, encoding=enc, quote=o.quote, escape=o.escape, header=True, inferSchema=True, multiLine=multiline, **({"lineSep": line_end} if line_end == "\r" else {}))
    if windows:
        before, after = "".join(_CP1252), "".join(_CP1252.values())
        raw = raw.select(*[(F.translate(col(f.name), before, after) if isinstance(f.dataType, T.StringType) else col(f.name)).alias(f.name) for f in raw.schema])
    return raw.toDF(*tidy_names(header if len(header) == len(raw.columns) else raw.columns))


def _oriented(spark: SparkSession, path: str, orient: str) -> DataFrame:
    """JSON documents, one a file, that are not lists of records: their cells are (file, row, column, value) first. Rows follow each other by
    file and place; rows of different files are different whatever their labels. Columns of numbers become longs or doubles."""
    doc = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("f"), F.col("value").alias("doc"))
    if orient in ("columns", "index"):
        outer = doc.select("f", F.posexplode(F.from_json("doc", "map<string,map<string,string>>")).alias("i", "outer", "m"))
        cells = outer.select("f", "i", "outer", F.posexplode("m").alias("j", "inner", "value"))
        c, name, row = ("i", "outer", "inner") if orient == "columns" else ("j", "inner", "outer")
        place = F.col("j" if orient == "columns" else "i")
        cells = cells.select("f", F.col(c).alias("c"), F.col(name).alias("name"), place.alias("r"), F.col(row).alias("row"), "value")
    elif orient == "lists":
        lists = doc.select("f", F.posexplode(F.from_json("doc", "map<string,array<string>>")).alias("c", "name", "m"))
        cells = lists.select("f", "c", "name", F.posexplode("m").alias("r", "value")).withColumn("row", F.col("r").cast("string"))
    else:
        at = F.from_json("doc", "columns array<string>, data array<array<string>>") if orient == "split" else F.struct(F.lit(None).cast("array<string>").alias("columns"), F.from_json("doc", "array<array<string>>").alias("data"))
        rows = doc.select("f", at.alias("x")).select("f", "x.columns", F.posexplode("x.data").alias("r", "cells")).select("f", "columns", "r", F.posexplode("cells").alias("c", "value"))
        cells = rows.select("f", "c", F.coalesce(F.get("columns", "c"), F.col("c").cast("string")).alias("name"), "r", F.col("r").cast("string").alias("row"), "value")
    number = F.col("value").rlike(NUMBER)
    heads = cells.groupBy("name").agg(F.min("c").alias("c"), F.bool_and(number).alias("number"), F.bool_and(F.col("value").rlike(r"^[+-]?\d{1,18}$")).alias("whole")).orderBy("c", "name").collect()  # a row a column
    if not heads:
        raise ValueError(f"{path}: no {orient} in it")
    wide = cells.groupBy("f", "row").pivot("name", [h["name"] for h in heads]).agg(F.first("value"))  # one value a file, row and column
    order = cells.groupBy(F.col("f").alias("_f"), F.col("row").alias("_row")).agg(F.min("r").alias("_r"))
    wide = wide.join(order, (F.col("f") == F.col("_f")) & (F.col("row") == F.col("_row"))).orderBy("_f", "_r", "_row")
    return wide.select(*[col(h["name"]).cast("long" if h["whole"] else "double" if h["number"] else "string").alias(h["name"]) for h in heads])


def _json(spark: SparkSession, path: str, head: bytes, orient: str | None = None) -> DataFrame:
    """Records, one a line or in a list. Without an orient, files that hold one object each whose values are all objects or all lists are
    tables by columns, whatever their rows are called."""
    if orient not in (None, *ORIENTS):
        raise ValueError(f"unknown orient: {orient}")
    if orient not in (None, "records"):
        df = _oriented(spark, path, orient)
        return df.toDF(*tidy_names(df.columns))
    whole = head.lstrip()[:1] == b"["
    df = spark.read.json(path, multiLine=whole)
    if not whole and df.columns == ["_corrupt_record"]:
        df = spark.read.json(path, multiLine=True)
    if orient is None and head.lstrip()[:1] == b"{" and df.columns:
        kinds = {type(f.dataType) for f in df.schema}
        if kinds in ({T.StructType}, {T.ArrayType}) and df.count() == spark.read.format("binaryFile").load(path).select("path").count():
            df = _oriented(spark, path, "columns" if kinds == {T.StructType} else "lists")
    return df.toDF(*tidy_names(df.columns))


def sheets(data: bytes) -> dict[str, list[list]]:
    """Cells of every sheet of an .xlsx workbook: numbers, texts, truth values, and times where a cell's style is one of them."""
    space = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = lambda name: ElementTree.fromstring(z.read(name))
        shared = ["".join(t.text or "" for t in si.iter(f"{{{space['m']}}}t")) for si in root("xl/sharedStrings.xml").findall("m:si", space)] if "xl/sharedStrings.xml" in z.namelist() else []
        target = {r.get("Id"): r.get("Target") for r in root("xl/_rels/workbook.xml.rels")}
        dates = _date_styles(root("xl/styles.xml"), space) if "xl/styles.xml" in z.namelist() else set()
        book = root("xl/workbook.xml").find("m:workbookPr", space)
        day0 = datetime(1904, 1, 1) if book is not None and book.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        out = {}
        for s in root("xl/workbook.xml").find("m:sheets", space):
            rows = []
            for row in root("xl/" + target[s.get(f"{{{space['r']}}}id")].removeprefix("/xl/")).iter(f"{{{space['m']}}}row"):
                cells: list = []
                for c in row.findall("m:c", space):
                    letters, at = re.match(r"[A-Z]*", c.get("r", "")).group(), 0
                    for x in letters:
                        at = at * 26 + ord(x) - 64
                    cells += [None] * (at - 1 - len(cells))
                    v, kind = c.find("m:v", space), c.get("t")
                    raw = v.text if v is not None else None
                    cells.append("".join(t.text or "" for t in c.iter(f"{{{space['m']}}}t")) if kind == "inlineStr" else None if raw is None else shared[int(raw)] if kind == "s" else raw == "1" if kind == "b" else raw if kind in ("str", "e") else day0 + timedelta(milliseconds=round(float(raw) * 86_400_000)) if int(c.get("s", -1)) in dates else float(raw))
                rows.append(cells)
            out[s.get("name")] = rows
    return out


def _date_styles(styles: ElementTree.Element, space: dict) -> set[int]:
    """Places of the cell styles that show dates or times."""
    coded = {int(f.get("numFmtId")) for f in styles.iterfind("m:numFmts/m:numFmt", space) if re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")).lower().replace("general", ""))}
    return {i for i, x in enumerate(styles.iterfind("m:cellXfs/m:xf", space)) if int(x.get("numFmtId", 0)) in _DATE_FORMATS | coded}


def _excel(spark: SparkSession, path: str, o: Options) -> DataFrame:
    """A workbook is one file of a million rows at most a sheet: it is read whole, its rows typed by what their columns hold."""
    found = sheets(bytes(spark.read.format("binaryFile").load(path).first()["content"]))
    if isinstance(o.sheet, str):
        rows = found[o.sheet]
    elif isinstance(o.sheet, int):
        rows = list(found.values())[o.sheet]
    else:
        rows = next((r for r in found.values() if any(any(c is not None for c in x) for x in r)), [])
    if not rows:
        raise ValueError("no sheet has rows")
    width = max(map(len, rows))
    names, body = tidy_names([*rows[0], *[None] * (width - len(rows[0]))]), [[*r, *[None] * (width - len(r))] for r in rows[1:]]
    fields = []
    for i, n in enumerate(names):
        kinds = {type(r[i]) for r in body if r[i] is not None}
        kind = {bool: T.BooleanType(), float: T.DoubleType(), datetime: T.TimestampNTZType()}.get(*kinds, T.StringType()) if len(kinds) == 1 else T.StringType()
        if isinstance(kind, T.DoubleType) and all(r[i] is None or r[i].is_integer() for r in body):
            kind = T.LongType()
        for r in body:
            if r[i] is not None:
                r[i] = int(r[i]) if isinstance(kind, T.LongType) else r[i] if not isinstance(kind, T.StringType) else r[i].isoformat(" ") if isinstance(r[i], datetime) else (f"{r[i]:g}" if isinstance(r[i], float) else str(r[i]))
        fields.append(T.StructField(n, kind))
    return spark.createDataFrame(body, T.StructType(fields))


def stored(spark: SparkSession, data: bytes, format: str) -> str:
    """The path of a new file of the shared folder that holds ``data``, a table small enough to be given by the caller."""
    path = f"{shared_dir(spark)}/inline/{uuid.uuid4().hex}.{format}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()
    return path


def resolved(spark: SparkSession, source, format: str | None = None) -> str:
    """The path of a source: a path, bytes, something to read, or, with a format, text that is no path."""
    ending = {"excel": "xlsx"}.get(kind := ALIASES.get((format or "").lower().lstrip("."), format or ""), kind)
    if hasattr(source, "read"):
        if hasattr(source, "seek"):
            source.seek(0)
        data = source.read()
        return resolved(spark, data.encode() if isinstance(data, str) else data, format or str(getattr(source, "name", "")).rpartition(".")[2] or None)
    if isinstance(source, (bytes, bytearray)):
        return stored(spark, bytes(source), ending or format_of("", bytes(source)))
    if hasattr(source, "__fspath__"):
        source = source.__fspath__()
    if not isinstance(source, str):
        raise TypeError(f"no source of a table: {type(source).__name__}")
    if format:
        if "\n" in source or source.lstrip()[:1] in ("{", "["):
            return stored(spark, source.encode(), ending)
        try:
            _head(spark, source, 1)
        except FileNotFoundError:
            if re.search(r"^[^,;|\t]*\.(" + "|".join(ALIASES) + r")(\.\w+)?$", source.strip(), re.IGNORECASE) or "://" in source:
                raise  # a mistyped path, not a table of one line
            return stored(spark, source.encode(), ending)
    return source


def load(spark: SparkSession, source, options: Options = Options()) -> DataFrame:
    """One table of a path, bytes, a file-like object or, where the format is named, a text. Options left out are read off the file's name
    and first bytes. What is given inline is written to the shared folder first, as Spark reads it later than this call."""
    path = resolved(spark, source, options.format)
    head = _head(spark, path)
    kind = format_of(path, head, options.format)
    if kind == "csv":
        df = _csv(spark, path, options, head)
    elif kind == "json":
        df = _json(spark, path, head, options.orient)
    elif kind == "excel":
        df = _excel(spark, path, options)
    else:
        df = spark.read.parquet(path)
        df = df.toDF(*tidy_names(df.columns))
    if not df.columns:
        raise ValueError(f"{path}: no columns")
    if options.drop_empty_rows:
        df = df.na.drop("all")
    if options.rows is not None:
        df = df.limit(options.rows)
    if not options.allow_empty and df.isEmpty():
        raise ValueError(f"{path}: no rows")
    return with_index(df) if options.index else df


def metadata(df: DataFrame) -> dict:
    row = df.agg(F.count("*"), *[F.count_if(is_missing(df, c)) for c in df.columns]).first()
    return {"rows": row[0], "columns": len(df.columns), "types": {f.name: f.dataType.simpleString() for f in df.schema}, "nulls": dict(zip(df.columns, row[1:], strict=True))}


def preview(df: DataFrame, n: int = 5) -> list[dict]:
    """The first rows as JSON-safe values, in the order of the index where there is one."""
    import json

    df = df.orderBy(INDEX) if INDEX in df.columns else df
    return [json.loads(x) for x in df.select([col(c) for c in df.columns]).limit(n).toJSON().collect()]
