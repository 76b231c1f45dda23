"""ARC to WARC conversion.

An ARC file opens with a version block whose second line names the version (1: five header fields, 2: ten) and whose third line lists the
fields; each record is a header line and exactly the declared number of content bytes. A WARC record is synthesised from it: the id is a
UUID of the ARC file's position-free content (url, date, payload digest), the date is the ARC's fourteen digits as ISO 8601, the digests
are SHA-1, the type is response or, where an equal payload of MIN_REVISIT bytes or more has its response elsewhere, revisit. Files are
gzip members, one a record, as is customary; a record of a file is found again by its offset.

Of equal payloads the record with the largest page id is the response. Null html is an empty payload; null urls are written as ``-``;
smaller payloads are all responses. Pages with the same id are kept apart in the files, and of equal payloads under one id the last one
written is the response, the others revisit the same id. Null page ids are kept: they sort below all others. Empty table: no records."""

from __future__ import annotations

import datetime
import hashlib
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, saved, table
from .files import attempt_path, one_task_each, opened

MIN_REVISIT, FILE_BYTES, LEVEL = 1000, 32 << 20, 1
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
_SPACE = re.compile(r"[\x00-\x20\x7f]")
_DATE = "20200101000000"


def _url(url: str | None) -> str:
    """No blanks or controls, which would break header lines."""
    return _SPACE.sub(lambda m: f"%{ord(m[0]):02X}", url or "-") or "-"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def arc_head(version: int, name: str) -> bytes:
    body = f"{version} 0 tabulon\n{' '.join(FIELDS[version])}\n\n"
    return f"filedesc://{name} 0.0.0.0 {_DATE} text/plain {'200 - - 0 ' + name + ' ' if version == 2 else ''}{len(body)}\n{body}\n".encode()


def arc_record(version: int, key: int | None, url: str | None, payload: bytes, name: str, offset: int, http: bytes = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n") -> bytes:
    """The page id travels as an HTTP header of the archived response."""
    content = http + f"X-Page-Id: {'-' if key is None else key}\r\n\r\n".encode() + payload
    extra = f"200 {hashlib.md5(payload).hexdigest()} - {offset} {name} " if version == 2 else ""
    return f"{_url(url)} 0.0.0.0 {_DATE} text/html {extra}{len(content)}\n".encode() + content + b"\n"


def members(stream, whole: bool = True):
    """(offset, bytes) of each gzip member of a file, read in pieces."""
    at = start = 0
    z, out, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(1 << 20)
        if not data:
            return
        rest = b""
        out.append(z.decompress(data))
        at += len(data)
        if z.eof:
            rest = z.unused_data
            at -= len(rest)
            yield start, b"".join(out)
            z, out, start = zlib.decompressobj(31), [], at


def arc_version(head: bytes) -> int:
    """From a file's first record: the version number at the start of its second line, checked against its third."""
    lines = head.split(b"\n", 3)
    version = int(lines[1].split(b" ", 1)[0])
    if version not in FIELDS or lines[2].decode().split(" ") != list(FIELDS[version]):
        raise ValueError(f"unknown ARC version block: {head[:200]!r}")
    return version


def parse_arc(record: bytes, version: int) -> tuple[dict[str, str], bytes]:
    """(header fields, content) of a record: the last field declares the content's length. A url with blanks keeps them: the other fields count from the end."""
    line, _, rest = record.partition(b"\n")
    values = line.decode("utf-8", "replace").rsplit(" ", len(FIELDS[version]) - 1)
    if len(values) != len(FIELDS[version]):
        raise ValueError(f"ARC header line with {len(values)} fields: {line[:200]!r}")
    head = dict(zip(FIELDS[version], values, strict=True))
    length = int(head["Archive-length"])
    if len(rest) < length:
        raise ValueError(f"ARC record of {length} bytes is cut at {len(rest)}")
    return head, rest[:length]


def split_http(content: bytes) -> tuple[bytes, bytes]:
    head, _, payload = content.partition(b"\r\n\r\n")
    return head, payload


def page_id(http: bytes) -> int | None:
    value = http.rpartition(b"X-Page-Id: ")[2].split(b"\r\n", 1)[0]
    return None if value in (b"-", b"") else int(value)


def b32(sha1_hex: str) -> str:
    import base64

    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def warc_date(archive_date: str) -> str:
    return datetime.datetime.strptime(archive_date.ljust(14, "0"), "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")


def record_id(url: str, archive_date: str, digest: str, page: int | None) -> str:
    """The identifier that a record gets wherever it is converted."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {archive_date} {digest} {page}')}>"


def warc_record(head: dict[str, str], http: bytes, payload: bytes, refers_to: dict | None) -> bytes:
    """A response, or a revisit of the record whose page_id, url and date ``refers_to`` holds."""
    digest, revisit = hashlib.sha1(payload).hexdigest(), refers_to is not None
    block = http + b"\r\n\r\n" + (b"" if revisit else payload)
    lines = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(head['URL'], head['Archive-date'], digest, page_id(http))}", f"WARC-Date: {warc_date(head['Archive-date'])}", f"WARC-Target-URI: {head['URL']}", f"WARC-IP-Address: {head['IP-address']}", f"WARC-Payload-Digest: sha1:{b32(digest)}", f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).hexdigest())}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        page, url, date = (refers_to[k] for k in ("page_id", "url", "date"))
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(url, date, digest, page)}", f"WARC-Refers-To-Target-URI: {url}", f"WARC-Refers-To-Date: {warc_date(date)}", f"X-Refers-To-Page: {'-' if page is None else page}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_warc(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def write_arc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes ARC files of about ``file_bytes``, versions 1 and 2 by turns; returns a row a file: (path, records)."""

    def run(batches):
        out, n, path, count, files = None, 0, None, 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                for key, url, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.large_binary()).to_pylist(), strict=True):
                    if out is None:
                        path, files = attempt_path(folder, f"-{files}.arc.gz"), files + 1
                        out, name, version = opened(path, "w"), path.rpartition("/")[2], 1 + files % 2
                        n, count = out.write(_member(arc_head(version, name))) or 0, 0
                        n = out.tell()
                    out.write(_member(arc_record(version, key, url, html or b"", name, n)))
                    n, count = out.tell(), count + 1
                    if n >= file_bytes:
                        out.close()
                        out = None
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count])], ["path", "records"])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count])], ["path", "records"])

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return saved(rows.mapInArrow(run, "path string, records bigint"), "arc-files")


def index_arc(spark: SparkSession, files: list[str]) -> DataFrame:
    """(path, at, page_id, payload_bytes, digest, url, date) of every record of ARC files; ``at`` is its place in the file."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, version = [], None
                with opened(path, "r") as f:
                    for at, (_, record) in enumerate(members(f)):
                        if version is None:
                            version = arc_version(record)
                            continue
                        head, content = parse_arc(record, version)
                        http, payload = split_http(content)
                        rows.append((path, at, page_id(http), len(payload), hashlib.sha1(payload).hexdigest(), head["URL"], head["Archive-date"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["path", "at", "page_id", "payload_bytes", "digest", "url", "date"])

    return one_task_each(spark, [(p,) for p in files], "path string").mapInArrow(run, "path string, at bigint, page_id bigint, payload_bytes bigint, digest string, url string, date string")


def convert(spark: SparkSession, files: list[str], folder: str, min_revisit: int = MIN_REVISIT) -> list[str]:
    """Converts ARC files to WARC files below ``folder``, one for each; returns their paths."""
    index = saved(index_arc(spark, files), "arc-index")
    place = F.struct(F.coalesce("page_id", F.lit(np.iinfo(np.int64).min)).alias("id"), "path", "at")
    big = index.where(F.col("payload_bytes") >= min_revisit)
    # only payloads that occur again have revisits; each group is reduced before its rows meet it
    first = big.groupBy("digest", "payload_bytes").agg(F.max(place).alias("top"), F.max_by(F.struct("page_id", "url", "date"), place).alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = big.join(first, ["digest", "payload_bytes"]).where((F.col("path") != F.col("top.path")) | (F.col("at") != F.col("top.at"))).select("path", F.col("at"), "refers_to", F.lit(True).alias("is"))
    # a file's revisits, which its own size bounds, go to the one task that converts it
    plan = spark.createDataFrame([(p,) for p in files], "path string").join(revisits, "path", "left").repartition(max(1, len(files)), "path").sortWithinPartitions("path", "at")

    def run(batches):
        held: dict[str, dict[int, dict]] = {}
        done: list[str] = []
        for batch in batches:
            for path, at, refers, is_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = held.setdefault(path, {})
                if is_:
                    own[at] = refers
                for p in [p for p in held if p != path]:
                    done.append(one(p, held.pop(p)))
        for p, own in held.items():
            done.append(one(p, own))
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    def one(path: str, own: dict[int, dict]) -> str:
        to, version = attempt_path(folder, f"-{path.rpartition('/')[2].removesuffix('.arc.gz')}.warc.gz"), None
        with opened(path, "r") as f, opened(to, "w") as out:
            for at, (_, record) in enumerate(members(f)):
                if version is None:
                    version = arc_version(record)
                    continue
                head, content = parse_arc(record, version)
                http, payload = split_http(content)
                out.write(_member(warc_record(head, http, payload, own.get(at))))
        return to

    return [r[0] for r in saved(plan.mapInArrow(run, "path string"), "warc-files").collect()]  # a row a file


def read_warc(spark: SparkSession, files: list[str]) -> DataFrame:
    """A row for each record: ids, target, date, type, the payload of responses, declared digest and length, and what a revisit refers to."""
    schema = "record_id string, page_id bigint, url string, date string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint"
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64())

    def run(batches):
        import base64

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, n = [], 0
                with opened(path, "r") as f:
                    for _, record in members(f):
                        h, block = parse_warc(record)
                        http, payload = split_http(block)
                        digest, revisit = base64.b32decode(h["WARC-Payload-Digest"][5:]).hex(), h["WARC-Type"] == "revisit"
                        if not revisit and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(h["X-Payload-Length"])):
                            raise ValueError(f"{path}: a record does not match its digest")
                        refers = h.get("X-Refers-To-Page")
                        rows.append((h["WARC-Record-ID"], page_id(http), h["WARC-Target-URI"], h["WARC-Date"], h["WARC-Type"], None if revisit else payload, int(h["X-Payload-Length"]), digest, int(refers) if refers not in (None, "-") else None))
                        n += len(record)
                        if n > 4 << 20:
                            yield batch_of(rows)
                            rows, n = [], 0
                if rows:
                    yield batch_of(rows)

    return one_task_each(spark, [(p,) for p in files], "path string").mapInArrow(run, schema)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    arcs = [r[0] for r in write_arc(table(spark, sf_dir, "pages"), new_path(spark, "arc")).collect()]  # a row a file
    records = read_warc(spark, convert(spark, arcs, new_path(spark, "warc")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), s AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM s)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN payload_bytes >= {MIN_REVISIT} AND page_id < top THEN top END AS refers_to FROM g"""
