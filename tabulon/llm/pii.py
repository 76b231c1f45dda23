"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) are kept whenever their own rule holds. The scored kinds add to them: ``iban`` (its country's length, mod-97) and
``phone_local`` (a national number, kept only where a context word stands nearby). Null or empty text: no spans. Offsets are code
points, end exclusive. Every search is linear in the text's length, so very long runs of one class cost no more than prose."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, table, texts

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "phone_local")
#: Scores start here, by kind, and a checksum or a context word within CONTEXT code points before the span raises them.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.3, "phone_local": 0.2}
CHECKED, NEARBY, THRESHOLD, CONTEXT = 0.4, 0.4, 0.55, 40
WORDS = {
    "email": ("mail", "contact", "correo", "courriel"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "carte", "tarjeta", "karte"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "tél", "anruf"), "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"), "phone_local": ("tel", "phone", "call", "fax", "mobile", "tél", "anruf"),
}
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: At each start, as far as an IBAN could reach; LENGTHS or mod-97 say where it ends.
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}))")
_GOES_ON = re.compile(r"[A-Za-z0-9]")
#: Characters of an IBAN by country.
LENGTHS = {
    x[:2]: int(x[2:]) for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 "
        "LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
_LOCAL_PHONE = re.compile(r"(?<![0-9+.])0[0-9]{1,4}[\x20/-][0-9](?:[\x20-]?[0-9]){4,9}(?![0-9])")
_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(x)] for x in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064: the first four characters go to the end, letters count 10 to 35, the rest modulo 97 is 1."""
    flat = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, not overlapping: from each ``@``, back over the local part (not before the last match), forward over the domain."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def ibans(text: str) -> list[tuple[int, int]]:
    """Leftmost, not overlapping, right by mod-97: as long as the country code prescribes; for other codes the longest that ends a group."""
    out, done = [], 0
    for m in _IBAN.finditer(text):
        if m.start() < done:
            continue
        ends = [i for i, c in enumerate(m[1], m.start() + 1) if c != " "]
        n = LENGTHS.get(m[1][:2])
        for end in ends[n - 1 : n] if n else ends[:13:-1]:
            if not _GOES_ON.match(text, end) and mod97(text[m.start() : end]):
                out.append((m.start(), end))
                done = end
                break
    return out


def _near(kind: str, text: str, start: int) -> bool:
    before = text[max(0, start - CONTEXT) : start].lower()
    return any(w in before for w in WORDS[kind])


def find(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score), by kind as in KINDS, then start."""
    raw: list[tuple[str, int, int, bool]] = []
    if "@" in text:
        raw += [("email", a, b, False) for a, b in emails(text)]
    raw += [("ip", m.start(), m.end(), False) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d):
            raw.append(("card", m.start(), m.end(), True))
    if "+" in text:
        raw += [("phone", m.start(), m.end(), False) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m[0])) <= 15]
    raw += [("iban", a, b, True) for a, b in ibans(text)]
    raw += [("phone_local", m.start(), m.end(), False) for m in _LOCAL_PHONE.finditer(text)]
    out = []
    for kind, a, b, checked in raw:
        score = PRIOR[kind] + CHECKED * checked + NEARBY * _near(kind, text, a)
        if kind in BASE or score >= THRESHOLD:
            out.append((kind, a, b, round(min(score, 1.0), 3)))
    return out


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans: array of kind, start, end, score), a row for each row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in find(x)] for x in texts(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, item)], ["id", "spans"])

    out = arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    return out.withColumnRenamed("id", id_col)


def redact(text: str | None) -> str | None:
    """``text`` with every span, overlaps merged, replaced by its first kind in angle brackets. Null stays null."""
    if not text:
        return text
    spans = sorted((a, b, k) for k, a, b, _ in find(text))
    if not spans:
        return text
    out, at = [], 0
    runs: list[list] = []
    for a, b, k in spans:
        if runs and a < runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b, k])
    for a, b, k in runs:
        out += [text[at:a], f"<{k}>"]
        at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced; ``length_col``, where there is one, follows the new text. Same columns and rows,
    whatever the names of the others: columns travel by place."""
    fields = docs.schema
    at, n = docs.columns.index(text_col), len(fields)

    def run(batches):
        for batch in batches:
            yield batch.append_column(f"c{n}", pa.array([redact(x) for x in batch.column(at).to_pylist()], pa.string()))

    ddl = [f"c{i} {'string' if i == at else f.dataType.simpleString()}" for i, f in enumerate(fields)]
    safe = docs.toDF(*[f"c{i}" for i in range(n)]).withColumn(f"c{at}", F.col(f"c{at}").cast("string"))
    out = safe.mapInArrow(run, ", ".join([*ddl, f"c{n} string"]))
    old, new = F.col(f"c{at}"), F.col(f"c{n}")
    size = lambda i, f: F.when(new != old, F.length(new).cast(f.dataType)).otherwise(F.col(f"c{i}"))
    return out.select(*[(new if i == at else size(i, f) if f.name == length_col else F.col(f"c{i}")).alias(f.name) for i, f in enumerate(fields)])


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Digest of ``detect`` over whole ``documents``."""
    found = detect(table(spark, sf_dir, "documents"))
    own = lambda k: F.filter("spans", lambda s: s["kind"] == k)
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", *[F.size(own(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(said(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"),
    )
