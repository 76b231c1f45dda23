"""Semantic column types with confidence: numeric, categorical, text or unknown."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import INDEX, NUMBER, col, kind, present, strip, to_time, tokens

TYPES = ("numeric", "categorical", "text", "unknown")
PARSED, TEXT_SCORE, LONG = 0.95, 0.55, 20
#: From which average length, average words, share of long values and share of distinct values a column looks like text, and what each counts.
TEXT_SIGNS = ((25.0, 0.35), (3.0, 0.25), (0.30, 0.20), (0.30, 0.20))
#: Average length, average words and share of distinct values from which a column that no schema types is text (all three).
LIKE_TEXT = (25.0, 3.0, 0.30)


@dataclass(frozen=True)
class ColumnType:
    name: str
    type: str
    confidence: float
    missing: int
    missing_ratio: float
    unique: int
    unique_ratio: float
    metrics: dict
    samples: list


def parse_ratio(df: DataFrame, c: str, what: str = "number") -> Column:
    """Share of non-blank values that read as a number (commas dropped) or a time. 0 without any."""
    s = strip(col(c).cast("string"))
    ok = F.replace(s, F.lit(","), F.lit("")).rlike(NUMBER) if what == "number" else to_time(s).isNotNull()
    n = F.count_if((s != "") & present(df, c).isNotNull())
    return F.when(n > 0, F.count_if(ok & (s != "")) / n).otherwise(0.0)


def text_score(avg_length: float, avg_tokens: float, long_ratio: float, unique_ratio: float) -> float:
    """Weight of the signs of text that are there."""
    return sum(w for x, (least, w) in zip((avg_length, avg_tokens, long_ratio, unique_ratio), TEXT_SIGNS, strict=True) if x >= least)


def categorical_confidence(unique: int, unique_ratio: float, avg_length: float, avg_tokens: float) -> float:
    return round(0.30 + 0.35 * (unique_ratio <= 0.05) + 0.20 * (unique <= 50) + 0.10 * (avg_length < 25) + 0.05 * (avg_tokens < 3), 2)


def decide(physical: str, present_: int, unique: int, unique_ratio: float, m: dict) -> tuple[str, float]:
    if not present_:
        return "unknown", 0.0
    if physical == "boolean":
        return "categorical", 0.99
    if physical == "number":
        return "numeric", 0.99
    if physical == "time":
        return "categorical", 0.90
    if m["numeric_ratio"] >= PARSED:
        return "numeric", m["numeric_ratio"]
    if m["time_ratio"] >= PARSED:
        return "categorical", m["time_ratio"]
    score = text_score(m["avg_length"], m["avg_tokens"], m["long_ratio"], unique_ratio)
    if score >= TEXT_SCORE:
        return "text", round(min(1.0, score), 4)
    return "categorical", categorical_confidence(unique, unique_ratio, m["avg_length"], m["avg_tokens"])


def detect(df: DataFrame, samples: int = 5) -> list[ColumnType]:
    """All columns in one aggregate over all rows."""
    cols = [c for c in df.columns if c != INDEX]
    parts = []
    for c in cols:
        s = strip(present(df, c).cast("string"))
        value = F.when(s != "", s)
        own = [F.count_if(present(df, c).isNull()).alias("missing"), F.count_distinct(present(df, c)).alias("unique") if kind(df, c) != "other" else F.count_distinct(s).alias("unique")]
        if kind(df, c) in ("text", "other"):
            own += [F.avg(F.length(value)).alias("avg_length"), F.avg(tokens(value)).alias("avg_tokens"), F.avg((F.length(value) >= LONG).cast("int")).alias("long_ratio"), F.max(F.length(value)).alias("max_length"), parse_ratio(df, c).alias("numeric_ratio"), parse_ratio(df, c, "time").alias("time_ratio")]
        parts.append(F.struct(*own))
    row = df.agg(F.count("*"), *parts).first()
    heads = df.select(*[present(df, c).cast("string") for c in cols]).limit(50).collect()
    out = []
    for i, c in enumerate(cols):
        m = {k: (v or 0) for k, v in row[i + 1].asDict().items()}
        n, missing, unique = row[0], m.pop("missing"), m.pop("unique")
        share = unique / (n - missing) if n > missing else 0.0
        type_, sure = decide(kind(df, c), n - missing, unique, share, m)
        out.append(ColumnType(c, type_, sure, missing, missing / n if n else 0.0, unique, share, m, [r[i] for r in heads if r[i] is not None][:samples]))
    return out


def types(found: list[ColumnType]) -> dict[str, str]:
    return {c.name: c.type for c in found}


def type_distribution(found: list[ColumnType]) -> dict[str, int]:
    return {t: sum(c.type == t for c in found) for t in TYPES}


# Schemas that were made elsewhere


@dataclass
class Typed:
    """Types of a table's columns as a schema tells them, with what else it tells and what was odd about it."""

    types: dict[str, str]
    confidence: dict[str, float] = field(default_factory=dict)
    samples: dict[str, list] = field(default_factory=dict)
    inferred: list[str] = field(default_factory=list)  # columns that the schema lacks
    warnings: list[str] = field(default_factory=list)


def _read(entry, key: str, default=None):
    return entry.get(key, default) if isinstance(entry, Mapping) else getattr(entry, key, default)


def entries(schema, warnings: list[str]) -> list[tuple[str, str, dict]]:
    """(name, type, metadata) of a schema in any form: what ``detect`` gave, a mapping of names to types, or a list of entries, bare or as
    ``columns`` of a mapping or an object. An entry is an object or a mapping with a name and an ``inferred_type`` or ``type``; one without a
    name is left out with a warning. Anything else raises."""
    if isinstance(schema, DataFrame):
        raise TypeError("a schema is expected, not a table")
    if isinstance(schema, Mapping) and "columns" not in schema and all(isinstance(t, str) for t in schema.values()):
        return [(str(n), t, {}) for n, t in schema.items()]
    found = schema if isinstance(schema, (list, tuple)) else _read(schema, "columns")
    if isinstance(found, (str, bytes)) or not hasattr(found, "__iter__"):
        raise TypeError("a schema needs a collection of columns")
    out = []
    for e in found:
        name = _read(e, "name")
        if name is None or isinstance(e, str):
            warnings.append("a schema entry without a name was left out")
            continue
        told = dict(_read(e, "metadata") or {})
        if isinstance(e, ColumnType):
            told |= {"confidence": e.confidence, "samples": e.samples}
        out.append((str(name), str(_read(e, "inferred_type", _read(e, "type", "unknown"))), told))
    if not out:
        raise ValueError("the schema has no usable column")
    return out


def fallback_types(df: DataFrame, cols: list[str]) -> dict[str, str]:
    """Types of columns that no schema names, by one aggregate over all rows: numbers are numeric; truth values and times are categorical;
    other values are text if long, of several words and mostly distinct, else categorical; nothing but nulls is unknown."""
    plain = {"number": "numeric", "boolean": "categorical", "time": "categorical"}
    out = {c: plain.get(kind(df, c), "") for c in cols}
    if open_ := [c for c in cols if not out[c]]:
        parts = []
        for c in open_:
            s = strip(col(c).cast("string"))
            parts.append(F.struct(F.count(s), F.avg(F.length(s)), F.avg(tokens(s)), F.count_distinct(s)))
        for c, (n, length, words, unique) in zip(open_, df.agg(*parts).first(), strict=True):
            out[c] = ("text" if all(x >= least for x, least in zip((length, words, unique / n), LIKE_TEXT, strict=True)) else "categorical") if n else "unknown"
    return out


def resolve(df: DataFrame, schema, missing: str = "infer") -> Typed:
    """The types of ``df``'s columns by ``schema`` (see ``entries``). Columns that it lacks are inferred, ``unknown`` or left out, as ``missing``
    (infer, unknown, ignore) says; types it may not have become unknown; its columns that ``df`` lacks are named in a warning. The row index is
    no column here. Of two entries of a name the last counts."""
    if not isinstance(df, DataFrame):
        raise TypeError(f"a DataFrame is expected, not {type(df).__name__}")
    if missing not in ("infer", "unknown", "ignore"):
        raise ValueError(f"unknown treatment of missing columns: {missing}")
    if not df.columns:
        raise ValueError("the table has no columns")
    out, there = Typed({}), [c for c in df.columns if c != INDEX]
    for name, type_, told in entries(schema, out.warnings):
        t = type_.strip().lower()
        if t not in TYPES:
            out.warnings.append(f"column {name!r} has the unsupported type {type_!r} and is unknown")
            t = "unknown"
        if name not in df.columns:
            out.warnings.append(f"schema column {name!r} is not in the table")
            continue
        out.types[name] = t
        for key, held in (("confidence", out.confidence), ("samples", out.samples)):
            if (x := told.get(key, told.get(f"inference_{key}"))) is not None:
                held[name] = x
    lacking = [c for c in there if c not in out.types]
    if lacking and missing != "ignore":
        found = fallback_types(df, lacking) if missing == "infer" else dict.fromkeys(lacking, "unknown")
        out.types |= found
        out.inferred = lacking
        out.warnings += [f"column {c!r} is not in the schema and counts as {t}" for c, t in found.items()]
    return out
