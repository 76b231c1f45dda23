"""Features of a table: scalers, encoders, and the map from source columns to features. Fitted states are small; applying them is one projection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..functions.values import INDEX, present, to_number, with_index
from .schema import resolve

MAX_LEVELS = 100
# Names of scalers and encoders, without regard to case.
SCALERS = {"standard": "standard", "standardscaler": "standard", "minmax": "minmax", "minmaxscaler": "minmax", "robust": "robust", "robustscaler": "robust", "none": "none"}
ENCODERS = {"onehot": "onehot", "one_hot": "onehot", "label": "ordinal", "ordinal": "ordinal", "labelencoder": "ordinal"}


def scaler_name(name: str) -> str:
    if (found := SCALERS.get(name.strip().lower().replace("-", ""))) is None:
        raise ValueError(f"unknown scaler: {name}")
    return found


def encoder_name(name: str) -> str:
    if (found := ENCODERS.get(name.strip().lower().replace("-", "_"))) is None:
        raise ValueError(f"unknown encoder: {name}")
    return found


@dataclass(frozen=True)
class Scaled:
    column: str
    method: str
    centre: float
    width: float

    def of(self, df: DataFrame) -> Column:
        return (to_number(df, self.column) - self.centre) / self.width


@dataclass(frozen=True)
class Encoded:
    column: str
    method: str  # onehot or ordinal
    levels: tuple[str, ...] = ()
    asked: str | None = None  # the method asked for, where that had too many levels

    def outputs(self) -> list[str]:
        return [f"{self.column}_{v}" for v in self.levels] if self.method == "onehot" else [self.column]


@dataclass
class FeatureMap:
    numeric: list[Scaled] = field(default_factory=list)
    categorical: list[Encoded] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    skipped: dict[str, str] = field(default_factory=dict)  # column: reason
    types: dict[str, str] = field(default_factory=dict)  # of all columns
    warnings: list[str] = field(default_factory=list)

    def names(self) -> list[str]:
        return [s.column for s in self.numeric] + [n for e in self.categorical for n in e.outputs()]

    def describe(self) -> dict[str, dict]:
        """What became of each source column: its type, transformation, processor with its fitted state, and the features it gave."""
        out = {s.column: {"source_type": "numeric", "transformation": "scaled", "processor": s.method, "state": {"centre": s.centre, "scale": s.width}, "output_features": [s.column], "skipped": False} for s in self.numeric}
        for e in self.categorical:  # levels of a coded column may be too many for the driver: they stay a table (``ordinal_levels``)
            out[e.column] = {"source_type": "categorical", "transformation": "encoded", "processor": e.method, "categories": list(e.levels), "fallback": e.asked is not None, "output_features": e.outputs(), "skipped": False}
        for c in self.text:
            out[c] = {"source_type": "text", "transformation": "passthrough", "processor": None, "output_features": [], "skipped": False}
        for c, why in self.skipped.items():
            out[c] = {"source_type": self.types.get(c, "unknown"), "transformation": "skipped", "processor": None, "output_features": [], "skipped": True, "error": why}
        return out

    def groups(self) -> dict[str, list[str]]:
        return {"numeric": sorted(s.column for s in self.numeric), "categorical": sorted(e.column for e in self.categorical), "text": list(self.text), "skipped": list(self.skipped)}

    def provenance(self, spark) -> DataFrame:
        """(place, feature, source, source_type, processor, level, centre, scale) of each place of the feature array."""
        rows = [(s.column, s.column, "numeric", s.method, None, float(s.centre), float(s.width)) for s in self.numeric]
        for e in self.categorical:
            rows += [(n, e.column, "categorical", e.method, v, None, None) for n, v in zip(e.outputs(), e.levels or (None,), strict=True)] if e.outputs() else []
        return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "place int, feature string, source string, source_type string, processor string, level string, centre double, scale double")

    def text_columns(self, df: DataFrame) -> tuple[list[str], list[str]]:
        """(columns of the text payload ``df`` to embed, warnings): the declared ones first, in their order; those that ``df`` lacks are left out
        and others that it has are taken as text, each with a warning. The row index is no text."""
        there = [c for c in df.columns if c != INDEX]
        gone, more = [c for c in self.text if c not in there], [c for c in there if c not in self.text]
        told = ([f"declared text columns are missing: {gone}"] if gone else []) + ([f"columns not declared as text are taken as text: {more}"] if more and self.text else [])
        return [c for c in self.text if c in there] + more, told


def fit_scalers(df: DataFrame, cols: list[str], method: str = "standard", overrides: dict[str, str] | None = None) -> tuple[list[Scaled], dict[str, str]]:
    """(scalers, columns skipped and why). Population deviation; constant columns scale to 0; a missing or unreadable value skips its column."""
    if not cols:
        return [], {}
    how = {c: scaler_name((overrides or {}).get(c, method)) for c in cols}
    x = {c: to_number(df, c) for c in cols}
    rows = dict(zip(cols, df.agg(*[F.struct(F.count_if(v.isNull()), F.avg(v), F.stddev_pop(v), F.min(v), F.max(v)) for v in x.values()]).first(), strict=True))
    skipped = {c: "missing or unreadable values" for c, r in rows.items() if r[0] or r[1] is None}
    robust = [c for c in cols if how[c] == "robust" and c not in skipped]
    q = quantiles(df.select(*[x[c].alias(c) for c in robust]), robust)[()] if robust else {}
    out = []
    for c, (_, mean, std, low, high) in rows.items():
        if c in skipped:
            continue
        centre, width = {"standard": lambda: (mean, std), "minmax": lambda: (low, high - low), "robust": lambda: (q[c][1], q[c][2] - q[c][0]), "none": lambda: (0.0, 1.0)}[how[c]]()  # noqa: B023
        flat = how[c] in ("standard", "minmax") and high == low
        out.append(Scaled(c, how[c], low if flat else centre, 1.0 if flat else width or 1.0))
    return out, skipped


def fit_encoders(df: DataFrame, cols: list[str], method: str = "onehot", overrides: dict[str, str] | None = None, max_levels: int = MAX_LEVELS) -> list[Encoded]:
    """Levels in alphabetical order. A column of more than ``max_levels`` falls back to ordinal codes."""
    if not cols:
        return []
    text = {c: present(df, c).cast("string") for c in cols}
    sizes = dict(zip(cols, df.agg(*[F.count_distinct(t) for t in text.values()]).first(), strict=True))
    asked = {c: encoder_name((overrides or {}).get(c, method)) for c in cols}
    how = {c: "ordinal" if sizes[c] > max_levels else m for c, m in asked.items()}
    few = [c for c in cols if how[c] == "onehot"]
    levels: dict[str, list[str]] = {c: [] for c in cols}
    if few:  # max_levels values a column at most
        for r in df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("c"), text[c].alias("v")) for c in few])).alias("x")).select("x.*").where("v is not null").distinct().collect():
            levels[r["c"]].append(r["v"])
    return [Encoded(c, how[c], tuple(sorted(levels[c])), None if how[c] == asked[c] else asked[c]) for c in cols]


def one_hot(df: DataFrame, e: Encoded) -> list[Column]:
    """A 0/1 column a level; missing values are 0 everywhere."""
    text = present(df, e.column).cast("string")
    return [F.coalesce((text == v).cast("int"), F.lit(0)).alias(n) for v, n in zip(e.levels, e.outputs(), strict=True)]


def with_ordinal(df: DataFrame, c: str, to: str, levels: DataFrame | None = None) -> DataFrame:
    """``df`` with alphabetical codes from 0 in ``to``; missing or unknown is -1. Any number of levels: codes come by a join, and the
    levels are numbered by their ranges."""
    if levels is None:
        levels = ordinal_levels(df, c)
    return df.withColumn("_level", present(df, c).cast("string")).join(levels.select(F.col("level").alias("_level"), F.col("code").alias(to)), "_level", "left").drop("_level").withColumn(to, F.coalesce(to, F.lit(-1)).cast("long"))


def ordinal_levels(df: DataFrame, c: str) -> DataFrame:
    """(level, code): levels sorted over all tasks by sampled ranges, whatever they begin with."""
    levels = df.select(present(df, c).cast("string").alias("level")).where("level is not null").distinct()
    return with_index(levels.orderBy("level")).select("level", F.col(INDEX).alias("code"))


def fit(df: DataFrame, types, scaler: str = "standard", encoder: str = "onehot", scalers: dict[str, str] | None = None, encoders: dict[str, str] | None = None, text: bool = True, max_levels: int = MAX_LEVELS, infer: bool = True) -> FeatureMap:
    """``types``: a schema in any form (``schema.resolve``). Columns that it lacks are inferred, or skipped without ``infer``."""
    typed = resolve(df, types, "infer" if infer else "ignore")
    of = lambda t: [c for c in df.columns if typed.types.get(c) == t]
    numeric, skipped = fit_scalers(df, of("numeric"), scaler, scalers)
    told = typed.warnings + [f"column {c!r} was skipped: {why}" for c, why in skipped.items()]
    skipped |= {c: f"type {typed.types.get(c, 'unknown')}" for c in df.columns if typed.types.get(c) not in ("numeric", "categorical", "text")}
    encoded = fit_encoders(df, of("categorical"), encoder, encoders, max_levels)
    told += [f"column {e.column!r} has more than {max_levels} levels and is coded" for e in encoded if e.asked]
    return FeatureMap(numeric, encoded, of("text") if text else [], skipped, typed.types, told)


def apply(df: DataFrame, fm: FeatureMap, to: str = "features") -> DataFrame:
    """``df`` with the array ``to``: scaled numbers, then encoded categories. Text columns stay as they are."""
    parts: list[Column] = [s.of(df) for s in fm.numeric]
    ordinal = [e for e in fm.categorical if e.method == "ordinal"]
    for i, e in enumerate(ordinal):
        df = with_ordinal(df, e.column, f"_code{i}")
    for e in fm.categorical:
        parts += one_hot(df, e) if e.method == "onehot" else [F.col(f"_code{ordinal.index(e)}")]
    return df.withColumn(to, F.array(*[p.cast("double") for p in parts]) if parts else F.array().cast("array<double>")).drop(*[f"_code{i}" for i in range(len(ordinal))])
