"""Profile of a table: missing, distinct and top values, numeric summaries, outliers, roles. A few jobs for any number of columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import quantiles
from ..functions.values import INDEX, col, is_missing, kind, present, to_number, tokens

FENCE, Z_LIMIT, NEAR_CONSTANT = 1.5, 3.0, 0.98
# The names that make a column metadata.
ID_NAMES = ("id", "customerid", "customer_id", "user_id", "client_id", "invoice", "order_id")
TIME_WORDS = ("date", "time", "datetime", "timestamp")


@dataclass
class ColumnProfile:
    name: str
    type: str
    missing: int
    missing_ratio: float
    unique: int
    unique_ratio: float
    top_value: str | None
    top_frequency: int
    constant: bool
    near_constant: bool
    role: str
    suspicious: bool
    reason: str
    numeric: dict = field(default_factory=dict)
    outliers: int = 0
    outlier_ratio: float = 0.0
    low: float | None = None
    high: float | None = None


@dataclass
class Profile:
    rows: int
    columns: int
    missing_cells: int
    duplicates: int
    by_column: list[ColumnProfile]

    def of(self, type_: str) -> list[ColumnProfile]:
        return [c for c in self.by_column if c.type == type_]

    def to_df(self, spark) -> DataFrame:
        return spark.createDataFrame([(c.name, c.type, c.missing, c.missing_ratio, c.unique, c.unique_ratio, c.top_value, c.top_frequency, c.constant, c.near_constant, c.role, c.outliers, c.outlier_ratio) for c in self.by_column], "name string, type string, missing bigint, missing_ratio double, unique bigint, unique_ratio double, top_value string, top_frequency bigint, constant boolean, near_constant boolean, role string, outliers bigint, outlier_ratio double")


def names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != INDEX]


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, n): how often every value of every column occurs, as text; null is a value, NaN counts as null. Equal text is the same
    value, but for times with a zone and nested values, which are told apart by what they are."""
    parts = []
    for c in cols:
        x, t, extra = present(df, c), df.schema[c].dataType, F.lit(None).cast("string")
        if isinstance(t, (T.FloatType, T.DoubleType)):
            x = F.when(x == 0, F.lit(0).cast(t)).otherwise(x)  # -0.0 is 0.0
        elif isinstance(t, T.TimestampType):
            extra = F.unix_micros(x).cast("string")
        elif isinstance(t, T.BinaryType):
            extra = F.hex(x)
        elif isinstance(t, (T.ArrayType, T.StructType, T.MapType)):
            extra = F.to_json(F.struct(x.alias("x")))
        parts.append(F.struct(F.lit(c).alias("column"), x.cast("string").alias("value"), extra.alias("extra")))
    long = df.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
    return long.groupBy("column", "value", "extra").agg(F.count("*").alias("n")).drop("extra")


def by_column(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n_missing, n_unique, rows, top): one count of values gives them all; ``top``: the most frequent value (n negative, value),
    the least of equals, null without any."""
    n, there = F.col("n"), F.col("value").isNotNull()
    some = value_counts(df, cols).groupBy("column").agg(
        F.coalesce(F.sum(F.when(~there, n)), F.lit(0)).alias("n_missing"), F.count_if(there).alias("n_unique"), F.sum("n").alias("rows"), F.min(F.when(there, F.struct((-n).alias("n"), "value"))).alias("top"),
    )
    named = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return named.join(F.broadcast(some), "column", "left").select("column", zero("n_missing"), zero("n_unique"), zero("rows"), "top")  # a row a column


def _shares(found: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return found.select("column", "n_missing", share(F.col("n_missing"), F.col("rows")).alias("missing_ratio"), "n_unique", share(F.col("n_unique"), F.col("rows") - F.col("n_missing")).alias("unique_ratio"), "rows", "top")


def counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, n_missing, missing_ratio, n_unique, unique_ratio)."""
    return _shares(by_column(df, cols or names(df))).drop("rows", "top")


def top_values(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, value, n): the most frequent value as text, the least of equals."""
    return by_column(df, cols or names(df)).where("top is not null").select("column", "top.value", (-F.col("top.n")).alias("n"))


def top_typed(df: DataFrame, c: str):
    """The most frequent value itself, the least of equals; None without any."""
    n = df.select(present(df, c).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    row = n.agg(F.min(F.struct((-F.col("n")).alias("n"), "value"))).first()[0]
    return row and row["value"]


def numeric_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, n, mean, median, std, min, q1, q3, max), missing values left out."""
    found, parts = quantiles(df, cols)[()], []
    for c in cols:
        x, q = to_number(df, c), found[c] or [None] * 3
        at = lambda i, name: F.lit(q[i]).cast("double").alias(name)  # noqa: E731, B023
        parts.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("n"), F.avg(x).alias("mean"), at(1, "median"), F.stddev_samp(x).alias("std"), F.min(x).alias("min"), at(0, "q1"), at(2, "q3"), F.max(x).alias("max")))
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def fences(df: DataFrame, cols: list[str], k: float = FENCE, skip_flat: bool = True, at_least: int = 4) -> dict[str, tuple[float, float]]:
    """Outer limits of columns with ``at_least`` values; ``skip_flat`` leaves out those whose quartiles agree."""
    if not cols:
        return {}
    n = df.agg(*[F.count(to_number(df, c)) for c in cols]).first()
    found = quantiles(df, cols, (0.25, 0.75))[()]
    return {c: (q[0] - k * (q[1] - q[0]), q[1] + k * (q[1] - q[0])) for c, m in zip(cols, n, strict=True) if m >= at_least and (q := found[c]) and (q[1] > q[0] or not skip_flat)}


def outside(df: DataFrame, name: str, limits: tuple[float, float] | None) -> Column:
    """Strictly outside the limits; false for missing values and for columns without limits."""
    if limits is None:
        return F.lit(False)
    x = to_number(df, name)
    return F.coalesce((x < limits[0]) | (x > limits[1]), F.lit(False))


def z_outside(df: DataFrame, name: str, mean: float | None, std: float | None, limit: float = Z_LIMIT) -> Column:
    if not std:
        return F.lit(False)
    return F.coalesce(F.abs((to_number(df, name) - mean) / std) > limit, F.lit(False))


def duplicate_count(df: DataFrame) -> int:
    """Rows that repeat an earlier one in all columns but the index."""
    return df.groupBy(*[col(c) for c in names(df)]).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0))).first()[0]


def text_stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, avg_length, avg_tokens, long_ratio, max_length) of non-missing text; long is 20 characters or more."""
    parts = [F.struct(F.lit(c).alias("column"), F.avg(F.length(s := col(c).cast("string"))).alias("avg_length"), F.avg(tokens(s)).alias("avg_tokens"), F.avg((F.length(s) >= 20).cast("int")).alias("long_ratio"), F.max(F.length(s)).cast("long").alias("max_length")) for c in cols]
    return df.agg(F.array(*parts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def simple_type(physical: str, non_null: int, unique: int, avg_length: float, avg_tokens: float) -> str:
    """Profile rule: any of long, many tokens or mostly distinct makes a text."""
    if physical == "number":
        return "numeric"
    if not non_null:
        return "unknown"
    if physical == "text" and (avg_length >= 25 or avg_tokens >= 4 or unique / non_null >= 0.30):
        return "text"
    return "categorical"


def column_role(name: str, type_: str, non_null: int, unique: int) -> tuple[str, bool, str]:
    """(role, suspicious, reason); the first rule that holds."""
    n = name.strip().lower().replace(" ", "_").replace("-", "_")
    if n == INDEX:
        return "metadata", False, "row index"
    if n in ID_NAMES or n.endswith("_id"):
        return "metadata", False, "identifier name"
    if any(w in n for w in TIME_WORDS):
        return "metadata", False, "date or time name"
    if type_ in ("categorical", "text") and non_null and unique / non_null >= 0.90 and unique >= max(10, non_null // 2):
        return "metadata", True, "almost every value is distinct"
    return "feature", False, "default"


def override_roles(profile: Profile, overrides: dict[str, str]) -> Profile:
    for c in profile.by_column:
        if overrides.get(c.name) in ("feature", "metadata"):
            c.role, c.reason = overrides[c.name], "user override"
    return profile


def profile(df: DataFrame) -> Profile:
    """Everything above in a handful of jobs."""
    cols = names(df)
    by = {r["column"]: r for r in _shares(by_column(df, cols)).collect()}  # a row a column
    top = {c: (r["top"]["value"], -r["top"]["n"]) for c, r in by.items() if r["top"]}
    n = max((r["rows"] for r in by.values()), default=0) if cols else df.count()
    numbers, strings = [c for c in cols if kind(df, c) == "number"], [c for c in cols if kind(df, c) == "text"]
    summary = {r["column"]: r.asDict() for r in numeric_summary(df, numbers).collect()} if numbers else {}
    stats = {r["column"]: r for r in text_stats(df, strings).collect()} if strings else {}
    limits = {c: (s["q1"] - FENCE * (s["q3"] - s["q1"]), s["q3"] + FENCE * (s["q3"] - s["q1"])) for c, s in summary.items() if s["n"] >= 4 and s["q3"] > s["q1"]}
    out = dict(zip(limits, df.agg(*[F.count_if(outside(df, c, limits[c])) for c in limits]).first(), strict=True)) if limits else {}
    done = []
    for c in cols:
        r, there = by[c], n - by[c]["n_missing"]
        s = stats.get(c)
        type_ = simple_type(kind(df, c), there, r["n_unique"], s["avg_length"] or 0 if s else 0, s["avg_tokens"] or 0 if s else 0)
        value, freq = top.get(c, (None, 0))
        role, suspicious, reason = column_role(c, type_, there, r["n_unique"])
        low, high = limits.get(c, (None, None))
        done.append(ColumnProfile(c, type_, r["n_missing"], r["missing_ratio"], r["n_unique"], r["unique_ratio"], value, freq, r["n_unique"] <= 1, n > 0 and freq / n >= NEAR_CONSTANT, role, suspicious, reason, summary.get(c, {}), out.get(c, 0), out.get(c, 0) / n if n else 0.0, low, high))
    return Profile(n, len(df.columns), sum(r["n_missing"] for r in by.values()), duplicate_count(df), done)
