"""Cleaning: recommended plan, its impact, and its execution with an audit trail; missing-value and outlier stages."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles
from ..functions.values import INDEX, col, is_missing, kind, mark_repeats, present, to_number, with_index
from .profile import Profile, fences, names, outside, simple_type, text_stats, top_typed, z_outside
from .schema import resolve


@dataclass(frozen=True)
class Plan:
    missing_numeric: str = "mean"
    missing_categorical: str = "mode"
    missing_text: str = "empty"
    duplicates: str = "drop"
    outliers: str = "keep"
    encoding: str = "onehot"
    scaling: str = "standard"
    text: str = "ignore"
    drop_constant: bool = True


def recommend(p: Profile) -> Plan:
    categorical, odd, gone = p.of("categorical"), any(c.outliers for c in p.by_column), p.missing_cells
    share = gone / max(1, p.rows * max(1, p.columns))
    return Plan(
        missing_numeric="drop_rows" if 0 < share <= 0.01 else "median" if odd else "mean", missing_categorical="mode" if gone <= max(1, 0.01 * p.rows) else "unknown", missing_text="empty",
        duplicates="drop", outliers="cap_iqr" if odd else "keep", encoding="ordinal" if any(c.unique > 100 for c in categorical) else "onehot", scaling="robust" if odd else "standard", text="use" if p.of("text") else "ignore", drop_constant=True,
    )


def groups(df: DataFrame) -> dict[str, list[str]]:
    """Columns by profile type."""
    cols = names(df)
    strings = [c for c in cols if kind(df, c) == "text"]
    row = df.agg(*[F.struct(F.count(present(df, c)).alias("n"), F.count_distinct(present(df, c)).alias("u")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    stats = {r["column"]: r for r in text_stats(df, strings).collect()} if strings else {}
    out: dict[str, list[str]] = {"numeric": [], "categorical": [], "text": [], "unknown": []}
    for c, (n, u) in zip(cols, row, strict=True):
        s = stats.get(c)
        out[simple_type(kind(df, c), n, u, s["avg_length"] or 0 if s else 0, s["avg_tokens"] or 0 if s else 0)].append(c)
    return out


def fill_values(df: DataFrame, how: dict[str, str]) -> dict[str, object]:
    """Values that fill missing cells: mean, median, zero, mode, unknown or empty for each column named."""
    of = lambda h: [c for c in how if how[c] == h]
    found = dict(zip(of("mean"), df.agg(*[F.avg(to_number(df, c)) for c in of("mean")]).first(), strict=True)) if of("mean") else {}
    if of("median"):
        found |= {c: q and q[0] for c, q in quantiles(df, of("median"), (0.5,))[()].items()}
    found |= {c: top_typed(df, c) for c in of("mode")}
    return {c: found[c] if c in found else {"zero": 0, "unknown": "unknown", "empty": ""}[h] for c, h in how.items()}


def filled(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Numbers become doubles where a fraction is filled in; text stays text, numbers filled into it included."""
    as_text = lambda c, v: kind(df, c) == "text" and not isinstance(v, str)
    return df.withColumns({c: F.coalesce(present(df, c), F.lit(str(v) if as_text(c, v) else v)) for c, v in values.items() if v is not None})


def z_limits(df: DataFrame, cols: list[str]) -> dict[str, tuple]:
    row = df.agg(*[F.struct(F.avg(x := to_number(df, c)), F.stddev_samp(x)) for c in cols]).first() if cols else ()
    return {c: tuple(r) for c, r in zip(cols, row, strict=True)}


def impact(df: DataFrame, plan: Plan) -> dict[str, int]:
    """Dry run on the table as it is: cells that would be filled, rows that would go, cells that would be capped."""
    df = with_index(df)
    g = groups(df)
    hows = {"numeric": plan.missing_numeric, "categorical": plan.missing_categorical, "text": plan.missing_text}
    lost = [c for t, h in hows.items() if h == "drop_rows" for c in g[t]]
    fill = [c for t, h in hows.items() if h not in ("drop_rows", "keep") for c in g[t]]
    limits, z = fences(df, g["numeric"]), z_limits(df, g["numeric"]) if plan.outliers == "drop_zscore" else {}
    any_of = lambda xs: F.coalesce(*[F.when(x, True) for x in xs], F.lit(False)) if xs else F.lit(False)
    marks = {"missing_value": any_of([is_missing(df, c) for c in lost])}
    if plan.outliers == "drop_iqr":
        marks["outlier"] = any_of([outside(df, c, x) for c, x in limits.items()])
    if plan.outliers == "drop_zscore":
        marks["outlier"] = any_of([z_outside(df, c, *x) for c, x in z.items()])
    work = mark_repeats(df, "_dup") if plan.duplicates == "drop" else df.withColumn("_dup", F.lit(False))
    total = lambda xs: sum((x.cast("long") for x in xs), F.lit(0).cast("long"))
    row = work.agg(
        F.count("*").alias("rows"), F.count_if("_dup").alias("duplicates"), F.count_if(marks["missing_value"]).alias("missing_rows"), F.coalesce(F.sum(total([is_missing(df, c) for c in fill])), F.lit(0)).alias("filled"),
        F.coalesce(F.sum(total([outside(df, c, x) for c, x in limits.items()])), F.lit(0)).alias("outliers"), F.count_if(any_of([F.col("_dup"), *marks.values()])).alias("removed"),
    ).first()
    return row.asDict()


@dataclass
class Cleaned:
    table: DataFrame
    removed: DataFrame
    report: dict


def capped(df: DataFrame, name: str, low: float, high: float) -> DataFrame:
    x = to_number(df, name)
    return df.withColumn(name, F.when(x < low, low).when(x > high, high).otherwise(x))


def apply_plan(df: DataFrame, plan: Plan) -> Cleaned:
    """Duplicates, fills, outliers, constant columns, then the rows marked go: all in one projection over one pass of marks. Statistics
    include rows that are marked, as deleting comes last, so they are computed without the join that finds repeats. Removed rows keep their
    original values and say why and in which columns."""
    df = with_index(df)
    actions: list[dict] = []
    original = df.columns
    work = mark_repeats(df, "_dup") if plan.duplicates == "drop" else df.withColumn("_dup", F.lit(False))
    work = work.withColumn("_was", F.struct(*[col(c) for c in original])).withColumn("_why", F.array().cast("array<struct<reason:string,column:string>>"))

    def mark(now: DataFrame, when: Column, reason: str, column: str = "") -> DataFrame:
        return now.withColumn("_why", F.when(when, F.array_append("_why", F.struct(F.lit(reason).alias("reason"), F.lit(column).alias("column")))).otherwise(F.col("_why")))

    if plan.duplicates == "drop":
        work = mark(work, F.col("_dup"), "duplicate_row")
        actions.append({"action": "drop_row", "reason": "duplicate_row"})
    work = work.drop("_dup")
    g = groups(df)
    how = {"numeric": plan.missing_numeric, "categorical": plan.missing_categorical, "text": plan.missing_text}
    lost = [c for t, h in how.items() if h == "drop_rows" for c in g[t]]
    for c in lost:
        work = mark(work, is_missing(df, c), "missing_value", c)
    if lost:
        actions.append({"action": "drop_row", "reason": "missing_value", "columns": lost})
    values = fill_values(df, {c: h for t, h in how.items() if h not in ("drop_rows", "keep") for c in g[t]})
    work, plain = filled(work, values), filled(df, values)  # plain: the same cells without the marks
    actions += [{"action": "fill", "column": c, "value": v} for c, v in values.items()]
    if plan.outliers.endswith("iqr"):
        limits = fences(plain, g["numeric"])  # of the filled columns
        for c, (low, high) in limits.items():
            if plan.outliers == "cap_iqr":
                work, plain = capped(work, c, low, high), capped(plain, c, low, high)
            else:
                work = mark(work, outside(work, c, (low, high)), "outlier_iqr", c)
        actions.append({"action": plan.outliers, "limits": limits})
    if plan.outliers == "drop_zscore":
        for c, (m, s) in z_limits(plain, g["numeric"]).items():
            work = mark(work, z_outside(work, c, m, s), "outlier_zscore", c)
        actions.append({"action": "drop_zscore"})
    gone = set(g["categorical"] if plan.encoding == "drop" else ()) | set(g["text"] if plan.text == "drop" else ())
    if plan.drop_constant:
        cols = names(df)
        gone |= {c for c, u in zip(cols, plain.agg(*[F.count_distinct(present(plain, c)) for c in cols]).first(), strict=True) if u <= 1}
    work = work.drop(*gone)
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(xs)), "; ")
    where = joined(F.filter(F.col("_why")["column"], lambda x: x != "")).alias("affected_column")
    removed = work.where(F.size("_why") > 0).select("_was", joined(F.col("_why")["reason"]).alias("reason"), F.lit("drop_row").alias("action"), where).select(f"_was.{INDEX}", "reason", "action", "affected_column", *[col("_was").getField(c).alias(c) for c in original if c != INDEX])
    table = work.where(F.size("_why") == 0).drop("_was", "_why")
    before, after = work.agg(F.count("*"), F.count_if(F.size("_why") == 0)).first()
    report = {"created_at": datetime.now().isoformat(timespec="seconds"), "initial_rows": before, "final_rows": after, "removed_row_count": before - after, "dropped_columns": sorted(gone), "actions": actions, "plan": plan.__dict__}
    return Cleaned(table, removed, report)


# Other names of strategies, with blanks as underscores.
MISSING_ALIASES = {
    "average": "mean", "avg": "mean", "most_frequent": "mode", "drop": "drop_rows", "0": "zero", "": "empty", "zero_fill": "zero", "unknown_fill": "unknown", "unknown_token": "unknown",
    "empty_string": "empty", "empty_string_fill": "empty",
}
ALLOWED = {"numeric": {"mean", "median", "zero", "drop_rows"}, "categorical": {"mode", "unknown", "drop_rows"}, "text": {"empty", "unknown", "drop_rows"}, "unknown": {"unknown", "drop_rows"}}
DEFAULTS = {"numeric": ("mean", "drop_rows"), "categorical": ("mode", "unknown"), "text": ("empty", "unknown"), "unknown": ("drop_rows", "drop_rows")}


@dataclass(frozen=True)
class MissingConfig:
    strategies: dict[str, str] = field(default_factory=dict)  # by type
    overrides: dict[str, str] = field(default_factory=dict)  # by column
    auto: bool = True
    preview_only: bool = False
    confirm: Callable[[list[dict]], bool] | None = None


def missing_strategy(type_: str, asked: str | None, all_null: bool) -> str:
    first, fallback = DEFAULTS[type_]
    s = (asked or first).strip().lower().replace(" ", "_")
    s = MISSING_ALIASES.get(s, s)
    if s not in ALLOWED[type_]:
        s = fallback if fallback in ALLOWED[type_] else "drop_rows"
    return fallback if all_null and s in ("mean", "median", "mode") else s


def missing_report(df: DataFrame, types, config: MissingConfig = MissingConfig()) -> list[dict]:
    """A record for each column with missing values: count, ratio, strategy and the value it would fill in. ``types``: a schema in any form
    (``schema.resolve``); a column that it lacks counts as unknown."""
    types = resolve(df, types, "unknown").types
    cols = names(df)
    row = df.agg(F.count("*").alias("n"), *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    out = []
    for i, c in enumerate(cols):
        if m := row[i + 1]:
            s = missing_strategy(types[c], config.overrides.get(c, config.strategies.get(types[c])), m == row[0])
            out.append({"column": c, "type": types[c], "missing": m, "ratio": m / row[0], "strategy": s})
    values = fill_values(df, {r["column"]: r["strategy"] for r in out if r["strategy"] != "drop_rows"})
    return [r | {"value": values.get(r["column"])} for r in out]


def confirmed(config, report: list[dict]) -> str:
    """preview_only, not_required, approved, rejected, auto or awaiting."""
    if config.preview_only:
        return "preview_only"
    if not report:
        return "not_required"
    if config.confirm is not None:
        return "approved" if config.confirm(report) else "rejected"
    return "auto" if config.auto else "awaiting"


def handle_missing(df: DataFrame, types, config: MissingConfig = MissingConfig()) -> tuple[DataFrame, list[dict], str]:
    """Rows go first, then cells are filled with values computed before that."""
    report = missing_report(df, types, config)
    state = confirmed(config, report)
    if state in ("approved", "auto"):
        if lost := [r["column"] for r in report if r["strategy"] == "drop_rows"]:
            df = df.where(~F.coalesce(*[F.when(is_missing(df, c), True) for c in lost], F.lit(False)))
        df = filled(df, {r["column"]: r["value"] for r in report if r["strategy"] != "drop_rows"})
    return df, report, state


# Fixed values, as above.
OUTLIER_ALIASES = {"winsorize": "cap", "winsorization": "cap", "clip": "cap", "remove": "drop", "drop_rows": "drop", "flag": "group", "outlier_group": "group", "keep": "ignore", "none": "ignore", "skip": "ignore"}


@dataclass(frozen=True)
class OutlierConfig:
    strategy: str = "cap"
    overrides: dict[str, str] = field(default_factory=dict)
    k: float = 1.5
    at_least: int = 4
    flag: str = "outlier_flag"
    auto: bool = True
    preview_only: bool = False
    confirm: Callable[[list[dict]], bool] | None = None


def numeric_columns(df: DataFrame, schema) -> list[str]:
    """The columns that an outlier stage judges: those of type numeric in ``schema``, or ``schema`` itself if it is a list of names."""
    if isinstance(schema, (list, tuple)) and all(isinstance(c, str) for c in schema):
        if gone := [c for c in schema if c not in df.columns]:
            raise ValueError(f"no such columns: {gone}")
        return list(schema)
    return [c for c, t in resolve(df, schema, "ignore").types.items() if t == "numeric"]


def outlier_report(df: DataFrame, cols, config: OutlierConfig = OutlierConfig()) -> list[dict]:
    """Quartiles, limits, counts and strategy of each column that is read as numbers (names, or the numeric ones of a schema in any form);
    here equal quartiles are judged too. Columns with fewer than ``at_least`` numbers are skipped and say so."""
    cols = numeric_columns(df, cols)
    if not cols:
        return []
    found = quantiles(df, cols, (0.25, 0.75))[()]
    limits = {c: (q[0] - config.k * (q[1] - q[0]), q[1] + config.k * (q[1] - q[0])) if (q := found[c]) else None for c in cols}
    row = df.agg(F.count("*"), *[F.count_if(outside(df, c, limits[c])) for c in cols], *[F.count(to_number(df, c)) for c in cols]).first()
    out = []
    for i, c in enumerate(cols):
        s = config.overrides.get(c, config.strategy).strip().lower().replace(" ", "_")
        s = OUTLIER_ALIASES.get(s, s)
        n, there = row[1 + i], row[1 + len(cols) + i]
        if there < config.at_least:
            out.append({"column": c, "low": None, "high": None, "q1": None, "q3": None, "iqr": None, "present": there, "outliers": 0, "ratio": 0.0, "ratio_present": 0.0, "strategy": "ignore", "status": "skipped"})
            continue
        (q1, q3), (low, high) = found[c], limits[c]
        s = s if s in ("cap", "drop", "group", "ignore") else "ignore"
        out.append({"column": c, "low": low, "high": high, "q1": q1, "q3": q3, "iqr": q3 - q1, "present": there, "outliers": n, "ratio": n / row[0] if row[0] else 0.0, "ratio_present": n / there if there else 0.0, "strategy": s, "status": "pending" if n else "no_outliers"})
    return out


def outlier_totals(df: DataFrame, report: list[dict]) -> dict[str, int]:
    """Outlying cells, and rows with one or more of them."""
    return {"outliers": sum(r["outliers"] for r in report), "affected_rows": df.agg(F.count_if(affected(df, report))).first()[0]}


def outlier_sample(df: DataFrame, record: dict, n: int = 5) -> DataFrame:
    """The first ``n`` outlying rows of a record's column, by the index where there is one."""
    rows = df.where(affected(df, [record]))
    return (rows.orderBy(INDEX) if INDEX in df.columns else rows).limit(n)


def by_strategy(report: list[dict]) -> dict[str, dict[str, list[str]]]:
    """{type: {strategy: columns in order of name}} of a report; outliers are all of type numeric. Columns without anything to do are left out."""
    out: dict[str, dict[str, list[str]]] = {}
    for r in sorted(report, key=lambda r: r["column"]):
        if r.get("missing") or r.get("outliers"):
            out.setdefault(r.get("type", "numeric"), {}).setdefault(r["strategy"], []).append(r["column"])
    return out


def affected(df: DataFrame, report: list[dict]) -> Column:
    marks = [F.when(outside(df, r["column"], (r["low"], r["high"])), True) for r in report if r["low"] is not None]
    return F.coalesce(*marks, F.lit(False)) if marks else F.lit(False)


def handle_outliers(df: DataFrame, cols, config: OutlierConfig = OutlierConfig()) -> tuple[DataFrame, list[dict], str]:
    """Flag, then cap, then drop, with the limits of the report."""
    report = [r for r in outlier_report(df, cols, config) if r["outliers"]]
    state = confirmed(config, report)
    if state not in ("approved", "auto"):
        return df, report, state
    by = lambda s: [r for r in report if r["strategy"] == s]
    out = df
    if by("group"):
        name, k = config.flag, 1
        while name in df.columns:
            name, k = f"{config.flag}__{k}", k + 1
        out = out.withColumn(name, affected(df, by("group")))
    for r in by("cap"):
        out = capped(out, r["column"], r["low"], r["high"])
    return (out.where(~affected(out, by("drop"))) if by("drop") else out), report, state
