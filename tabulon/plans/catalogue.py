"""Registered queries: each applies an operator to a whole table, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import INDEX, is_missing
from ..operators import charts, cleaning, clustering, embedding, features, latent, profile, schema
from . import pipeline as run_plan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *cols: str, digits: int = 5) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


def gappy_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with a value missing in every seventh and a type in every eleventh; the id is the row index."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias(INDEX), "user_id", F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))


GAPPY = f"(SELECT event_id AS {INDEX}, user_id, CASE WHEN event_id % 11 <> 0 THEN event_type END AS event_type, CASE WHEN event_id % 7 <> 0 THEN value END AS value FROM events)"
Q = "quantile_cont(value, {})"
BOUNDS = "(SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM events)"
MODE = "(SELECT event_type FROM {} WHERE event_type IS NOT NULL GROUP BY ALL ORDER BY count(*) DESC, event_type LIMIT 1)"


def _per_column(table_: str, cols: list[str], one: str) -> str:
    return " UNION ALL ".join(f"SELECT {one.format(c=c)} FROM {table_}" for c in cols)


# Profile

LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(_per_column("lineitem", LINE, "'{c}' AS \"column\", count({c})::BIGINT AS n, round(avg({c}), 5) AS mean, round(median({c}), 5) AS median, round(stddev_samp({c}), 5) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 5) AS q1, round(quantile_cont({c}, 0.75), 5) AS q3, max({c}) AS max"))
def profile_numeric(spark, sf_dir):
    return rounded(profile.numeric_summary(table(spark, sf_dir, "lineitem"), LINE), "mean", "median", "std", "q1", "q3")


@query(_per_column(GAPPY, ["user_id", "event_type", "value"], "'{c}' AS \"column\", count_if({c} IS NULL)::BIGINT AS n_missing, round(count_if({c} IS NULL) / count(*), 5) AS missing_ratio, count(DISTINCT {c})::BIGINT AS n_unique, round(count(DISTINCT {c}) / count({c}), 5) AS unique_ratio"))
def missing_and_distinct(spark, sf_dir):
    return rounded(profile.counts(gappy_events(spark, sf_dir)), "missing_ratio", "unique_ratio")


@query(f"SELECT count(*)::BIGINT AS rows, (count_if(event_type IS NULL) + count_if(value IS NULL))::BIGINT AS missing_cells FROM {GAPPY}")
def total_missing(spark, sf_dir):
    df = gappy_events(spark, sf_dir)
    return df.agg(F.count("*").alias("rows"), sum((F.count_if(is_missing(df, c)) for c in profile.names(df)), F.lit(0)).alias("missing_cells"))


@query("SELECT * FROM (" + _per_column("orders", ["o_orderstatus", "o_orderpriority", "o_custkey"], "'{c}' AS \"column\", {c}::VARCHAR AS value, count(*)::BIGINT AS n").replace(" FROM orders", " FROM orders GROUP BY ALL") + ') QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) = 1')
def top_value(spark, sf_dir):
    return profile.top_values(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query("""SELECT 'one' AS "column", TRUE AS constant, TRUE AS near_constant UNION ALL SELECT 'most', FALSE, count_if(event_id % 100 <> 0) / count(*) >= 0.98 FROM events UNION ALL SELECT 'event_type', count(DISTINCT event_type) <= 1, (SELECT max(n) FROM (SELECT count(*) AS n FROM events GROUP BY event_type)) / count(*) >= 0.98 FROM events""")
def near_constant(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.lit("x").alias("one"), F.when(F.col("event_id") % 100 == 0, "b").otherwise("a").alias("most"), "event_type")
    n = e.count()
    distinct = profile.counts(e).select("column", (F.col("n_unique") <= 1).alias("constant"))
    return profile.top_values(e).select("column", (F.col("n") / n >= profile.NEAR_CONSTANT).alias("near_constant")).join(distinct, "column")


@query("SELECT (count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem)))::BIGINT AS n_duplicates FROM lineitem")
def duplicate_rows(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")
    return spark.createDataFrame([(profile.duplicate_count(df),)], "n_duplicates bigint")


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) = 1")
def drop_duplicates(spark, sf_dir):
    from ..functions.values import mark_repeats

    df = table(spark, sf_dir, "documents").select(F.col("doc_id").alias(INDEX), "text", "lang")
    return mark_repeats(df, "again").where("not again").select(F.col(INDEX).alias("doc_id"))


TEXTS = ["text", "lang", "source"]


@query(_per_column("documents", TEXTS, "'{c}' AS \"column\", round(avg(length({c})), 5) AS avg_length, round(avg(len(regexp_extract_all({c}, '[^\\s]+'))), 5) AS avg_tokens, round(avg(CASE WHEN length({c}) >= 20 THEN 1.0 ELSE 0.0 END), 5) AS long_ratio, max(length({c}))::BIGINT AS max_length"))
def text_stats(spark, sf_dir):
    return rounded(profile.text_stats(table(spark, sf_dir, "documents"), TEXTS), "avg_length", "avg_tokens", "long_ratio")


_ROLE = "SELECT '{c}' AS \"column\", '{t}' AS type, CASE WHEN {named} THEN 'metadata' WHEN '{t}' <> 'numeric' AND u / n >= 0.9 AND u >= greatest(10, n // 2) THEN 'metadata' ELSE 'feature' END AS role FROM (SELECT count({c}) AS n, count(DISTINCT {c}) AS u FROM documents)"


@query(" UNION ALL ".join(_ROLE.format(c=c, t=t, named=n) for c, t, n in (("doc_id", "numeric", "TRUE"), ("text", "text", "FALSE"), ("lang", "categorical", "FALSE"), ("source", "categorical", "FALSE"), ("n_chars", "numeric", "FALSE"))))
def column_roles(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    strings = {r["column"]: r for r in profile.text_stats(df, TEXTS).collect()}
    rows = []
    for r in profile.counts(df).select("*", (F.col("n_unique") / F.when(F.col("unique_ratio") > 0, F.col("unique_ratio")).otherwise(1.0)).alias("n")).collect():
        s, n = strings.get(r["column"]), round(r["n"])
        type_ = profile.simple_type("text" if s else "number", n, r["n_unique"], s["avg_length"] if s else 0, s["avg_tokens"] if s else 0)
        rows.append((r["column"], type_, profile.column_role(r["column"], type_, n, r["n_unique"])[0]))
    return spark.createDataFrame(rows, '`column` string, type string, role string')


_TIMES = "['%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y-%m-%d', '%Y/%m/%d', '%d/%m/%Y', '%m/%d/%Y', '%d.%m.%Y']"
_MEASURED = """SELECT '{c}' AS c, count(*) - count(v) AS missing, count(DISTINCT v) AS u, count(DISTINCT v) / count(v) AS share, avg(length(v)) AS len, avg(len(regexp_extract_all(v, '[^\\s]+'))) AS words, avg((length(v) >= 20)::INT) AS long,
avg(regexp_matches(replace(v, ',', ''), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')::INT) AS num, avg((try_strptime(v, """ + _TIMES + """) IS NOT NULL)::INT) AS tim FROM (SELECT trim({c}) AS v FROM documents)"""
_TYPED = f"""WITH m AS ({" UNION ALL ".join(_MEASURED.format(c=c) for c in TEXTS)}), s AS (SELECT *, 0.35 * (len >= 25)::INT + 0.25 * (words >= 3)::INT + 0.2 * (long >= 0.3)::INT + 0.2 * (share >= 0.3)::INT AS score,
0.3 + 0.35 * (share <= 0.05)::INT + 0.2 * (u <= 50)::INT + 0.1 * (len < 25)::INT + 0.05 * (words < 3)::INT AS plain FROM m)
SELECT c AS "column", CASE WHEN num >= 0.95 THEN 'numeric' WHEN tim >= 0.95 THEN 'categorical' WHEN score >= 0.55 THEN 'text' ELSE 'categorical' END AS type,
round(CASE WHEN num >= 0.95 THEN num WHEN tim >= 0.95 THEN tim WHEN score >= 0.55 THEN score ELSE plain END, 4)::DOUBLE AS confidence, missing::BIGINT AS missing, u::BIGINT AS n_unique FROM s"""


@query(_TYPED + " UNION ALL " + _per_column("documents", ["doc_id", "n_chars"], "'{c}', 'numeric', 0.99::DOUBLE, (count(*) - count({c}))::BIGINT, count(DISTINCT {c})::BIGINT"))
def semantic_types(spark, sf_dir):
    found = schema.detect(table(spark, sf_dir, "documents"))
    return spark.createDataFrame([(c.name, c.type, float(c.confidence), c.missing, c.unique) for c in found], "`column` string, type string, confidence double, missing bigint, n_unique bigint")


_LACKING = """SELECT '{c}' AS "column", CASE WHEN avg(length(trim({c}))) >= 25 AND avg(len(regexp_extract_all({c}, '[^\\s]+'))) >= 3 AND count(DISTINCT trim({c})) / count({c}) >= 0.3 THEN 'text' ELSE 'categorical' END AS type, TRUE AS inferred FROM documents"""


@query(" UNION ALL ".join(_LACKING.format(c=c) for c in TEXTS) + " UNION ALL SELECT 'n_chars', 'numeric', TRUE UNION ALL SELECT 'doc_id', 'unknown', FALSE")
def untyped_columns(spark, sf_dir):
    """A schema that types one column, and that wrongly: the others are inferred."""
    found = schema.resolve(table(spark, sf_dir, "documents"), {"columns": [{"name": "doc_id", "inferred_type": "identifier"}]})
    return spark.createDataFrame([(c, t, c in found.inferred) for c, t in found.types.items()], "`column` string, type string, inferred boolean")


@query("""SELECT 'props' AS "column", 0.0 AS number_ratio, 0.0 AS time_ratio UNION ALL SELECT 'as_text', avg(CASE WHEN try_cast(v AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END), 0.0 FROM (SELECT CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE value::VARCHAR END AS v FROM events) UNION ALL SELECT 'day', 0.0, 1.0""")
def parse_ratios(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("props", F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("as_text"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    row = e.agg(F.array(*[F.struct(F.lit(c).alias("column"), schema.parse_ratio(e, c).alias("number_ratio"), schema.parse_ratio(e, c, "time").alias("time_ratio")) for c in e.columns]).alias("s"))
    return row.select(F.explode("s").alias("s")).select("s.*")


# Outliers

@query(f"SELECT round(low, 5) AS low, round(high, 5) AS high FROM {BOUNDS}")
def iqr_bounds(spark, sf_dir):
    limits = profile.fences(table(spark, sf_dir, "events"), ["value"])
    return rounded(spark.createDataFrame(list(limits.values()), "low double, high double"), "low", "high")


@query(f"SELECT event_id, value FROM events, {BOUNDS} WHERE value < low OR value > high")
def iqr_outliers(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return df.where(profile.outside(df, "value", profile.fences(df, ["value"]).get("value"))).select("event_id", "value")


@query("SELECT event_id, value FROM events, (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events) WHERE abs(value - m) / s > 3")
def zscore_outliers(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return df.where(profile.z_outside(df, "value", *cleaning.z_limits(df, ["value"])["value"])).select("event_id", "value")


_REPORT = "SELECT '{c}' AS \"column\", round(low, 5) AS low, round(high, 5) AS high, count_if({c} < low OR {c} > high)::BIGINT AS outliers, round(count_if({c} < low OR {c} > high) / count(*), 5) AS ratio FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3, q1 - 0.5 * (q3 - q1) AS low, q3 + 0.5 * (q3 - q1) AS high FROM lineitem) GROUP BY low, high"


@query(" UNION ALL ".join(_REPORT.format(c=c) for c in LINE))
def outlier_report(spark, sf_dir):
    found = cleaning.outlier_report(table(spark, sf_dir, "lineitem"), LINE, cleaning.OutlierConfig(k=0.5))
    return rounded(spark.createDataFrame([(r["column"], r["low"], r["high"], r["outliers"], r["ratio"]) for r in found], "`column` string, low double, high double, outliers bigint, ratio double"), "low", "high", "ratio")


def text_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with values as text, of which every fifth does not read as a number and every seventh is missing."""
    e, at = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select("event_id", F.when(at % 7 != 0, F.when(at % 5 == 0, "n/a").otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))).alias("value"))


TEXT_EVENTS = "(SELECT event_id, value, event_id % 7 = 0 AS gone, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN value END AS v FROM events)"
TEXT_BOUNDS = f"(SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM {TEXT_EVENTS})"


@query(f"SELECT 'value' AS \"column\", round(q1, 5) AS q1, round(q3, 5) AS q3, round(low, 5) AS low, round(high, 5) AS high, count(v)::BIGINT AS present, count_if(v < low OR v > high)::BIGINT AS outliers, count_if(v < low OR v > high)::BIGINT AS affected_rows FROM {TEXT_EVENTS}, {TEXT_BOUNDS} GROUP BY q1, q3, low, high")
def outlier_report_text(spark, sf_dir):
    df = text_events(spark, sf_dir)
    found = cleaning.outlier_report(df, ["value"])
    rows = [(r["column"], r["q1"], r["q3"], r["low"], r["high"], r["present"], r["outliers"], cleaning.outlier_totals(df, [r])["affected_rows"]) for r in found]
    return rounded(spark.createDataFrame(rows, "`column` string, q1 double, q3 double, low double, high double, present bigint, outliers bigint, affected_rows bigint"), "q1", "q3", "low", "high")


@query(f"SELECT event_id, v AS value FROM {TEXT_EVENTS}, {TEXT_BOUNDS} WHERE v < low OR v > high ORDER BY event_id LIMIT 5")
def outlier_sample(spark, sf_dir):
    df = text_events(spark, sf_dir).withColumnRenamed("event_id", INDEX)
    return cleaning.outlier_sample(df, cleaning.outlier_report(df, ["value"])[0]).select(F.col(INDEX).alias("event_id"), F.trim("value").cast("double").alias("value"))


@query(f"SELECT event_id, value < low OR value > high AS outlier_flag FROM events, {BOUNDS}")
def outlier_flag(spark, sf_dir):
    return cleaning.handle_outliers(table(spark, sf_dir, "events"), ["value"], cleaning.OutlierConfig("group"))[0].select("event_id", "outlier_flag")


@query(f"SELECT event_id, round(least(greatest(value, low), high), 5) AS value FROM events, {BOUNDS}")
def cap_iqr(spark, sf_dir):
    return rounded(cleaning.handle_outliers(table(spark, sf_dir, "events"), ["value"], cleaning.OutlierConfig("cap"))[0].select("event_id", "value"), "value")


@query(f"SELECT event_id, value FROM events, {BOUNDS} WHERE value BETWEEN low AND high")
def drop_iqr(spark, sf_dir):
    return cleaning.handle_outliers(table(spark, sf_dir, "events"), ["value"], cleaning.OutlierConfig("drop"))[0].select("event_id", "value")


@query(f"SELECT {INDEX}, value FROM {GAPPY} g, (SELECT avg(v) AS m, stddev_samp(v) AS s FROM (SELECT coalesce(value, (SELECT avg(value) FROM {GAPPY})) AS v FROM {GAPPY})) WHERE g.value IS NOT NULL AND abs(value - m) / s <= 3")
def drop_zscore(spark, sf_dir):
    df = gappy_events(spark, sf_dir).select(INDEX, "user_id", "value")
    plan = cleaning.Plan(outliers="drop_zscore", duplicates="keep", drop_constant=False)
    return cleaning.apply_plan(df, plan).table.join(df.where("value is not null").select(INDEX), INDEX).select(INDEX, "value")


# Missing values

def _impute(name: str, column: str, how: str, sql: str) -> None:
    def run(spark, sf_dir):
        df = gappy_events(spark, sf_dir)
        out = cleaning.filled(df, cleaning.fill_values(df, {column: how})).select(INDEX, column)
        return rounded(out, column) if column == "value" else out

    QUERIES[name], SQL[name] = run, f"SELECT {INDEX}, {'round(' if column == 'value' else ''}coalesce({column}, {sql}){', 5)' if column == 'value' else ''} AS {column} FROM {GAPPY}"


_impute("impute_mean", "value", "mean", f"(SELECT avg(value) FROM {GAPPY})")
_impute("impute_median", "value", "median", f"(SELECT median(value) FROM {GAPPY})")
_impute("impute_zero", "value", "zero", "0")
_impute("impute_mode", "event_type", "mode", MODE.format(GAPPY))
_impute("impute_unknown", "event_type", "unknown", "'unknown'")
_impute("impute_empty", "event_type", "empty", "''")


@query(f"SELECT event_id, CASE WHEN gone THEN round((SELECT avg(v) FROM {TEXT_EVENTS}), 5) ELSE v END AS value FROM {TEXT_EVENTS}")
def impute_mean_text(spark, sf_dir):
    out = cleaning.handle_missing(text_events(spark, sf_dir), {"value": "numeric"})[0]
    return out.select("event_id", F.when(out["value"] != "n/a", F.round(F.trim("value").cast("double"), 5)).alias("value"))


_TYPES = {"value": "numeric", "event_type": "categorical"}


@query(f"SELECT {INDEX}, value, event_type FROM {GAPPY} WHERE value IS NOT NULL AND event_type IS NOT NULL")
def drop_missing_rows(spark, sf_dir):
    config = cleaning.MissingConfig({"numeric": "drop", "categorical": "drop"})
    return cleaning.handle_missing(gappy_events(spark, sf_dir), _TYPES, config)[0].select(INDEX, "value", "event_type")


@query(f"SELECT {INDEX}, round(coalesce(value, (SELECT median(value) FROM {GAPPY})), 5) AS value, event_type FROM {GAPPY} WHERE event_type IS NOT NULL")
def drop_then_fill(spark, sf_dir):
    config = cleaning.MissingConfig({"numeric": "median", "categorical": "drop_rows"})
    return rounded(cleaning.handle_missing(gappy_events(spark, sf_dir), _TYPES, config)[0].select(INDEX, "value", "event_type"), "value")


@query(f"SELECT 'value' AS \"column\", 'numeric' AS type, count_if(value IS NULL)::BIGINT AS missing, 'mean' AS strategy FROM {GAPPY} UNION ALL SELECT 'event_type', 'categorical', count_if(event_type IS NULL)::BIGINT, 'mode' FROM {GAPPY}")
def missing_report(spark, sf_dir):
    found = cleaning.missing_report(gappy_events(spark, sf_dir), _TYPES)
    return spark.createDataFrame([(r["column"], r["type"], r["missing"], r["strategy"]) for r in found], "`column` string, type string, missing bigint, strategy string")


@query(f"SELECT 'value' AS \"column\", 'numeric' AS type, count_if(value IS NULL)::BIGINT AS missing, 'median' AS strategy FROM {GAPPY} UNION ALL SELECT 'event_type', 'unknown', count_if(event_type IS NULL)::BIGINT, 'drop_rows' FROM {GAPPY}")
def missing_report_untyped(spark, sf_dir):
    """A column that the schema lacks counts as unknown, so its rows would go."""
    found = cleaning.missing_report(gappy_events(spark, sf_dir), [{"name": "value", "type": "Numeric "}], cleaning.MissingConfig(strategies={"numeric": "median"}))
    return spark.createDataFrame([(r["column"], r["type"], r["missing"], r["strategy"]) for r in found], "`column` string, type string, missing bigint, strategy string")


# Plans

def repeated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few distinct rows, with missing values and a constant column."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias(INDEX), "event_type", F.when(F.col("event_id") % 7 != 0, F.round(F.col("value"), 0)).alias("value"), F.lit("EU").alias("region"))


REPEATED = f"(SELECT event_id AS {INDEX}, event_type, CASE WHEN event_id % 7 <> 0 THEN round(value, 0) END AS value, 'EU' AS region FROM events)"
_PLAN = cleaning.Plan(missing_numeric="median", outliers="drop_iqr")
_MARKED = f"""WITH r AS {REPEATED}, f AS (SELECT *, row_number() OVER (PARTITION BY event_type, value ORDER BY {INDEX}) > 1 AS dup, coalesce(value, (SELECT median(value) FROM r)) AS v FROM r),
b AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM f), m AS (SELECT f.*, v < low OR v > high AS odd FROM f, b)"""


@query(f"{_MARKED} SELECT {INDEX}, event_type, v AS value FROM m WHERE NOT dup AND NOT odd")
def apply_plan(spark, sf_dir):
    return cleaning.apply_plan(repeated_events(spark, sf_dir), _PLAN).table.select(INDEX, "event_type", "value")


@query(f"{_MARKED} SELECT {INDEX}, CASE WHEN dup AND odd THEN 'duplicate_row; outlier_iqr' WHEN dup THEN 'duplicate_row' ELSE 'outlier_iqr' END AS reason, 'drop_row' AS action, event_type, value, region FROM m WHERE dup OR odd")
def removed_rows_audit(spark, sf_dir):
    return cleaning.apply_plan(repeated_events(spark, sf_dir), _PLAN).removed.select(INDEX, "reason", "action", "event_type", "value", "region")


_REASONS = cleaning.Plan(missing_numeric="drop_rows", outliers="drop_iqr")


@query(f"""WITH r AS {REPEATED}, b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM r),
m AS (SELECT r.*, row_number() OVER (PARTITION BY event_type, value ORDER BY {INDEX}) > 1 AS dup, value IS NULL AS gone, coalesce(value < low OR value > high, FALSE) AS odd FROM r, b)
SELECT {INDEX}, concat_ws('; ', CASE WHEN dup THEN 'duplicate_row' END, CASE WHEN gone THEN 'missing_value' END, CASE WHEN odd THEN 'outlier_iqr' END) AS reason, CASE WHEN gone OR odd THEN 'value' ELSE '' END AS affected_column FROM m WHERE dup OR gone OR odd""")
def affected_columns(spark, sf_dir):
    return cleaning.apply_plan(repeated_events(spark, sf_dir), _REASONS).removed.select(INDEX, "reason", "affected_column")


@query(f"""{_MARKED} SELECT count(*)::BIGINT AS initial_rows, count_if(NOT dup AND NOT odd)::BIGINT AS final_rows, count_if(dup OR odd)::BIGINT AS removed_row_count FROM m""")
def cleaning_report(spark, sf_dir):
    report = cleaning.apply_plan(repeated_events(spark, sf_dir), _PLAN).report
    return spark.createDataFrame([tuple(report[k] for k in ("initial_rows", "final_rows", "removed_row_count"))], "initial_rows bigint, final_rows bigint, removed_row_count bigint")


@query(f"""WITH r AS {REPEATED}, b AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM r),
m AS (SELECT *, row_number() OVER (PARTITION BY event_type, value ORDER BY {INDEX}) > 1 AS dup, coalesce(value < low OR value > high, FALSE) AS odd FROM r, b)
SELECT count(*)::BIGINT AS rows, count_if(dup)::BIGINT AS duplicates, count_if(value IS NULL)::BIGINT AS filled, count_if(odd)::BIGINT AS outliers, count_if(dup OR odd)::BIGINT AS removed FROM m""")
def cleaning_impact(spark, sf_dir):
    found = cleaning.impact(repeated_events(spark, sf_dir), _PLAN)
    return spark.createDataFrame([tuple(found[k] for k in ("rows", "duplicates", "filled", "outliers", "removed"))], "rows bigint, duplicates bigint, filled bigint, outliers bigint, removed bigint")


_REPEATED = "(SELECT event_type, CASE WHEN event_id % 7 <> 0 THEN round(value, 0) END AS value, 'EU' AS region FROM events)"


@query(f"SELECT c AS dropped FROM ({_per_column(_REPEATED, ['event_type', 'value', 'region'], chr(39) + '{c}' + chr(39) + ' AS c, count(DISTINCT {c}) AS u')}) WHERE u <= 1")
def drop_constant_columns(spark, sf_dir):
    out = cleaning.apply_plan(repeated_events(spark, sf_dir), cleaning.Plan(duplicates="keep"))
    return spark.createDataFrame([(c,) for c in out.report["dropped_columns"]], "dropped string")


# Features

def _scale(method: str, sql: str) -> None:
    def run(spark, sf_dir):
        df = table(spark, sf_dir, "customer")
        return df.select("c_custkey", F.round(features.fit_scalers(df, ["c_acctbal"], method)[0][0].of(df), 5).alias("scaled"))

    QUERIES[f"scale_{method}"], SQL[f"scale_{method}"] = run, f"SELECT c_custkey, round((c_acctbal - a) / b, 5) AS scaled FROM customer, (SELECT {sql} FROM customer)"


_scale("standard", "avg(c_acctbal) AS a, stddev_pop(c_acctbal) AS b")
_scale("minmax", "min(c_acctbal) AS a, max(c_acctbal) - min(c_acctbal) AS b")
_scale("robust", "median(c_acctbal) AS a, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS b")


@query("SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{v}')::INT AS o_orderstatus_{v}" for v in "FOP") + " FROM orders")
def onehot(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return df.select("o_orderkey", *features.one_hot(df, features.fit_encoders(df, ["o_orderstatus"])[0]))


@query("SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_orderpriority) - 1)::BIGINT AS code FROM orders")
def ordinal(spark, sf_dir):
    return features.with_ordinal(table(spark, sf_dir, "orders"), "o_orderpriority", "code").select("o_orderkey", "code")


@query("SELECT o_orderkey, coalesce(code, -1)::BIGINT AS code FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey::VARCHAR END AS k FROM orders) o LEFT JOIN (SELECT k, row_number() OVER (ORDER BY k) - 1 AS code FROM (SELECT DISTINCT CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey::VARCHAR END AS k FROM orders) WHERE k IS NOT NULL) USING (k)")
def onehot_fallback(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_custkey").cast("string")).alias("k"))
    fitted = features.fit_encoders(df, ["k"])[0]
    if fitted.method != "ordinal":
        raise AssertionError("a column of many levels is coded")
    return features.with_ordinal(df, "k", "code").select("o_orderkey", "code")


_STATE = {"c_acctbal": ("standard", "avg({c})", "stddev_pop({c})"), "c_nationkey": ("minmax", "min({c})::DOUBLE", "(max({c}) - min({c}))::DOUBLE")}


@query("SELECT (row_number() OVER (ORDER BY part, feature) - 1)::INT AS place, feature, source, source_type, processor, level, round(centre, 5) AS centre, round(scale, 5) AS scale FROM ("
       + " UNION ALL ".join(f"SELECT {i} AS part, '{c}' AS feature, '{c}' AS source, 'numeric' AS source_type, '{how}' AS processor, NULL AS level, {a.format(c=c)} AS centre, {b.format(c=c)} AS scale FROM customer" for i, (c, (how, a, b)) in enumerate(_STATE.items()))
       + " UNION ALL SELECT DISTINCT 2, 'c_mktsegment_' || c_mktsegment, 'c_mktsegment', 'categorical', 'onehot', c_mktsegment, NULL, NULL FROM customer)")
def feature_provenance(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_acctbal", "c_nationkey", "c_mktsegment")
    fm = features.fit(df, {"c_acctbal": "numeric", "c_nationkey": "numeric"}, "StandardScaler", "one-hot", scalers={"c_nationkey": "min-max"})
    return rounded(fm.provenance(spark), "centre", "scale")


# Text and vectors

@query("SELECT conv_id, turn, trim(role) || ' | ' || trim(text) AS merged FROM conversations WHERE trim(text) <> '' AND trim(role) <> ''")
def text_merge(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("trim(text) <> '' and trim(role) <> ''").select("conv_id", "turn", embedding.merged(["role", "text"], " | ").alias("merged"))


@query("SELECT conv_id, turn, 'passage: ' || CASE WHEN role = 'user' THEN 'unknown' ELSE role END AS doc, 'query: ' || CASE WHEN role = 'user' THEN 'unknown' ELSE role END AS ask FROM conversations")
def embed_inputs(spark, sf_dir):
    text = embedding.replaced(F.when(F.col("role") != "user", F.col("role")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", embedding.prefixed(text, "e5-base").alias("doc"), embedding.prefixed(text, "e5-base", True).alias("ask"))


@query()
def hash_embedding(spark, sf_dir):
    return embedding.embed(table(spark, sf_dir, "documents"), ["text"]).select("doc_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))


@query("SELECT (dim - 1)::INT AS dim, round(var_pop(embedding[dim]), 5) AS variance FROM embeddings, (SELECT unnest(range(1, 65)) AS dim) GROUP BY dim")
def embedding_variance(spark, sf_dir):
    return rounded(embedding.dimension_variance(table(spark, sf_dir, "embeddings"), "embedding"), "variance")


_VECTORS = "v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding)))::INT AS dim FROM embeddings), c AS (SELECT label, dim, avg(x) AS mean, count(*) AS n FROM v GROUP BY ALL)"


@query(f"WITH {_VECTORS} SELECT label, dim, round(mean, 5) AS mean, n::BIGINT AS n FROM c")
def centroids(spark, sf_dir):
    return rounded(clustering.centroids(table(spark, sf_dir, "embeddings"), "embedding", "label"), "mean")


@query("SELECT label, count(*)::BIGINT AS n FROM embeddings GROUP BY label")
def cluster_distribution(spark, sf_dir):
    return clustering.distribution(table(spark, sf_dir, "embeddings"), "label")


def _one(spark: SparkSession, name: str, value: float, digits: int = 4) -> DataFrame:
    return spark.createDataFrame([(round(value, digits),)], f"{name} double")


@query(f"WITH {_VECTORS} SELECT round(sum((x - mean) ** 2), 4) AS inertia FROM v JOIN c USING (label, dim)")
def inertia(spark, sf_dir):
    return _one(spark, "inertia", clustering.inertia(table(spark, sf_dir, "embeddings"), "embedding", "label"))


@query(f"""WITH {_VECTORS}, s AS (SELECT label, avg(d) AS s FROM (SELECT vec_id, label, sqrt(sum((x - mean) ** 2)) AS d FROM v JOIN c USING (label, dim) GROUP BY ALL) GROUP BY label),
p AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.mean - b.mean) ** 2)) AS d FROM c a JOIN c b ON a.dim = b.dim AND a.label <> b.label GROUP BY ALL)
SELECT round(avg(m), 4) AS davies_bouldin FROM (SELECT i, max((x.s + y.s) / d) AS m FROM p JOIN s x ON x.label = i JOIN s y ON y.label = j GROUP BY i)""")
def davies_bouldin(spark, sf_dir):
    return _one(spark, "davies_bouldin", clustering.davies_bouldin(table(spark, sf_dir, "embeddings"), "embedding", "label"))


@query(f"""WITH {_VECTORS}, w AS (SELECT sum((x - mean) ** 2) AS w FROM v JOIN c USING (label, dim)), g AS (SELECT dim, avg(x) AS g FROM v GROUP BY dim),
b AS (SELECT sum(n * (mean - g) ** 2) AS b FROM c JOIN g USING (dim)), k AS (SELECT count(DISTINCT label) AS k, count(*) AS n FROM embeddings) SELECT round((b / (k - 1)) / (w / (n - k)), 4) AS calinski_harabasz FROM w, b, k""")
def calinski_harabasz(spark, sf_dir):
    return _one(spark, "calinski_harabasz", clustering.calinski_harabasz(table(spark, sf_dir, "embeddings"), "embedding", "label"))


@query("""WITH d AS (SELECT p.vec_id, p.label AS own, q.label AS other, sum(list_distance(p.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS t, count(*) AS n FROM embeddings p, embeddings q GROUP BY ALL),
s AS (SELECT vec_id, sum(CASE WHEN own = other THEN t END) / nullif(sum(CASE WHEN own = other THEN n END) - 1, 0) AS a, min(CASE WHEN own <> other THEN t / n END) AS b FROM d GROUP BY vec_id)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 4) AS silhouette FROM s""")
def silhouette(spark, sf_dir):
    return _one(spark, "silhouette", clustering.silhouette(table(spark, sf_dir, "embeddings"), "embedding", "label"))


@query()
def kmeans_sweep(spark, sf_dir):
    tried = clustering.sweep(table(spark, sf_dir, "embeddings"), "embedding")
    best = clustering.best_k(tried)
    return spark.createDataFrame([(t.k, t.inertia, t.silhouette, t.k == best) for t in tried], "k bigint, inertia double, silhouette double, best boolean")


@query()
def cluster_labels(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return clustering.labelled(df, clustering.fit_kmeans(df, 4, "embedding"), "embedding").select("vec_id", "cluster_label")


#: Columns of each table that become features: numbers, then categories.
_WIDE = {"customer": (["c_acctbal"], ["c_mktsegment"]), "orders": (["o_totalprice"], ["o_orderstatus", "o_orderpriority"]), "part": (["p_size", "p_retailprice"], ["p_brand", "p_type"]), "lineitem": (LINE, ["l_returnflag", "l_linestatus"])}
_WIDTHS = " UNION ALL ".join([f"SELECT '{t}' AS \"table\", {len(n)} + {' + '.join(f'count(DISTINCT {c})' for c in k)} AS d FROM {t}" for t, (n, k) in _WIDE.items()] + ["SELECT 'embeddings', max(len(embedding)) FROM embeddings"])


@query(f"""WITH w AS ({_WIDTHS}), c AS (SELECT *, greatest(1, least(128, d // 2)) AS cap FROM w), z AS (SELECT *, CASE WHEN d <= 1 THEN 1 ELSE least(greatest(round(2 * sqrt(d)), least(8, cap)), cap) END::INT AS latent FROM c),
n AS (SELECT *, CASE WHEN d <= latent + 1 THEN 0 ELSE least(3, greatest(1, floor(log2(d / latent)))) END::INT AS n FROM z)
SELECT "table", d::INT AS d, latent, coalesce(array_to_string(list_reverse_sort(list_distinct([x FOR x IN [round(d * pow(latent / d, i / (n + 1)))::INT FOR i IN range(1, n + 1)] IF x > latent AND x < d])), ','), '') AS hidden FROM n""")
def latent_sizes(spark, sf_dir):
    """The network that each table's features would get."""
    out = []
    for t, (numbers, categories) in _WIDE.items():
        df = table(spark, sf_dir, t).select(*numbers, *categories)
        out.append((t, len(features.fit(df, dict.fromkeys(numbers, "numeric") | dict.fromkeys(categories, "categorical")).names())))
    out.append(("embeddings", table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding"))).first()[0]))
    sizes = [(t, d, latent.latent_size(d)) for t, d in out]
    return spark.createDataFrame([(t, d, z, ",".join(map(str, latent.hidden_sizes(d, z)))) for t, d, z in sizes], "`table` string, d int, latent int, hidden string")


@query()
def autoencoder_latent(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    return latent.train(df, "embedding").encode(df, "embedding").select("vec_id", F.transform("latent", lambda x: F.round(x, 6)).alias("latent"))


@query()
def principal_components(spark, sf_dir):
    return latent.components(table(spark, sf_dir, "embeddings"), "embedding").select("vec_id", "projected")


@query()
def tsne_chart(spark, sf_dir):
    return latent.tsne_chart(table(spark, sf_dir, "embeddings"), "embedding", "vec_id")


# Cluster profiles

@query("SELECT c_mktsegment AS label, 'c_acctbal' AS \"column\", round(avg(c_acctbal), 4) AS mean, round(median(c_acctbal), 4) AS median, min(c_acctbal) AS min, max(c_acctbal) AS max FROM customer GROUP BY ALL UNION ALL SELECT c_mktsegment, 'c_nationkey', round(avg(c_nationkey), 4), round(median(c_nationkey), 4), min(c_nationkey)::DOUBLE, max(c_nationkey)::DOUBLE FROM customer GROUP BY ALL")
def cluster_numeric_profile(spark, sf_dir):
    return rounded(clustering.numeric_profile(table(spark, sf_dir, "customer"), "c_mktsegment", ["c_acctbal", "c_nationkey"]), "mean", "median", digits=4)


@query("SELECT o_orderstatus AS label, 'o_orderpriority' AS \"column\", o_orderpriority AS value FROM orders GROUP BY o_orderstatus, o_orderpriority QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) = 1")
def cluster_categorical_profile(spark, sf_dir):
    return clustering.categorical_profile(table(spark, sf_dir, "orders"), "o_orderstatus", ["o_orderpriority"])


_BEST = "SELECT '{c}' AS \"column\", c_mktsegment AS label, round(avg({c}), 4) AS mean FROM customer GROUP BY c_mktsegment QUALIFY row_number() OVER (ORDER BY avg({c}) DESC, c_mktsegment) = 1"


@query(" UNION ALL ".join(f"SELECT * FROM ({_BEST.format(c=c)})" for c in ("c_acctbal", "c_nationkey")))
def cluster_insight(spark, sf_dir):
    return rounded(clustering.insight(table(spark, sf_dir, "customer"), "c_mktsegment", ["c_acctbal", "c_nationkey"]), "mean", digits=4)


# Charts

@query("SELECT bin::BIGINT AS bin, round(a + bin * w, 5) AS low, round(a + (bin + 1) * w, 5) AS high, count(*)::BIGINT AS n FROM (SELECT least(floor((value - a) / w), 29) AS bin, a, w FROM events, (SELECT min(value) AS a, (max(value) - min(value)) / 30 AS w FROM events)) GROUP BY ALL")
def histogram(spark, sf_dir):
    return rounded(charts.histogram(table(spark, sf_dir, "events"), "value"), "low", "high")


def _box_sql(group: str) -> str:
    return f"WITH q AS (SELECT {group} AS grp, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY ALL) SELECT grp, round(q1, 5) AS q1, round(median, 5) AS median, round(q3, 5) AS q3, min(CASE WHEN ok THEN value END) AS low_whisker, max(CASE WHEN ok THEN value END) AS high_whisker, count_if(NOT ok)::BIGINT AS n_fliers FROM (SELECT q.*, value, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM events JOIN q ON {group} = grp) GROUP BY ALL"


@query(_box_sql("'all'"))
def boxplot(spark, sf_dir):
    return rounded(charts.box(table(spark, sf_dir, "events"), "value"), "q1", "median", "q3")


@query(_box_sql("event_type"))
def boxplot_grouped(spark, sf_dir):
    return rounded(charts.box(table(spark, sf_dir, "events"), "value", "event_type"), "q1", "median", "q3")


_CORR = "SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) AS r FROM lineitem"
_TWO = [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1 :]]


@query(" UNION ALL ".join(_CORR.format(a=a, b=b) for a, b in _TWO))
def corr_pearson(spark, sf_dir):
    return rounded(charts.correlation(table(spark, sf_dir, "lineitem"), LINE), "r", digits=4)


@query("WITH r AS (SELECT avg(i) OVER (PARTITION BY p_size) AS x, avg(j) OVER (PARTITION BY p_retailprice) AS y FROM (SELECT p_size, p_retailprice, row_number() OVER (ORDER BY p_size) AS i, row_number() OVER (ORDER BY p_retailprice) AS j FROM part)) SELECT 'p_size' AS a, 'p_retailprice' AS b, round(corr(x, y), 4) AS r FROM r")
def corr_spearman(spark, sf_dir):
    return rounded(charts.correlation(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"], "spearman"), "r", digits=4)


@query("SELECT p_brand AS value, count(*)::BIGINT AS n FROM part GROUP BY ALL ORDER BY n DESC, value LIMIT 10")
def count_top(spark, sf_dir):
    return charts.top_n(table(spark, sf_dir, "part"), "p_brand", 10)


@query(f"SELECT * FROM ({_per_column(GAPPY, ['user_id', 'event_type', 'value'], chr(39) + '{c}' + chr(39) + ' AS ' + chr(34) + 'column' + chr(34) + ', count_if({c} IS NULL)::BIGINT AS n_missing')}) WHERE n_missing > 0")
def missing_chart(spark, sf_dir):
    return charts.missing_chart(gappy_events(spark, sf_dir))


@query()
def plot_sample(spark, sf_dir):
    return charts.plot_sample(table(spark, sf_dir, "events"), key="event_id").select("event_id", "value")


# The whole run

@query()
def analysis(spark, sf_dir):
    """All stages over the customers, with the defaults: each one's point in the latent space and segment."""
    config = run_plan.Config(roles={"c_custkey": "metadata", "c_name": "metadata"})
    return run_plan.run(table(spark, sf_dir, "customer"), config).table.select("c_custkey", F.transform("latent", lambda x: F.round(x, 6)).alias("latent"), "cluster_label")


@query()
def latent_scatter(spark, sf_dir):
    return charts.latent_scatter(table(spark, sf_dir, "embeddings"), "embedding", "label", "vec_id")
