"""Scalar rules that every operator shares: missing values, text, numbers, ratios. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INDEX = "original_index"


def kind(df: DataFrame, name: str) -> str:
    """``number``, ``boolean``, ``time``, ``text`` or ``other`` from the physical type."""
    t = df.schema[name].dataType
    if isinstance(t, NUMERIC):
        return "number"
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return "text" if isinstance(t, (T.StringType, T.CharType, T.VarcharType)) else "other"


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as null."""
    return F.nanvl(col(name), F.lit(None)) if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)) else col(name)


def is_missing(df: DataFrame, name: str) -> Column:
    return present(df, name).isNull()


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"(?U)\S+"))


def to_number(df: DataFrame, name: str, commas: bool = False) -> Column:
    """The column as double: numbers and truth values as they are, text where it reads as one, else null. With ``commas``, 1,234 does too."""
    if kind(df, name) in ("number", "boolean"):
        return present(df, name).cast("double")
    s = strip(col(name).cast("string"))
    s = F.replace(s, F.lit(","), F.lit("")) if commas else s
    return F.when(s.rlike(NUMBER), s.try_cast("double"))


FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "dd.MM.yyyy")


def to_time(c: Column) -> Column:
    s = strip(c.cast("string"))
    return F.coalesce(*[F.try_to_timestamp(s, F.lit(f)) for f in FORMATS])


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def in_files(df: DataFrame, weight: Column) -> tuple[DataFrame, DataFrame]:
    """(rows, starts): ``df`` written to the shared folder, a file a partition, its columns named c0, c1, ... with each row's _file and _place
    there; and (_file, _start): the sum of ``weight`` (of those columns) over all files before, a row of about 100 bytes for each partition."""
    from .shared import new_path

    names = [f"c{i}" for i in range(len(df.columns))]
    path = new_path(df.sparkSession, "numbered")
    df.toDF(*names).write.parquet(path)
    rows = df.sparkSession.read.schema(T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, df.schema, strict=True)])).parquet(path)
    rows = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_place"))  # names follow the partitions
    before = Window.partitionBy(F.lit(0)).orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    return rows, rows.groupBy("_file").agg(F.sum(weight).alias("_n")).select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))


def with_index(df: DataFrame) -> DataFrame:
    """``original_index`` as first column, contiguous from 0, unless there already. Partitions are counted, and a row's number is its
    partition's start plus its place there. A plan with a shuffle may be cut anew for each job, so its rows are written to the shared folder
    first; there a row's number is its file's start plus its place in the file."""
    if INDEX in df.columns:
        return df
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        rows, starts = in_files(df, F.lit(1).cast("long"))
        return rows.join(F.broadcast(starts), "_file").select((F.col("_start") + F.col("_place")).alias(INDEX), *[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])
    starts, n = [], 0
    sizes = {r[0]: r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()}  # a row a partition
    for p in range(max(sizes, default=-1) + 1):
        starts.append((p, n))
        n += sizes.get(p, 0)
    place = F.monotonically_increasing_id()
    numbered = df.select("*", F.shiftright(place, 33).cast("int").alias("_part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_place"))
    held = F.broadcast(df.sparkSession.createDataFrame(starts, "_part int, _start bigint"))  # 12 bytes a partition
    return numbered.join(held, "_part").select((F.col("_start") + F.col("_place")).alias(INDEX), *[col(c) for c in df.columns])


def mark_repeats(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a boolean: the row repeats one with a smaller index, nulls and NaNs alike. The first of each group is found by a partial
    aggregate and met again by its index, so a group of copies never lands in one task."""
    firsts = df.groupBy(*[col(c) for c in df.columns if c != INDEX]).agg(F.min(INDEX).alias(INDEX)).select(INDEX, F.lit(True).alias("_first"))
    return df.join(firsts, INDEX, "left").withColumn(name, F.col("_first").isNull()).drop("_first")
