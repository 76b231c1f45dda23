"""Exact quantiles and ranks whose memory is bounded whatever the number of distinct values. Linear interpolation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .values import col, in_files, to_number

#: Up to so many values are left to one aggregate; more are narrowed down by histograms of BINS counts. Either way gives the same values.
ONE_TASK, BINS = 2_000_000, 1024


def quantiles(df: DataFrame, cols: list[str], probs: tuple[float, ...] = (0.25, 0.5, 0.75), by: str | None = None, one_task: int = ONE_TASK) -> dict[tuple, dict[str, list[float] | None]]:
    """{(group,) or (): {column: values at ``probs``, None without any value}} over the present values of ``cols``; ``by`` has few levels."""
    if not cols:
        return {}
    keys = [col(by)] if by else []
    x = {c: to_number(df, c) for c in cols}
    sizes = df.groupBy(*keys).agg(*[F.count(v).alias(f"n{i}") for i, v in enumerate(x.values())]).collect()  # a row a group
    k = len(keys)
    if sum(n for r in sizes for n in r[k:]) <= one_task * len(cols):
        found = df.groupBy(*keys).agg(*[F.percentile(v, F.array(*map(F.lit, probs))).alias(f"q{i}") for i, v in enumerate(x.values())]).collect()
        return {tuple(r[:k]): dict(zip(cols, r[k:], strict=True)) for r in found}
    counts = {(tuple(r[:k]), i): r[k + i] for r in sizes for i in range(len(cols))}
    places = {(g, i, p): (at := p * (n - 1), math.floor(at), math.ceil(at)) for (g, i), n in counts.items() if n for p in probs}
    values = _at_ranks(df.select(*[v.alias(f"x{i}") for i, v in enumerate(x.values())], *[y.alias("g") for y in keys]), {(g, i, r) for (g, i, _), (_, a, b) in places.items() for r in (a, b)}, bool(by))
    out: dict = {tuple(r[:k]): {} for r in sizes}
    for g in out:
        for i, c in enumerate(cols):
            own = [places.get((g, i, p)) for p in probs]
            out[g][c] = None if None in own else [values[g, i, a] + (values[g, i, b] - values[g, i, a]) * (at - a) for at, a, b in own]
    return out


def _at_ranks(rows: DataFrame, wanted: set, grouped: bool) -> dict:
    """Values at ranks: each round counts, for every interval still open, BINS bins with their least and greatest value."""
    spark, done = rows.sparkSession, {}
    cols = [c for c in rows.columns if c != "g"]
    g = F.col("g") if grouped else F.lit(None).cast("string")
    long = rows.select(g.cast("string").alias("g"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("x")) for i, c in enumerate(cols)])).alias("s")).select("g", "s.*").where("x is not null")
    name = {w: (str(w[0][0]) if grouped and w[0][0] is not None else None) for w in wanted}
    ends = {(r["g"], r["i"]): (r["a"], r["z"]) for r in long.groupBy("g", "i").agg(F.min("x").alias("a"), F.max("x").alias("z")).collect()}
    todo = {w: (*ends[name[w], w[1]], w[2]) for w in wanted}
    while todo:
        for w in [w for w, (a, z, _) in todo.items() if a == z]:
            done[w] = todo.pop(w)[0]
        spans = sorted({(name[w] is None, name[w] or "", w[1], a, z) for w, (a, z, _) in todo.items()})
        if not spans:
            break
        held = spark.createDataFrame([(None if none else s, i, a, z, k) for k, (none, s, i, a, z) in enumerate(spans)], "g2 string, i2 int, a double, z double, k int")
        met = long.join(F.broadcast(held), F.col("g").eqNullSafe(F.col("g2")) & (F.col("i") == F.col("i2")) & F.col("x").between(F.col("a"), F.col("z")))
        part = F.least(F.floor((F.col("x") / BINS - F.col("a") / BINS) / (F.col("z") / BINS - F.col("a") / BINS) * BINS), F.lit(BINS - 1))
        bins: dict[int, list] = {}
        for r in met.groupBy("k", part.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).collect():  # BINS a span
            bins.setdefault(r["k"], []).append((r["b"], r["n"], r["low"], r["high"]))
        for w, (a, z, rank) in todo.items():
            for _, n, low, high in sorted(bins[spans.index((name[w] is None, name[w] or "", w[1], a, z))]):
                if rank < n:
                    todo[w] = (low, high, rank)
                    break
                rank -= n
    return done


def average_ranks(df: DataFrame, value: Column) -> DataFrame:
    """(value, rank): the average rank of each distinct value. The counted values are sorted over all tasks, by sampled ranges; each task adds
    up its own, and what the tasks before it hold is added afterwards. A hot value is one row by then."""
    counts = df.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            upto = seen + n.cumsum()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(upto - n)], ["value", "n", "inside"])
            seen = int(upto[-1]) if len(n) else seen

    kind = counts.schema["value"].dataType.simpleString()
    rows, starts = in_files(counts.orderBy("value").mapInArrow(add_up, f"value {kind}, n bigint, inside bigint"), F.col("c1"))
    return rows.join(F.broadcast(starts), "_file").select(F.col("c0").alias("value"), (F.col("_start") + F.col("c2") + (F.col("c1") + 1) / 2).alias("rank"))
