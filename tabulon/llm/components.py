"""Connected components of an edge table, as alternating large-star and small-star rounds, and of components found in several ways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, without


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One round. ``edges`` has src > dst. Large: each node's larger neighbours are tied to the least of its
    neighbourhood; small: its smaller neighbours and itself are."""
    if large:
        arcs = edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    else:
        arcs = edges
    least = arcs.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("hub"), F.least("src", "low").alias("low"))
    tied = arcs.join(least, F.col("src") == F.col("hub"))
    if large:
        out = tied.where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    else:
        out = tied.select(F.col("dst").alias("src"), F.col("low").alias("dst")).union(least.select(F.col("hub").alias("src"), F.col("low").alias("dst")))
    return out.where(F.col("src") != F.col("dst")).distinct()


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``edges`` (a long, b long, any order, repeats and loops allowed) -> (node, root): every node that has an edge to another
    node, with the least node of its component. Nothing but one row of counts per round reaches the driver; each round is
    written to the shared folder. No edges: an empty table. Null ends are ignored."""
    now = saved(edges.where("a != b").select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst")), F.sum(F.hash("src", "dst").cast("long"))).first()
        if state == mark or not state[0]:
            break
        mark = state
        now = saved(_stars(_stars(now, True), False), "stars")
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(now.select(F.col("dst").alias("node"), F.col("dst").alias("root")).distinct())


def merged(found: list[DataFrame]) -> DataFrame:
    """Tables (id, component: its least id) -> (id, component): least id reachable over the components of all of them. A row an id. Only
    components that share an id become edges, so copies are not paired, and a large component has one edge for each other that it meets."""
    own = found[0].toDF("id", "component")
    for x in found[1:]:
        own = own.union(x.toDF("id", "component"))
    met = saved(own.where("id is not null").groupBy("id").agg(F.min("component").alias("least"), F.collect_set("component").alias("all")), "met")
    roots = components(met.where(F.size("all") > 1).select(F.col("least").alias("a"), F.explode("all").alias("b")).where("a != b").distinct())
    return met.join(roots, met["least"] == roots["node"], "left").select("id", F.coalesce("root", "least").alias("component"))


def one_of_each(docs: DataFrame, id_col: str, found: list[DataFrame]) -> DataFrame:
    """``docs`` without the rows whose component, merged of those ``found``, has a smaller id. All columns stay."""
    return without(docs, id_col, merged(found).where("component != id").select("id"))
