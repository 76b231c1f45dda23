"""Nearest neighbours by a permutation index.

A vector stands as the order of its PREFIX nearest pivots. Each block of the index is an inverted file: a pivot's postings list the block's
vectors that have it among their nearest, with its place in their order. A query walks the postings of its own nearest pivots and adds up,
for every vector met, how much less than the largest the footrule distance of the two orders is: pivots of both orders at places i and j
count PREFIX - max(i, j), as the footrule with absent pivots placed at PREFIX is PREFIX * (PREFIX + 1) less twice that sum. The ``share``
of a block with the least footrule (the smaller id of equals) is ranked again by the inner product itself, in double precision.

Largest inner product becomes nearest vector by one more component, sqrt(1 - |x / M|^2) with M the largest norm (0 for a query), so vectors
of unlike norms are ordered rightly; pivots are PIVOTS vectors of the table, those with the least hash. ``share`` is measured, not set:
TRIED queries are searched exactly in all blocks, and the share is the one that holds ``recall`` of their true neighbours. That rule is the
same at every size; a table without structure just gets a larger share.

Equal vectors are one posting with the ``k`` + 1 least ids of theirs, all that can be among any query's ``k`` nearest, so a third of all
rows may be copies. Queries are dealt over tasks, which stream the blocks: no shuffle of scores, no group by pivot. Rows with a null id, and
vectors that are null, zero, or hold null or non-finite components take no part, nor those of another length than most. Rows equal in id
and vector count as one; of other rows that share an id, each asks and answers, but none is its own id's neighbour. An empty table, or one
without queries, gives an empty result; a single vector has no neighbours. Other columns are not read."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import new_path, table
from .vectors import BLOCK, best, chunks, matrix, sound, stored_rows

#: Bounds of the fit: vectors that serve as pivots, queries that are tried exactly.
PIVOTS, TRIED = 512, 128
PREFIX, QUERIES, RECALL = 64, 256, 0.95
_BLOCK = "n int, ids binary, sizes binary, vectors binary, starts binary, rows binary, places binary"
_FOUND = "query_id bigint, rank int, vec_id bigint, score double"


def lifted(x: np.ndarray, scale: float) -> np.ndarray:
    """Vectors over the largest norm, with the component that makes their own norm 1."""
    y = np.asarray(x, float) / scale
    return np.hstack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))[:, None]])


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of each vector's nearest pivots, nearest first, the lower number of equals."""
    return np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :prefix]


def postings(order: np.ndarray, n_pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each pivot's list, rows, places): the inverted file of a block."""
    n, prefix = order.shape
    flat = order.ravel()
    by = np.argsort(flat, kind="stable")
    starts = np.zeros(n_pivots + 1, np.int32)
    np.cumsum(np.bincount(flat, minlength=n_pivots), out=starts[1:])
    return starts, (by // prefix).astype(np.uint16), (by % prefix).astype(np.uint8)


class Block:
    """A block as stored: ``ids`` of vector i are those from cut[i] to cut[i + 1], its vectors by least id."""

    def __init__(self, row: dict, kind: str, d: int):
        self.n, self.ids = row["n"], np.frombuffer(row["ids"], np.int64)
        self.cut = np.concatenate([[0], np.cumsum(np.frombuffer(row["sizes"], np.int32))])
        self.vectors = np.frombuffer(row["vectors"], kind).reshape(-1, d)
        self.starts, self.rows, self.places = np.frombuffer(row["starts"], np.int32), np.frombuffer(row["rows"], np.uint16), np.frombuffer(row["places"], np.uint8)

    def ranked(self, order: np.ndarray) -> np.ndarray:
        """Of each vector, a key that is higher the less its footrule distance to ``order``, and the smaller its id among equals."""
        prefix = len(order)
        rows = [self.rows[self.starts[p] : self.starts[p + 1]] for p in order]
        gain = [prefix - np.maximum(self.places[self.starts[p] : self.starts[p + 1]], j) for j, p in enumerate(order)]
        agreed = np.bincount(np.concatenate(rows), np.concatenate(gain), self.n).astype(np.int64)
        return agreed * BLOCK + (BLOCK - 1 - np.arange(self.n))

    def scores(self, query: np.ndarray, places: np.ndarray | slice) -> np.ndarray:
        return np.einsum("ij,j->i", self.vectors[places].astype(float), query)

    def members(self, places: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``places``, id) of the rows behind some vectors, without the query's own."""
        n = self.cut[places + 1] - self.cut[places]
        ids = self.ids[np.repeat(self.cut[places] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        which = np.repeat(np.arange(len(places)), n)
        return which[ids != own], ids[ids != own]


@dataclass
class Index:
    path: str
    pivots: np.ndarray
    scale: float
    d: int
    kind: str
    prefix: int
    k: int
    share: float = 1.0

    def asked(self, v: np.ndarray) -> np.ndarray:
        """The orders of queries: over their norm, without the further component."""
        x = v / np.maximum(np.sqrt((v * v).sum(1)), 1e-300)[:, None]
        return orders(np.hstack([x, np.zeros((len(x), 1))]), self.pivots, self.prefix)


def build(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX, recall: float = RECALL) -> tuple[Index | None, DataFrame]:
    """(index, query rows): ``queries`` is a condition on ``id``. The index is None where no row takes part."""
    spark = df.sparkSession
    rows, d, scale, _, n = sound(df, id_col, vector_col)
    rows = rows.where(F.exists("v", lambda x: x != 0)).dropDuplicates(["id", "v"])
    asking = rows.where(queries)
    if not n or not scale:
        return None, asking
    sample = [r["v"] for r in rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(pivots).collect()]
    index = Index(new_path(spark, "permutations"), lifted(np.array(sample), scale), scale, d, "f4" if "float" in rows.schema["v"].dataType.simpleString() else "f8", min(prefix, len(sample)), k)
    least = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    classes = rows.withColumn("at", least).where(F.col("at") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))  # k + 1 at most
    parts = classes.coalesce(max(2, math.ceil(n / BLOCK))).sortWithinPartitions(F.col("ids")[0])
    shared, kind, length, largest, most = spark.sparkContext.broadcast(index.pivots), index.kind, d, scale, index.prefix

    def block(batches):
        for batch in chunks(batches, BLOCK):
            x, ids = matrix(batch.column(0), length).astype(kind), batch.column(1)
            order = orders(lifted(x, largest), shared.value, most)
            starts, places, at = postings(order, len(shared.value))
            sizes = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
            made = [ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes, x, starts, places, at]
            yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int32()), *[pa.array([a.tobytes()], pa.binary()) for a in made]], [c.split()[0] for c in _BLOCK.split(", ")])

    parts.mapInArrow(block, _BLOCK).write.parquet(index.path)
    index.share = measured_share(spark, index, asking, recall)
    return index, asking


def measured_share(spark, index: Index, asking: DataFrame, recall: float) -> float:
    """The share of a block that holds ``recall`` of the true neighbours of TRIED queries."""
    tried = asking.orderBy(F.xxhash64("id"), "id", "v").limit(TRIED).collect()
    if not tried:
        return 1.0
    held = spark.sparkContext.broadcast((np.array([r["id"] for r in tried]), np.array([r["v"] for r in tried], float)))

    def run(batches):
        own, v = held.value
        asked = index.asked(v)
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, index.kind, index.d)
                for i in range(len(own)):
                    rank = np.empty(block.n, np.int64)
                    rank[np.argsort(-block.ranked(asked[i]))] = np.arange(block.n)
                    score = block.scores(v[i], slice(None))
                    near = best(score, block.ids[block.cut[:-1]], index.k + 1)
                    which, ids = block.members(near, own[i])
                    at = near[which]
                    top = best(score[at], ids, index.k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), i)), pa.array(score[at[top]]), pa.array(ids[top]), pa.array((rank[at[top]] + 1) / block.n)], ["q", "score", "id", "part"])

    true = spark.read.parquet(index.path).mapInArrow(run, "q bigint, score double, id bigint, part double")
    first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return true.withColumn("at", first).where(F.col("at") <= index.k).agg(F.percentile("part", F.lit(recall))).first()[0] or 1.0


def search(index: Index, asking: DataFrame) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found of every query row (id, v)."""
    n = asking.count()

    def run(batches):
        for batch in chunks(batches, QUERIES):
            own, v = batch.column(0).to_numpy(), matrix(batch.column(1), index.d).astype(float)
            asked = index.asked(v)
            found = [(np.zeros(0), np.zeros(0, np.int64)) for _ in own]
            for row in stored_rows(index.path):
                block = Block(row, index.kind, index.d)
                take = min(block.n, math.ceil(index.share * block.n))
                for i in range(len(own)):
                    key = block.ranked(asked[i])
                    near = np.argpartition(key, block.n - take)[block.n - take :]
                    score = block.scores(v[i], near)
                    s, ids = found[i]
                    bound = s[-1] if len(s) == index.k else -np.inf
                    good = np.flatnonzero(score >= bound)
                    if len(good) > index.k + 1:
                        good = good[score[good] >= np.partition(score[good], len(good) - index.k - 1)[len(good) - index.k - 1]]
                    if len(good):
                        which, new = block.members(near[good], own[i])
                        s, ids = np.concatenate([s, score[good][which]]), np.concatenate([ids, new])
                        top = best(s, ids, index.k)
                        found[i] = s[top], ids[top]
            sizes = [len(s) for s, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, sizes)), pa.array(np.concatenate([np.arange(1, n + 1) for n in sizes]).astype(np.int32)), pa.array(np.concatenate([i for _, i in found])), pa.array(np.concatenate([s for s, _ in found]))], ["query_id", "rank", "vec_id", "score"])

    return asking.select("id", "v").repartition(max(1, math.ceil(n / QUERIES))).mapInArrow(run, _FOUND)


def nearest(df: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", **fit) -> DataFrame:
    """The ``k`` nearest found among all rows but its own id's, for every row whose ``id`` fulfils ``queries``."""
    index, asking = build(df, queries, k, id_col, vector_col, **fit)
    return df.sparkSession.createDataFrame([], _FOUND) if index is None else search(index, asking)


def op12_permutations(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
