"""Hard negatives by a full sort of every anchor's scores.

Components become whole numbers, floor(``unit`` * x), so scores are exact. The rows lie in blocks in the shared folder, each sorted by id;
anchors are dealt over tasks, and a task streams the blocks twice. The first time it keeps each anchor's best rows of its own label. The
second time it sorts the block by score and id for each anchor; a binary search finds where scores fall to a positive's upper limit, and the
first different-label rows from there down to the lower limit are read off. What blocks give is merged by the same order, so a task holds a
block, its anchors and ``k`` rows for each positive, whatever the size of the table or of a label.

Rows with a null id, label or vector, or a null or non-finite component take no part, nor those with vectors of another length than most.
Rows equal in id, label and vector count as one; rows that share an anchor's id are neither its positives nor its negatives. Ties go to the
smaller id. An anchor without another row of its label gives no rows, nor does a positive of negative score, whose limits exclude each
other. An empty table gives an empty result. Other columns are not read. Scores that do not fit a long raise an error."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import new_path, table
from .vectors import BLOCK, best, chunks, matrix, sound, stored_rows

#: Anchors whose scores against a block are held at once.
ANCHORS = 128
_BLOCK = "ids binary, labels binary, vectors binary"
_MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def whole_numbers(x: np.ndarray, unit: int, kind: str) -> np.ndarray:
    return np.floor(unit * x.astype(float)).astype(kind)


def picks(score: np.ndarray, ids: np.ndarray, other: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> list[np.ndarray]:
    """Places of the first ``k`` rows marked ``other`` with a score from low to high, for each pair of limits, of rows that lie by id."""
    order = np.lexsort((ids, -score))
    order = order[other[order]]
    falling = -score[order]
    first, end = np.searchsorted(falling, -high, "left"), np.searchsorted(falling, -low, "right")
    return [order[a : min(a + k, b)] for a, b in zip(first, end, strict=True)]


def mine(df: DataFrame, anchors: Column, positives: int = 5, k: int = 3, low: int = 50, high: int = 95, unit: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row whose ``id`` fulfils ``anchors`` and each
    of its ``positives`` best rows of the same label, the ``k`` best rows of other labels whose score is from ``low`` to ``high`` per cent
    of the positive's. ``label`` is a column of whole numbers, the column ``label`` if not given."""
    spark = df.sparkSession
    rows, d, _, top, n = sound(df, id_col, vector_col, label=(F.col("label") if label is None else label).cast("long"))
    rows = rows.where("label is not null").dropDuplicates(["id", "label", "v"])
    if not n:
        return spark.createDataFrame([], _MINED)
    largest = d * (unit * top + 1) ** 2
    if largest * 100 >= 2**63:
        raise ValueError(f"scores of up to {largest:.3g} do not fit a long")
    kind = "f8" if largest < 2**53 else "i8"  # sums of whole numbers below 2^53 are exact in doubles
    path = new_path(spark, "scored-blocks")

    def block(batches):
        for batch in chunks(batches, BLOCK):
            x = whole_numbers(matrix(batch.column(2), d), unit, "i4" if unit * top < 2**31 - 1 else "i8")
            made = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), x)
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in made], ["ids", "labels", "vectors"])

    rows.select("id", "label", "v").coalesce(max(2, math.ceil(n / BLOCK))).sortWithinPartitions("id").mapInArrow(block, _BLOCK).write.parquet(path)

    def blocks():
        for row in stored_rows(path):
            ids = np.frombuffer(row["ids"], np.int64)
            x = np.frombuffer(row["vectors"], f"i{len(row['vectors']) // (len(ids) * d)}").reshape(-1, d)
            yield ids, np.frombuffer(row["labels"], np.int64), x.astype(kind)

    def run(batches):
        for batch in chunks(batches, ANCHORS):
            own, mark = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            v = whole_numbers(matrix(batch.column(2), d), unit, kind)
            good = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in own]
            for ids, labels, x in blocks():
                scores = (v @ x.T).astype(np.int64)
                for i in range(len(own)):
                    same = np.flatnonzero((labels == mark[i]) & (ids != own[i]))
                    s, who = np.concatenate([good[i][0], scores[i, same]]), np.concatenate([good[i][1], ids[same]])
                    first = best(s, who, positives)
                    good[i] = s[first], who[first]
            hard = [[(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in s] for s, _ in good]
            limits = [(-(-low * s // 100), high * s // 100) for s, _ in good]
            for ids, labels, x in blocks():
                scores = (v @ x.T).astype(np.int64)
                for i in range(len(own)):
                    found = picks(scores[i], ids, (labels != mark[i]) & (ids != own[i]), *limits[i], k)
                    for p, at in enumerate(found):
                        if len(at):
                            s, who = np.concatenate([hard[i][p][0], scores[i, at]]), np.concatenate([hard[i][p][1], ids[at]])
                            first = best(s, who, k)
                            hard[i][p] = s[first], who[first]
            out = [(own[i], good[i][1][p], r + 1, who[r], good[i][0][p], s[r]) for i in range(len(own)) for p, (s, who) in enumerate(hard[i]) for r in range(len(s))]
            if out:
                cols = [np.array(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if i == 2 else c.astype(np.int64)) for i, c in enumerate(cols)], [c.split()[0] for c in _MINED.split(", ")])

    asking = rows.where(anchors).select("id", "label", "v")
    return asking.repartition(max(1, math.ceil(asking.count() / ANCHORS))).mapInArrow(run, _MINED)


def _label() -> Column:
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def op13_negatives(spark, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=_label())


ORACLE_SQL = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_dot_product(a.v, b.v)::BIGINT AS score FROM r a, r b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE own = label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE own <> label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3"""
