"""Ranked lexical search by the threshold algorithm.

One pass over all whole texts makes a forward index: of each document its number of terms and how often it holds each term that is asked for.
Numbers of documents, terms and documents of a term come from that index, so they cover every row. Then each task takes its documents a
block at a time and has, for each term, the list of the block's documents by falling impact, and the block's impacts by document. For an
item it reads the lists of the item's terms in turn, equally deep into each; a document met for the first time is looked up in the forward
index and scored in full. What a document not met yet can score at most is the sum of the impacts last read: once that threshold falls
strictly below the score of the k-th best so far (of this task's earlier blocks too), the rest of the block can't enter, nor tie. A task
gives k documents an item, which meet in a window by item. Scores are whole numbers, so the answer is exact.

Items are asked in blocks of about PAIRS different (item, term) pairs, each block over all documents; that bounds what is broadcast and, with
CELLS, what a task holds. Hot terms need no split: lists belong to blocks of documents. Empty and null texts have no terms: such documents
count for nothing, such items get no rows. Documents with a null id count but are not listed, documents that share an id are listed each.
Rows that share an item id are one item of their joined terms, rows with a null item id ask nothing. Equal scores go by ascending doc_id.
Long texts are read whole. Empty tables give an empty result. Other columns are not read."""

from __future__ import annotations

import math
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, saved, table, utf8
from .vectors import best, chunks

#: (item, term) pairs asked for in one pass; impacts (documents x terms) that a task holds as a table; entries first read of each list.
PAIRS, CELLS, STEP = 200_000, 1 << 24, 16
_LETTERS = string.ascii_letters + string.digits
#: Bytes of UTF-8: letters and digits (A-Z in lower case) and all beyond ASCII are kept, the rest parts terms.
TABLE = bytes(ord(chr(b).lower()) if b > 127 or chr(b) in _LETTERS else 32 for b in range(128)) + bytes(range(128, 256))
_FOUND = "item bigint, doc bigint, score bigint"


def terms(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def asked(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, term, times)."""

    def run(batch):
        found = [(i, t, n) for i, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True) for t, n in Counter(terms(text)).items()]
        cols = zip(*found, strict=True) if found else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.int64()), strict=True)], ["item", "term", "times"])

    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, run, "item bigint, term binary, times bigint").groupBy("item", "term").agg(F.sum("times").alias("times"))


def forward_index(docs: DataFrame, words: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """(doc, n, terms, tfs): a document's number of terms, and the places in ``words`` of those it holds with their numbers."""
    held = docs.sparkSession.sparkContext.broadcast(words)
    memo: dict = {}

    def run(batch):
        if not memo:
            memo.update((t, i) for i, t in enumerate(held.value))
        get, n, at, tf, cuts = memo.get, [], [], [], [0]
        for text in utf8(batch.column(1)):
            found = terms(text)
            counts = Counter(map(get, found))
            counts.pop(None, None)
            n.append(len(found))
            at += counts.keys()
            tf += counts.values()
            cuts.append(len(at))
        lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(x, pa.int32())) for x in (at, tf)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], ["doc", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return saved(arrow_map(rows, run, "doc bigint, n bigint, terms array<int>, tfs array<int>"), "forward-index")


class Lists:
    """Impact-sorted lists and forward index of a block of documents."""

    def __init__(self, batch: pa.RecordBatch, n_docs: int, n_terms: int, width: int):
        self.ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        doc = np.repeat(np.arange(len(n)), batch.column(2).value_lengths().to_numpy(zero_copy_only=False))
        term, tf = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3))
        m = 100 - 75 + (75 * n * n_docs) // n_terms
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        self.forward = np.zeros((len(n), width), np.int32)
        self.forward[doc, term] = impact
        order = np.lexsort((self.ids[doc], -impact, term))
        self.docs, self.impacts = doc[order], impact[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=width))])

    def search(self, term: np.ndarray, weight: np.ndarray, found: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the ``k`` best of ``found`` and this block, by the threshold algorithm."""
        score, ids = found
        start, end = self.starts[term], self.starts[term + 1]
        seen = np.zeros(len(self.ids), bool)
        depth, step = 0, STEP
        while True:
            at = start[:, None] + np.arange(depth, depth + step)
            met = np.zeros_like(seen)
            met[self.docs[at[at < end[:, None]]]] = True
            fresh = np.flatnonzero(met & ~seen)
            if len(fresh):
                seen |= met
                own = self.forward[np.ix_(fresh, term)].astype(np.int64) @ weight
                score, ids = np.concatenate([score, own[own > 0]]), np.concatenate([ids, self.ids[fresh[own > 0]]])
                top = best(score, ids, k)
                score, ids = score[top], ids[top]
            depth, step = depth + step, step * 2
            left = start + depth < end
            if not left.any() or len(score) == k and (self.impacts[start[left] + depth - 1] * weight[left]).sum() < score[-1]:
                return score, ids


def _pass(index: DataFrame, pairs: list, weights: dict[bytes, int], words: list[bytes], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc, score): the ``k`` best of each task for each item."""
    place, queries = {t: i for i, t in enumerate(words)}, {}
    for r in pairs:
        if weight := weights.get(bytes(r["term"]), 0):
            queries.setdefault(r["item"], []).append((place[bytes(r["term"])], weight * r["times"]))
    held = index.sparkSession.sparkContext.broadcast({i: np.array(x, np.int64).T for i, x in queries.items()})
    width = len(words)
    rows = min(4096, max(16, CELLS // max(1, width)))

    def run(batches):
        found = {i: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for i in held.value}
        for batch in chunks(batches, rows):
            lists = Lists(batch, n_docs, n_terms, width)
            for i, (term, weight) in held.value.items():
                found[i] = lists.search(term, weight, found[i], k)
        for i, (score, ids) in found.items():
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i)), pa.array(ids), pa.array(score)], ["item", "doc", "score"])

    return index.where(F.col("doc").isNotNull() & (F.size("terms") > 0)).mapInArrow(run, _FOUND)


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item id, rank, doc id, score): each item's ``k`` highest-scoring documents with a score above 0."""
    spark = docs.sparkSession
    pairs = saved(asked(items, item_col, item_text), "asked")
    blocks = max(1, math.ceil(pairs.count() / PAIRS))
    out = spark.createDataFrame([], _FOUND)
    for b in range(blocks):
        own = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()  # about PAIRS rows
        words = sorted({bytes(r["term"]) for r in own})
        if not words:
            continue
        index = forward_index(docs, words, id_col, text_col)
        n_docs, n_terms = index.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        df = {r[0]: r[1] for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # a row a word
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[i] + 1))) for i, t in enumerate(words) if i in df}
        found = _pass(index, own, weights, words, n_docs, n_terms, k)
        out = found if blocks == 1 else out.union(saved(found, "found"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def op11_ranked(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql() -> str:
    split = rf"regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return f"""
WITH t AS (SELECT doc_id, unnest({split}) AS term FROM documents),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), s AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM n),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({split}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t SEMI JOIN q USING (term) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, n_docs),
d AS (SELECT doc_id, 100 - 75 + (75 * n * n_docs) // n_terms AS m FROM n, s),
r AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN d USING (doc_id) GROUP BY ALL)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM r WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""


ORACLE_SQL = _sql()
