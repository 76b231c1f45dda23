"""Near copies by the Jaccard similarity of word shingles.

A text is the set of its shingles of ``words`` words. Each distinct set has BANDS keys of ROWS least hashes; two sets of Jaccard similarity
0.8 share no key in about three of a million cases. Sets that share a key meet and are compared on all their shingles, so what is linked
has the similarity asked for. A group yields a spanning forest of its links, never its pairs, and of groups with the same members one is
compared. A fingerprint of 64 bits cannot stand for this: at 0.8 two of them differ by ten bits on average and by 18 at times, which
takes thousands of probe keys for each.

Texts shorter than a shingle are one shingle of their own; null and blank texts are empty sets and equal. Equal sets meet once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, grouped, saved, utf8, without
from .components import components

WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 24, 4
_SEEDS = np.random.default_rng(8_080).integers(1, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the distinct shingles, A-Z lower-cased, words between ASCII white space."""
    w = text.lower().split()
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w))] if w else [], np.uint64)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(s)) for s in zip(*(w[i:] for i in range(words)), strict=False)), np.uint64, len(w) - words + 1))


def digest(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each of the sets, none of which is empty."""
    h, sizes = np.concatenate(sets), np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band, np.uint64)
        for seed in _SEEDS[band * ROWS : (band + 1) * ROWS]:
            x = (h ^ seed) * _MIX
            x = (x ^ (x >> np.uint64(32))) * _STEP
            key = (key ^ np.minimum.reduceat(x ^ (x >> np.uint64(29)), starts)) * _MIX
            key ^= key >> np.uint64(32)
        out[:, band] = key
    return out


def forest(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """Spanning forest of the links among the sets: each found one leaves the rest, so no pair is listed twice."""
    out, rest = [], list(range(len(sets)))
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and rest:
            i = todo.pop()
            x, size = sets[i], np.array([len(sets[j]) for j in rest])
            y = np.concatenate([sets[j] for j in rest])
            same = np.add.reduceat(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y, np.cumsum(size) - size, dtype=np.int64)
            near = same >= similarity * (len(x) + size - same) - 1e-9
            if near.any():
                found = [j for j, ok in zip(rest, near, strict=True) if ok]
                out += [(i, j) for j in found]
                todo += found
                rest = [j for j, ok in zip(rest, near, strict=True) if not ok]
    return out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(id, component): component is the least id reachable over links of ``similarity`` or more. Ids are longs; rows with a null id are
    left out. Repeated ids and rows are kept as they come. An empty table gives an empty result."""
    own = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, marks, keys = batch.column(0), [], []
        for a in range(0, batch.num_rows, 500):
            sets = [shingle_set(x, words) for x in utf8(batch.column(1).slice(a, 500))]
            full = [x for x in sets if len(x)]
            made = iter(band_keys(full).view(np.int64)) if full else iter(())
            marks += [digest(x) for x in sets]
            keys += [next(made) if len(x) else np.zeros(0, np.int64) for x in sets]
        return pa.RecordBatch.from_arrays([ids, pa.array(marks, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "d", "keys"])

    marked = saved(arrow_map(own, mark, "id bigint, d binary, keys array<bigint>"), "sets")
    reps = saved(marked.groupBy("d").agg(F.min("id").alias("rep"), F.first("keys").alias("keys")), "distinct-sets")
    keyed = reps.select("d", "rep", F.explode("keys").alias("key"))
    met = keyed.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("d")).alias("x"), F.bit_xor(F.xxhash64("d", F.lit(1))).alias("y")).where("n > 1")
    groups = saved(met.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "groups")
    members = saved(keyed.join(groups, "key"), "members")
    need = members.select(F.col("rep").alias("id")).distinct()

    def cut(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                sets = [shingle_set(x, words) for x in utf8(batch.column(0).slice(a, 200))]
                yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["d", "own"])

    sets = own.join(need, "id", "left_semi").select("text").mapInArrow(cut, "d binary, own binary").dropDuplicates(["d"])

    def link(batches):
        for t in grouped(batches, ["key"]):
            key, rep = t["key"].to_numpy(), t["rep"].to_numpy()
            held = [np.frombuffer(x, np.uint64) for x in t["own"].to_pylist()]
            ends = np.flatnonzero(key[1:] != key[:-1]) + 1
            edges = [(rep[s + i], rep[s + j]) for s, e in zip([0, *ends], [*ends, len(key)], strict=True) for i, j in forest(held[s:e], similarity)]
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.int64)) for x in zip(*edges, strict=True)], ["a", "b"])

    edges = members.join(sets, "d").select("key", "rep", "own").repartition("key").sortWithinPartitions("key").mapInArrow(link, "a bigint, b bigint")
    named = components(edges).select(F.col("node").alias("rep"), "root")
    roots = saved(reps.join(named, "rep", "left").select("d", F.coalesce("root", "rep").alias("component")), "roots")
    return marked.join(roots, "d").select(F.col("id").alias(id_col), "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose component has a smaller id. All columns stay."""
    return without(docs, id_col, near_copies(docs, id_col, text_col).where(F.col("component") != F.col(id_col)).select(id_col))
