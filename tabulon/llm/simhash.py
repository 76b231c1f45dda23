"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word shingles. Two fingerprints within ``radius`` bits differ by
at most t_i bits in some part i, whenever the parts cover all bits and the sum of (t_i + 1) is radius + 1. Correlated bits share a
part, so that parts are nearly independent; dynamic programming picks the number of parts and the unequal t_i by the probe rows and
candidate pairs that they are estimated to make. Every fingerprint probes, for each part, its value there with each choice of t_i
bits masked; what shares a probe key is verified on all 64 bits.

Null and blank texts have fingerprint zero and are linked like any other. Equal texts meet as one distinct fingerprint, so copies are
never paired. A bucket yields a spanning forest of its links, never its pairs; buckets over BIG are split again on the remaining bits."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, grouped, saved, table, utf8, without
from .components import components

SEED, RADIUS, SHINGLE, BITS = 42, 3, 3, 64
#: Fingerprints of a bucket that are compared in one task; larger buckets are split on their remaining bits.
BIG = 20_000
_LANES = np.uint64(0x0101010101010101)


def fingerprints(batch: list[bytes], words: int = SHINGLE) -> np.ndarray:
    """Of UTF-8 texts. A-Z lower-cased; words between ASCII white space; bit set if in over half of the shingles' hashes."""
    hashed, sizes, h = [], [], xxhash.xxh64_intdigest
    for text in batch:
        w = text.lower().split()
        if len(w) < words:
            own = [h(b" ".join(w), SEED)] if w else []
        elif words == 3:
            own = [h(b"%b %b %b" % s, SEED) for s in zip(w, w[1:], w[2:], strict=False)]
        else:
            own = [h(b" ".join(s), SEED) for s in zip(*(w[i:] for i in range(words)), strict=False)]
        hashed += own
        sizes.append(len(own))
    n = np.array(sizes, np.int64)
    out = np.zeros(len(batch), np.uint64)
    if not hashed:
        return out
    a = np.array(hashed, np.uint64)
    full = np.flatnonzero(n)
    starts = (np.cumsum(n) - n)[full]
    # byte lanes hold sums of up to 255 rows, so each text is cut into runs of 255
    runs = -(-n[full] // 255)
    first = np.cumsum(runs) - runs
    cuts = np.repeat(starts - 255 * first, runs) + 255 * np.arange(runs.sum())
    counts = np.empty((len(full), BITS), np.int64)
    for j in range(8):
        lanes = np.add.reduceat((a >> np.uint64(j)) & _LANES, cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts[:, j::8] = np.add.reduceat(lanes, first, axis=0)
    bits = (2 * counts > n[full, None]).astype(np.uint8)
    out[full] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def with_fingerprint(docs: DataFrame, id_col: str, text_col: str, words: int = SHINGLE) -> DataFrame:
    """(id, fp long)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fingerprints(utf8(batch.column(1)), words).view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), run, f"id {kind}, fp bigint")


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each two bits, how many have both set: sums of one row per task."""

    def run(batches):
        n, total = 0, np.zeros((BITS, BITS))
        for batch in batches:
            x = np.unpackbits(batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n += len(x)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.ravel().astype(np.int64)], pa.list_(pa.int64()))], ["n", "both"])

    rows = fps.mapInArrow(run, "n bigint, both array<bigint>").select("n", F.posexplode("both")).groupBy("pos").agg(F.sum("n"), F.sum("col")).collect()  # 4096 rows
    both = np.zeros(BITS * BITS)
    for pos, _, s in rows:
        both[pos] = s
    return (rows[0][1] if rows else 0), both.reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """``m`` parts of near-equal size: each starts from the free bit with most correlation left and takes the bits that correlate most with it."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, parts = list(range(BITS)), []
    for k in range(m):
        size = BITS * (k + 1) // m - BITS * k // m
        part = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(part[0])
        while len(part) < size:
            part.append(max(free, key=lambda b: (corr[b, part].sum(), -b)))
            free.remove(part[-1])
        parts.append(sorted(part))
    return parts


def mask_of(bits) -> int:
    return int(sum(1 << b for b in bits))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def allocate(costs: list[list[float]], radius: int) -> tuple[float, list[int]]:
    """``costs[i][t + 1]``: of threshold t in part i, from -1 (part not probed). Least total with the sum of (t_i + 1) = radius + 1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (total, picked) in best.items():
            for spent, cost in enumerate(own[: radius + 2 - used]):
                if (found := total + cost) < step.get(used + spent, (float("inf"),))[0]:
                    step[used + spent] = (found, [*picked, spent - 1])
        best = step
    return best[radius + 1]


def plan(fps: DataFrame, radius: int = RADIUS, parts_tried=(2, 3, 4)) -> list[int]:
    """Masks of the bits that a probe key keeps: for each part, its bits without each choice of t_i of them."""
    n, both = bit_moments(fps.select("fp"))
    differ = 2 * (p := np.diag(both) / max(n, 1)) * (1 - p)
    tried = [correlated_parts(n, both, m) for m in parts_tried]
    masks = sorted({mask_of(part) for parts in tried for part in parts})
    keyed = fps.select(F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(x))) for x in masks])))
    same = {r["pos"]: float(r["pairs"]) for r in keyed.groupBy("pos", "col").count().groupBy("pos").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2).alias("pairs")).collect()}
    best = (float("inf"), [], [])
    for parts in tried:
        costs = []
        for part in parts:
            pairs, own = same.get(masks.index(mask_of(part)), 0.0), [0.0]
            for t in range(radius + 1):
                keys = comb(len(part), t)
                # a masked bit multiplies the pairs by 1 / P(two fingerprints agree on it), here with the mean bit of the part
                own.append(n * keys + keys * (pairs + n * n / 2 * 2.0 ** -len(part)) / max(1e-3, 1 - float(differ[part].mean())) ** t)
            costs.append(own)
        total, picked = allocate(costs, radius)
        best = min(best, (total, parts, picked), key=lambda x: x[0])
    return [mask_of(set(part) - set(gone)) for part, t in zip(best[1], best[2], strict=True) if t >= 0 for gone in combinations(part, t)]


def forest(fp: np.ndarray, ids: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning forest of the links among distinct fingerprints: each found one leaves the rest, so no pair is listed twice."""
    out = []
    while len(fp) > 1:
        todo, fp, ids = [(fp[0], ids[0])], fp[1:], ids[1:]
        while todo and len(fp):
            x, i = todo.pop()
            near = np.bitwise_count(fp ^ x) <= radius
            if near.any():
                out.append((np.full(int(near.sum()), i), ids[near]))
                todo += zip(fp[near], ids[near], strict=True)
                fp, ids = fp[~near], ids[~near]
    return out


def links(fps: DataFrame, masks: list[int], radius: int = RADIUS, big: int = BIG) -> DataFrame:
    """``fps`` (fp distinct, rep) -> (a, b): reps of linked fingerprints, enough of them to connect whatever is linked."""
    keyed = fps.select("fp", "rep", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(x))) for x in masks])).alias("k", "v"))
    keyed = keyed.select("fp", "rep", F.lit(0).alias("kept"), F.col("k").alias("part"), F.col("v"))
    kept = list(masks)
    done = None
    for _ in range(3):
        crowded = saved(keyed.groupBy("part", "v").count().where(F.col("count") > big).drop("count"), "crowded")
        if crowded.isEmpty():
            break
        # what agrees on a part's bits and is linked agrees on one of radius + 1 blocks of the other bits
        cool = keyed.join(crowded, ["part", "v"], "left_anti")
        done = cool if done is None else done.unionByName(cool)
        finer, mapping = [], {}
        for at, mask in enumerate(kept):
            rest = [b for b in range(BITS) if not mask >> b & 1]
            if len(rest) > radius:
                mapping[at] = range(len(finer), len(finer) + radius + 1)
                finer += [mask | mask_of(rest[k :: radius + 1]) for k in range(radius + 1)]
        hot = keyed.join(crowded, ["part", "v"], "left_semi")
        choice = F.coalesce(*[F.when(F.col("part") == at, F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(signed(finer[k]))).alias("v")) for k in ks])) for at, ks in mapping.items()])
        keyed = saved(hot.select("fp", "rep", (F.col("kept") + 1).alias("kept"), F.explode(choice).alias("x")).select("fp", "rep", "kept", "x.part", "x.v"), "finer")
        kept = finer
    keyed = keyed if done is None else done.unionByName(keyed)

    def run(batches):
        for t in grouped(batches, ["kept", "part", "v"]):
            fp, rep = t["fp"].to_numpy().view(np.uint64), t["rep"].to_numpy()
            level, part, v = (t[c].to_numpy() for c in ("kept", "part", "v"))
            ends = np.flatnonzero((v[1:] != v[:-1]) | (part[1:] != part[:-1]) | (level[1:] != level[:-1])) + 1
            edges = [e for s, t_ in zip([0, *ends], [*ends, len(v)], strict=True) if t_ - s > 1 for e in forest(fp[s:t_], rep[s:t_], radius)]
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*edges, strict=True)], ["a", "b"])

    return keyed.repartition("kept", "part", "v").sortWithinPartitions("kept", "part", "v").mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, fp, component): component is the least id reachable over links of ``radius`` bits or fewer. Ids are longs; rows with a null id
    get a fingerprint and no component. Repeated ids and rows are kept as they come. An empty table gives an empty result."""
    marked = saved(with_fingerprint(docs, id_col, text_col, words), "fingerprints")
    fps = saved(marked.where("id is not null").groupBy("fp").agg(F.min(F.col("id").cast("long")).alias("rep")), "distinct")
    edges = links(fps, plan(fps, radius), radius)
    named = components(edges).select(F.col("node").alias("rep"), "root")
    roots = saved(fps.join(named, "rep", "left").select("fp", F.coalesce("root", "rep").alias("component")), "roots")
    out = marked.join(roots, "fp", "left").select("id", "fp", F.when(F.col("id").isNotNull(), F.col("component")).alias("component"))
    return out.withColumnRenamed("id", id_col)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose component has a smaller id. All columns stay."""
    return without(docs, id_col, near_duplicates(docs, id_col, text_col).where(F.col("component") != F.col(id_col)).select(id_col))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
