"""Queries that SQL cannot express against plain NumPy and Python over the same tables."""

import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash

from tabulon.plans import catalogue

DIR = next((p for p in ("/root/testdata/sf0.001",) if Path(p).is_dir()), None)
pytestmark = pytest.mark.skipif(DIR is None, reason="no tables")


def murmur(data: bytes, seed: int = 42) -> int:
    """MurmurHash3, 32 bits, signed."""
    m, h = 0xFFFFFFFF, seed

    def mixed(k):
        k = k * 0xCC9E2D51 & m
        return ((k << 15 | k >> 17) & m) * 0x1B873593 & m

    whole = len(data) // 4 * 4
    for i in range(0, whole, 4):
        h ^= mixed(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & m) * 5 + 0xE6546B64 & m
    if data[whole:]:
        h ^= mixed(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
        h = (h ^ h >> shift) * by & m
    return h - (1 << 32) if h >> 31 else h


def vectors(spark):
    rows = spark.read.parquet(f"{DIR}/embeddings.parquet").orderBy("vec_id").collect()
    return [r["vec_id"] for r in rows], np.array([r["embedding"] for r in rows], float)


def test_hash_embedding(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}
    got = {r["doc_id"]: r["embedding"] for r in catalogue.QUERIES["hash_embedding"](spark, DIR).collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        want = np.zeros(64)
        for w, n in Counter(re.findall(r"[^\W_]+", text.strip().lower())).items():
            want[murmur(w.encode()) % 64] += n
        assert np.allclose(got[k], want / (np.linalg.norm(want) or 1), atol=2e-6), k


def test_plot_sample(spark):
    rows = {r["event_id"]: r["value"] for r in spark.read.parquet(f"{DIR}/events.parquet").collect()}

    def place(k):
        first = xxhash.xxh64_intdigest(k.to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest((42).to_bytes(4, "little"), first)
        return h - (1 << 64) if h >> 63 else h, k

    want = {k: rows[k] for k in sorted(rows, key=place)[:5000]}
    assert {r["event_id"]: r["value"] for r in catalogue.QUERIES["plot_sample"](spark, DIR).collect()} == want


def test_principal_components(spark):
    ids, x = vectors(spark)
    axes = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:2]
    got = {r["vec_id"]: r["projected"] for r in catalogue.QUERIES["principal_components"](spark, DIR).collect()}
    y = np.array([got[i] for i in ids])
    for i, axis in enumerate(axes):  # up to sign
        assert min(np.abs(y[:, i] - x @ axis).max(), np.abs(y[:, i] + x @ axis).max()) < 1e-6


def settled(x, labels) -> float:
    """Share of rows whose own centre is the nearest one."""
    names = sorted(set(labels))
    centres = np.array([x[labels == c].mean(0) for c in names])
    near = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
    return float(np.mean(np.array(names)[near] == labels))


def test_cluster_labels(spark):
    ids, x = vectors(spark)
    got = {r["vec_id"]: r["cluster_label"] for r in catalogue.QUERIES["cluster_labels"](spark, DIR).collect()}
    labels = np.array([got[i] for i in ids])
    assert set(labels) == {0, 1, 2, 3} and settled(x, labels) > 0.99
    inside = sum(((x[labels == c] - x[labels == c].mean(0)) ** 2).sum() for c in range(4))
    rng = np.random.default_rng(0)
    best = np.inf
    for _ in range(10):  # plain restarts
        c = x[rng.choice(len(x), 4, replace=False)]
        for _ in range(100):
            near = ((x[:, None] - c) ** 2).sum(2).argmin(1)
            c = np.array([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(4)])
        best = min(best, ((x - c[near]) ** 2).sum())
    assert inside <= best * 1.005


def test_analysis(spark):
    rows = catalogue.QUERIES["analysis"](spark, DIR).collect()
    keys = {r["c_custkey"] for r in spark.read.parquet(f"{DIR}/customer.parquet").collect()}
    assert len(rows) == len(keys) and {r["c_custkey"] for r in rows} == keys
    x, labels = np.array([r["latent"] for r in rows]), np.array([r["cluster_label"] for r in rows])
    assert len(set(labels)) >= 2 and settled(x, labels) > 0.98


def test_latent_scatter(spark):
    ids, _ = vectors(spark)
    labels = {r["vec_id"]: r["label"] for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()}
    got = catalogue.QUERIES["latent_scatter"](spark, DIR).collect()
    assert sorted(r["vec_id"] for r in got) == ids and all(r["label"] == labels[r["vec_id"]] and np.isfinite([r["x"], r["y"]]).all() for r in got)
