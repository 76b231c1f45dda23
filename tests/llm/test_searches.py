"""Ranked search, nearest neighbours and hard negatives against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.llm import negatives, permutations, ranked, vectors

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(a): chr(a + 32) for a in range(65, 91)})
DOCS = "doc_id bigint, text string, n bigint, score string, terms string, rank int"
ITEMS = "item_id bigint, text string, w string"


def said(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_ranked(docs, items, k=10):
    held = [(i, Counter(said(t)), len(said(t))) for i, t in docs]
    held = [x for x in held if x[2]]
    n, total = len(held), sum(x[2] for x in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, Counter()).update(said(t))
    out = []
    for i, q in asked.items():
        found = []
        for d, c, size in held:
            m = 100 - 75 + 75 * size * n // total
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in q.items() if t in c)
            if s > 0 and d is not None:
                found.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(found)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    words = ["der", "Fluss", "ÄRA", "ära", "x1", "don't", "naïve", "日本", "a_b"] + [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(words[j] for j in np.minimum(rng.zipf(1.3, rng.integers(1, 60)) - 1, len(words) - 1))) for i in range(400)]
    docs += [(400 + i, docs[7][1]) for i in range(150)] + [(600, None), (601, ""), (602, " -- \x7f "), (603, "Fluss " * 30_000), (None, "w1 w2 w3"), (7, "w5 w6"), (7, "w5 w6")]
    items = [(i, docs[3 * i][1].upper() if i % 3 else docs[3 * i][1] + " w1 w1") for i in range(30)] + [(40, None), (41, ""), (42, "unheard of"), (None, "w1"), (5, "w9 w10"), (43, "Fluss")]
    return docs, items


@pytest.mark.parametrize("pairs", [ranked.PAIRS, 40])
def test_ranked_search(spark, texts, monkeypatch, pairs):
    monkeypatch.setattr(ranked, "PAIRS", pairs)
    docs, items = texts
    df = spark.createDataFrame([(i, t, 1, "s", "t", 2) for i, t in docs], DOCS).repartition(5)
    got = ranked.search(df, spark.createDataFrame([(i, t, "w") for i, t in items], ITEMS))
    assert sorted(map(tuple, got.collect())) == brute_ranked(docs, items)


def test_threshold_stops_early_and_keeps_ties():
    """Blocks of one document a list entry: ties at the k-th place are all met, lists are not read to their ends."""
    import pyarrow as pa

    n = 2000
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)[::-1].copy()), pa.array(np.full(n, 10)), pa.array([[0, 1] if i < 50 else [0] for i in range(n)], pa.list_(pa.int32())), pa.array([[3, 2] if i < 50 else [1] for i in range(n)], pa.list_(pa.int32()))], ["doc", "n", "terms", "tfs"])
    lists = ranked.Lists(batch, n, 10 * n, 2)
    score, ids = lists.search(np.array([0, 1]), np.array([5, 7]), (np.zeros(0, np.int64), np.zeros(0, np.int64)), 10)
    assert ids.tolist() == list(range(n - 50, n - 40)) and len(set(score)) == 1
    met = []
    lists.forward = type("Met", (np.ndarray,), {"__getitem__": lambda s, k: (met.append(len(k[0]) if isinstance(k, tuple) and np.ndim(k[0]) else 0), np.asarray(s)[k])[1]})(lists.forward.shape, np.int32, lists.forward)
    lists.search(np.array([0, 1]), np.array([5, 7]), (np.zeros(0, np.int64), np.zeros(0, np.int64)), 10)
    assert sum(met) < 200


def test_ranked_search_of_empty_tables(spark, texts):
    docs, items = texts
    some, none = spark.createDataFrame([(1, "w1", 1, "s", "t", 2)], DOCS), spark.createDataFrame([], DOCS)
    ask, still = spark.createDataFrame([(1, "w1 w2", "w")], ITEMS), spark.createDataFrame([], ITEMS)
    assert ranked.search(none, ask).collect() == ranked.search(some, still).collect() == ranked.search(none, still).collect() == []
    assert [tuple(r) for r in ranked.search(some, ask).collect()] == brute_ranked([(1, "w1")], [(1, "w1 w2")])


VECTORS = "vec_id bigint, embedding array<float>, label int, id string, v string, at int"


def made(n=3000, seed=3, copies=0.3):
    """Clusters of vectors of unlike norms; a third of all rows are copies of one."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(12, 24))[rng.integers(0, 12, n)] + 0.7 * rng.normal(size=(n, 24))
    x *= rng.uniform(0.5, 1.5, n)[:, None]
    x[rng.random(n) < copies] = x[0]
    return x.astype(np.float32)


def frame(spark, x, labels=None, ids=None, more=()):
    rows = [(int(i), [float(c) for c in r], None if labels is None else int(labels[j]), "clash", "clash", 1) for j, (i, r) in enumerate(zip(range(len(x)) if ids is None else ids, x, strict=True))]
    return spark.createDataFrame([*rows, *more], VECTORS).repartition(6)


def near(x, i, k=20):
    s = x.astype(float) @ x[i].astype(float)
    s[i] = -np.inf
    return s, np.lexsort((np.arange(len(x)), -s))[:k]


ODD = [(9000, None, 1, "", "", 1), (9020, [], 1, "", "", 1), (9040, [0.0] * 24, 1, "", "", 1), (9060, [1.0, None] + [0.0] * 22, 1, "", "", 1), (9080, [float("nan")] * 24, 1, "", "", 1), (9100, [float("inf")] * 24, 1, "", "", 1), (9120, [1.0] * 5, 1, "", "", 1), (None, [1.0] * 24, 1, "", "", 1)]


@pytest.mark.parametrize("block", [vectors.BLOCK, 256])
def test_nearest_recall(spark, monkeypatch, block):
    monkeypatch.setattr(permutations, "BLOCK", block)
    x = made()
    df = frame(spark, x, more=[*ODD, (3, [float(c) for c in x[3]], None, "again", "", 2)])
    got = {}
    for r in permutations.nearest(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r["query_id"], []).append(r)
    assert sorted(got) == list(range(0, len(x), 20))
    hits = []
    for i, rows in got.items():
        rows.sort(key=lambda r: r["rank"])
        s, top = near(x, i)
        assert [r["rank"] for r in rows] == list(range(1, 21)) and i not in {r["vec_id"] for r in rows} and len({r["vec_id"] for r in rows}) == 20
        assert np.allclose([r["score"] for r in rows], s[[r["vec_id"] for r in rows]], rtol=1e-12)
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
        hits.append(len({r["vec_id"] for r in rows} & {*top.tolist()}) / 20)
    assert np.mean(hits) >= 0.9
    copies = np.flatnonzero((x == x[0]).all(axis=1))
    assert [r["vec_id"] for r in got[0]] == near(x, 0)[1].tolist() and set(near(x, 0)[1]) <= {*copies.tolist()} | {r["vec_id"] for r in got[0]}


def test_nearest_of_few_rows(spark):
    x = made(5, copies=0)
    got = permutations.nearest(frame(spark, x, more=ODD), F.col("id") % 2 == 0).collect()
    for i in (0, 2, 4):
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == near(x, i, 4)[1].tolist()
    one = frame(spark, x[:1])
    assert permutations.nearest(one, F.col("id") == 0).collect() == permutations.nearest(one.where("false"), F.col("id") == 0).collect() == []
    assert permutations.nearest(frame(spark, x), F.col("id") == 77).collect() == []
    assert permutations.nearest(frame(spark, np.zeros((3, 24))), F.col("id") == 0).collect() == []


def test_footrule_of_postings():
    """What the postings add up is the footrule distance with absent pivots at the end."""
    rng = np.random.default_rng(1)
    order = np.argsort(rng.random((40, 30)), axis=1)[:, :8]
    starts, rows, places = permutations.postings(order, 30)
    block = permutations.Block({"n": 40, "ids": np.arange(40).tobytes(), "sizes": np.ones(40, np.int32).tobytes(), "vectors": b"", "starts": starts.tobytes(), "rows": rows.tobytes(), "places": places.tobytes()}, "f4", 1)
    place = lambda o: np.array([{*o} and ([*o].index(p) if p in o else 8) for p in range(30)])
    for q in order[:5]:
        true = np.array([np.abs(place(q) - place(o)).sum() for o in order])
        assert (8 * 9 - 2 * (block.ranked(q) // permutations.BLOCK) == true).all()


def brute_negatives(x, labels, every, positives=5, k=3):
    w = np.floor(256 * x.astype(float)).astype(np.int64)
    out, ids = [], np.arange(len(x))
    for a in ids[ids % every == 0]:
        s = w @ w[a]
        order = [i for i in sorted(ids, key=lambda i: (-s[i], i)) if i != a]
        for p in [i for i in order if labels[i] == labels[a]][:positives]:
            fits = [i for i in order if labels[i] != labels[a] and 50 * s[p] <= 100 * s[i] <= 95 * s[p]][:k]
            out += [(a, p, r + 1, i, s[p], s[i]) for r, i in enumerate(fits)]
    return sorted(tuple(map(int, r)) for r in out)


@pytest.mark.parametrize(("block", "scale"), [(vectors.BLOCK, 1), (100, 1), (100, 2e4)])
def test_hard_negatives(spark, monkeypatch, block, scale):
    monkeypatch.setattr(negatives, "BLOCK", block)
    x = made(900) * np.float32(scale)
    labels = np.random.default_rng(2).integers(0, 4, len(x))
    labels[5] = 99
    df = frame(spark, x, labels, more=[*[r for r in ODD if r[0] != 9040], (9140, [1.0] * 24, None, "", "", 1), (10, [float(c) for c in x[10]], int(labels[10]), "again", "", 2)])
    got = sorted(map(tuple, negatives.mine(df, F.col("id") % 5 == 0).collect()))
    assert got == brute_negatives(x, labels, 5) and got


def test_hard_negatives_of_few_rows(spark):
    x, labels = made(4, copies=0), np.zeros(4, int)
    assert negatives.mine(frame(spark, x, labels), F.col("id") == 0).collect() == []
    assert negatives.mine(frame(spark, x, labels).where("false"), F.col("id") == 0).collect() == []
    with pytest.raises(ValueError, match="do not fit"):
        negatives.mine(frame(spark, x * np.float32(1e20), labels), F.col("id") == 0)
