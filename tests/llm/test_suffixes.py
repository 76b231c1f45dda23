"""Exact substring removal: groups that are split over tasks, thousands of members, hashes that deceive, planted passages."""

import random

import numpy as np
import pytest

from tabulon.llm import suffixes

LETTERS = "abcdefghijklmnopqrstuvwxyz "


def gone(texts, length):
    """Bytes covered by a string of ``length`` bytes that also starts elsewhere."""
    where = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            where.setdefault(t[p : p + length], []).append((i, p))
    out = [np.zeros(len(t), bool) for t in texts]
    for own in where.values():
        for i, p in own if len(own) > 1 else ():
            out[i][p : p + length] = True
    return out


def noise(rng, n):
    return "".join(rng.choice(LETTERS) for _ in range(n))


def held(spark, rows, **how):
    got = [(r["doc_id"], r["n_bytes"], bytes(r["kept"])) for r in suffixes.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5), **how).collect()]
    texts = [(t or "").encode() for _, t in rows]
    want = [(i, len(t), bytes(np.frombuffer(t, np.uint8)[~g])) for (i, _), t, g in zip(rows, texts, gone(texts, how["length"]), strict=True)]
    key = lambda r: (r[0] is None, r)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("large", [6, 2048])
def test_groups_of_near_copies(spark, large):
    rng = random.Random(8)
    base, other = noise(rng, 400), noise(rng, 130)
    rows = []
    for i in range(90):
        t = list(base)
        for _ in range(rng.randint(0, 4)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        rows.append((i, "".join(t)[rng.randint(0, 60) : 400 - rng.randint(0, 60)]))
    rows += [(100 + i, noise(rng, rng.randint(0, 30)) + other[rng.randint(0, 40) :] + noise(rng, 20)) for i in range(60)]
    rows += [(None, base), (None, None), (7, base), (200, ""), (201, other[:39]), (202, "ab" * 300), (203, base + base), (204, "é" * 80)]
    held(spark, rows, length=40, gram=12, large=large)


def test_thousands_share_a_passage(spark):
    rng = random.Random(9)
    passage = noise(rng, 130)
    rows = [(i, noise(rng, 12 + i % 5) + passage + noise(rng, 15)) for i in range(3000)] + [(5000 + i, noise(rng, 10) + passage[:99] + noise(rng, 20)) for i in range(20)]
    held(spark, rows, length=100, gram=32, large=500)


def test_hashes_that_deceive(monkeypatch):
    rng = random.Random(2)
    right = suffixes.Hashes.of
    for bits in (1, 2, 5):
        monkeypatch.setattr(suffixes.Hashes, "of", lambda self, a, b, m=np.uint64((1 << bits) - 1): right(self, a, b) & m)
        for n in (8, 150):
            core = bytes(rng.choice(b"ab") for _ in range(12))
            lefts = [bytes(rng.choice(b"ab") for _ in range(14)) + b"abababababab"[rng.randint(0, 12) :] for _ in range(n)]
            rights = [core + b"babababababa"[: rng.randint(0, 12)] + bytes(rng.choice(b"ab") for _ in range(14)) for _ in range(n)]
            before, after = suffixes.repeats(np.zeros(n, np.int64), lefts, rights, 40)
            assert list(zip(before.tolist(), after.tolist(), strict=True)) == suffixes._exact(lefts, rights, 40)


def test_planted_passages_of_words(spark):
    """A passage goes where it has LENGTH bytes or more: shorter ones, of however many words, stay by contract."""
    rng = random.Random(4)
    words = [noise(rng, rng.randint(2, 9)).replace(" ", "") or "w" for _ in range(500)]
    long_, short = " ".join(rng.choice(words) for _ in range(90)), " ".join(["ab"] * 3 + [rng.choice(words)[:3] for _ in range(60)])
    assert len(long_) > 400 > len(short)
    clean = " ".join(rng.choice(words) for _ in range(300))
    rows = [(i, noise(rng, 100) + long_ + noise(rng, 100)) for i in range(3)] + [(10 + i, noise(rng, 60) + short + noise(rng, 60)) for i in range(3)] + [(20, clean)]
    got = {r["doc_id"]: len(r["kept"]) for r in suffixes.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: len(t.encode()) - (len(long_.encode()) if i < 10 else 0) for i, t in rows}


def test_members_are_not_shuffled_for_the_large_groups(spark):
    """What goes to smaller groups' tasks is shuffled once; the larger groups' members are told by a broadcast of their few keys, whatever the sizes seem to be."""
    sizes = {1: 1, 2: 2, 3: 7, 4: 5, 5: 9}
    members = spark.createDataFrame([(g, i) for g, n in sizes.items() for i in range(n)], "g bigint, i bigint")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        few, many, any_many = suffixes._divided(members, members, 5)
        plan = many._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
        assert any_many and sorted(tuple(r) for r in many.collect()) == [(g, i) for g in (3, 5) for i in range(sizes[g])]
        assert sorted(tuple(r) for r in few.collect()) == [(g, i) for g in (2, 4) for i in range(sizes[g])]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
