"""The near-duplicate stage of the pipeline: SimHash links and those of shingles, together."""

import itertools
import random

import numpy as np

from tabulon.llm import components, simhash

from test_findings import jaccard, shingled


def test_stage_links_by_fingerprints(spark):
    import corpus_pipeline

    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(2000)]
    line = [rng.choice(vocabulary) for _ in range(200)]
    texts = [" ".join(w) for w in (line, [rng.choice(vocabulary) for _ in range(80)], line[:165], line[:100] + line[102:])]
    # the same three-word shingles by far most often, so one fingerprint; many other five-word shingles, so no Jaccard similarity
    phrase = "alpha beta gamma"
    pair = [" ".join([phrase] * 60 + [rng.choice(vocabulary) for _ in range(24)]) for _ in range(2)]
    rows = [(3 * i + 2, t) for i, t in enumerate([*texts, *pair])] + [(90, None), (91, "  "), (None, pair[0])]
    known = {i: t for i, t in rows if i is not None}
    fp = {i: int(simhash.fingerprints([(t or "").encode()])[0]) for i, t in known.items()}
    near = lambda a, b: np.bitwise_count(np.uint64(fp[a] ^ fp[b])) <= 3
    alike = lambda a, b: jaccard(shingled(known[a]), shingled(known[b])) >= 0.8
    assert near(14, 17) and not alike(14, 17) and any(alike(a, b) and not near(a, b) for a, b in itertools.combinations(known, 2))
    root = {i: i for i in known}
    for _ in known:
        for a, b in itertools.combinations(sorted(known), 2):
            if near(a, b) or alike(a, b):
                root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert {r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, docs, "").collect()} == {i for i in root if root[i] == i} | {None}


def test_merged_components(spark):
    one = spark.createDataFrame([(1, 1), (5, 1), (6, 6), (9, 6), (7, 7), (8, 8)], "id bigint, component bigint")
    two = spark.createDataFrame([(1, 1), (5, 5), (6, 5), (9, 9), (7, 7), (8, 7)], "id bigint, component bigint")
    assert {tuple(r) for r in components.merged([one, two]).collect()} == {(1, 1), (5, 1), (6, 1), (9, 1), (7, 7), (8, 7)}
    assert components.merged([one.limit(0), two.limit(0)]).count() == 0
