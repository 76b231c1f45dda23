"""What a review found missing, held against brute force."""

import itertools
import random

import numpy as np

from tabulon.llm import passages, pii, similar


def shingled(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_near_copies_of_jaccard(spark):
    import corpus_pipeline

    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    line = [rng.choice(vocabulary) for _ in range(40)]  # a common line alone makes no copy
    base = [[rng.choice(vocabulary) for _ in range(n)] for n in (60, 120, 240, 400)]
    texts = [b + line for b in base] + [line + ["x"] * n for n in (0, 6, 30)] + [["one"], ["one"], [], ["two", "words"], base[2][:60] * 4]
    for b in base:
        for every in (12, 20, 30, 45, 60, 90):  # edits from well below 0.8 up to near equality
            texts.append([f"e{i}" if i % every == every // 2 else w for i, w in enumerate(b + line)])
    rows = [(i * 2 + 1, " ".join(t)) for i, t in enumerate(texts)] + [(500, None), (None, "one")]
    sets = {i: shingled(t) for i, t in rows if i is not None}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if jaccard(sets[a], sets[b]) >= 0.8]
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert {r["doc_id"]: r["component"] for r in similar.near_copies(docs).collect()} == root
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, "")
    assert {r["doc_id"] for r in kept.collect()} == {i for i in root if root[i] == i} | {None}
    assert len(root) - len(set(root.values())) > 8


def test_iban_before_words_and_numbers():
    compact, grouped = "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"
    for iban in (compact, grouped, "NO93 8601 1117 947", "GB29NWBK60161331926819", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"):
        for behind in ("", " EUR 50", " BIC COBADEFF", " 4711", " X", " and more", ".", ", 12", " " + grouped):
            text = f"account {iban}{behind}"
            assert (8, 8 + len(iban)) in [(a, b) for k, a, b, _ in pii.find(text) if k == "iban"], text
            assert iban not in pii.redact(text)
    assert [(a, b) for k, a, b, _ in pii.find(f"AB12 3456 7890 1234 {grouped} OK") if k == "iban"] == [(20, 47)]
    assert not [k for k, *_ in pii.find(f"account {compact}EUR, DE89 3704 0044 0532 0130 01 EUR, {compact[:-1]} 5") if k == "iban"]
    assert pii.ibans("AA11 " * 20000) == []


def test_passages_with_insertions(spark):
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(4000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared, new = text(70), text(7)
    longer = shared[:35] + new + shared[35:]
    assert jaccard(shingled(" ".join(shared)), shingled(" ".join(longer))) >= 0.8
    for before, after in ((0, 0), (3, 20), (40, 30)):
        a, b = text(before) + shared + text(after), text(after) + longer + text(before)
        x, y = ((passages.shingles(" ".join(w).encode()) >> np.uint64(32)).astype(np.uint32) for w in (a, b))
        for one, two in ((x, y), (y, x)):
            found = list(passages.verified([one, two], 46))
            assert found and all(jaccard(set(one[s:e].tolist()), set(two[t:f].tolist())) >= 0.8 and min(e - s, f - t) >= 46 for _, s, e, t, f in found)
    rows = [(1, " ".join(shared)), (2, " ".join(longer)), (3, " ".join(text(90)))]
    got = {(r["doc_id"], r["class"]) for r in passages.passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(1, 1), (2, 1)}


def test_revisit_names_its_original():
    from tabulon.llm import archives

    of = lambda url, page: ({"URL": url, "Archive-date": "20240102030405", "IP-address": "0.0.0.0"}, f"HTTP/1.1 200 OK\r\nX-Page-Id: {page}".encode())
    fields = lambda record: dict(x.split(": ", 1) for x in record.split(b"\r\n\r\n")[0].decode().split("\r\n")[1:])
    first = fields(archives.warc_record(*of("http://a/", 7), b"body", None))
    again = fields(archives.warc_record(*of("http://b/", 3), b"body", {"page_id": 7, "url": "http://a/", "date": "20240102030405"}))
    assert (first["WARC-Type"], again["WARC-Type"]) == ("response", "revisit") and "WARC-Refers-To" not in first
    assert (again["WARC-Refers-To"], again["WARC-Refers-To-Target-URI"], again["WARC-Refers-To-Date"]) == (first["WARC-Record-ID"], first["WARC-Target-URI"], first["WARC-Date"])
    assert again["WARC-Record-ID"] != first["WARC-Record-ID"] and again["X-Refers-To-Page"] == "7"
