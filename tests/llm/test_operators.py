"""The corpus operators against brute force on small fixtures: nulls, empty and long texts, copies, empty tables, clashing columns."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tabulon.llm import archives, audio, bpe_reuse, components, decontaminate, passages, pii, quality, similar, simhash, simple8b, suffixes

WORDS = ["river", "stone", "Märchen", "the", "of", "día", "quick", "brown", "fox", "jumps", "over", "lazy", "dog", "naïve", "zone", "apple", "tree", "house", "light", "water", "I'm", "it's", "x2", "3,000", "(see)", "foo-bar", "END.", "été"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=7):
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(1, 200)) for _ in range(25)]
    odd = [None, "", " ", "   a  b\n\n c\t", " x y　z ", "ﬁne ＡＢＣ İstanbul ΣΑΣ", "🙂🙂 👩‍👩‍👧 á ", "<|endoftext|> in <|startoftext|>text", "a" * 5000, "a b " * 2000, "\x00 \x01 end", "tail  ", "  lead", "1234567890" * 60]
    long_ = prose(rng, 3000)
    texts = base + odd + [base[0], base[0], base[1] + " more", long_, long_[5000:9000] + " x " + base[2], base[3] * 3]
    return [(i * 3 + 1, t, "en", "s", 0) for i, t in enumerate(texts)]


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{d}/documents.parquet")
    return d


def tokenizer(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_tokens_round_trip(spark, folder):
    tok, start, want = tokenizer("byte_bpe_50k.json"), 0, {}
    for i, t, *_ in corpus():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r[0]: tuple(r[1:]) for r in simple8b.op1_simple8b(spark, folder).collect()} == want


@pytest.mark.parametrize("values", [[], [0] * 5000, [2**63, 1, 2**60 - 1, 2**60, 0], list(range(3000))])
def test_simple8b_words(values):
    x = np.array(values, np.uint64)
    words, at = simple8b.pack(x)
    assert (simple8b.unpack(words) == x).all()
    for k, (a, z) in enumerate(zip(at, [*at[1:], len(words)], strict=False)):
        assert (simple8b.unpack(words[int(a) : int(z)]) == x[k * simple8b.BLOCK : (k + 1) * simple8b.BLOCK]).all()


def test_bpe_reuse(spark, folder):
    tok = tokenizer("word_bpe_49k.json")
    want = {}
    for i, t, *_ in corpus():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r[0]: tuple(r[1:]) for r in bpe_reuse.op5_bpe(spark, folder).collect()} == want


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_contract(spark, folder):
    fp = {i: fingerprint(t) for i, t, *_ in corpus()}
    want = roots([(a, b) for a, b in itertools.combinations(fp, 2) if (fp[a] ^ fp[b]).bit_count() <= 3], fp)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op4_simhash(spark, folder).collect()}
    assert got == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


@pytest.mark.parametrize("big", [20_000, 50])
def test_simhash_links_all_near_fingerprints(spark, big):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(60)]
    fps = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(12)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)], "fp bigint, rep bigint")
    edges = [(r["a"], r["b"]) for r in simhash.links(df, simhash.plan(df), big=big).collect()]
    want = roots([(a, b) for a, b in itertools.combinations(range(len(fps)), 2) if (fps[a] ^ fps[b]).bit_count() <= 3], range(len(fps)))
    assert roots(edges, range(len(fps))) == want


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = roots(edges, {x for e in edges for x in e})
    tied = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: r for n, r in want.items() if n in tied}


def brute_suffix(texts, length):
    where = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - length + 1):
            where.setdefault(t[p : p + length], []).append((i, p))
    gone = [np.zeros(len(t), bool) for t in texts]
    for own in where.values():
        for i, p in own if len(own) > 1 else ():
            gone[i][p : p + length] = True
    return gone


@pytest.mark.parametrize(("length", "gram"), [(40, 12), (400, 128)])
def test_suffixes(spark, docs, length, gram):
    rows = corpus()
    texts = [(t or "").encode() for _, t, *_ in rows]
    got = {r["doc_id"]: r for r in suffixes.deduplicated(docs, length=length, gram=gram).collect()}
    for (i, *_), t, g in zip(rows, texts, brute_suffix(texts, length), strict=True):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], g.astype(int), [0]]))).reshape(-1, 2)
        assert got[i]["n_bytes"] == len(t)
        assert [(s["start"], s["end"]) for s in got[i]["spans"]] == [tuple(e) for e in edge.tolist()]
        assert bytes(got[i]["kept"]) == bytes(np.frombuffer(t, np.uint8)[~g])


def test_suffixes_large_group(spark):
    rng = random.Random(5)
    shared = prose(rng, 60)
    rows = [(i, prose(rng, 5) + f" {i} " + shared[: 300 + i % 40] + prose(rng, 8)) for i in range(150)]
    texts = [t.encode() for _, t in rows]
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffixes.deduplicated(spark.createDataFrame(rows, "doc_id bigint, text string"), length=100, gram=32).collect()}
    assert got == {i: bytes(np.frombuffer(t, np.uint8)[~g]) for (i, _), t, g in zip(rows, texts, brute_suffix(texts, 100), strict=True)}


def test_passages(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(4000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared, near = text(90), text(120)
    edited = [w if i % 60 != 30 else "changed" for i, w in enumerate(near)]
    rows = [text(50) + shared + text(40), text(30) + shared + text(70), text(60) + near, edited + text(20), text(300), text(300), ["few", "words"]]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(7, None), (8, ""), (9, " ".join(rows[4])), (None, " ".join(rows[5]))]
    got = {r["doc_id"]: r for r in passages.passages(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {k: r["class"] for k, r in got.items()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 9: 4, 5: 5}
    assert (got[0]["start"], got[0]["end"]) == (50, 140)
    assert (got[1]["start"], got[1]["end"]) == (30, 120)
    assert got[2]["start"] >= 60 and got[2]["end"] <= 180 and got[3]["end"] - got[3]["start"] >= 100
    assert (got[4]["start"], got[4]["end"]) == (0, 300)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert passages.passages(empty).count() == 0


def brute_pii(text):
    found = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]}
    found["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    digits = lambda s: re.sub("[^0-9]", "", s)
    found["card"] = [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
    return [(k, a, b) for k in ("email", "ip", "card", "phone") for a, b in found[k]]


def test_pii_base_kinds(spark, tmp_path):
    rng = random.Random(2)
    parts = ["a.b@c.de", "x@y", "@@", "q%+@a-b.co.uk.", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "41111111111111111111", "+1 (555) 010-9999", "+12", "++49 30 1234567", " ", "é", "mail ", "tel: ", "DE89 3704 0044 0532 0130 00", "030 1234567", "a@b.c@d.e", "12.34.56.78.9@h.io"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(400)] + [None, "", "1" * 20000, "a" * 20000 + "@", "1.2.3." * 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in pii.op9_pii(spark, str(tmp_path)).collect():
        want = brute_pii(texts[r["doc_id"]] or "")
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(x[0] == k for x in want) for k in pii.BASE]
        assert set(",".join(f"{k}:{a}:{b}" for k, a, b in want).split(",")) - {""} <= set(r["spans"].split(","))


def test_pii_scores_and_redaction(spark):
    assert [k for k, *_ in pii.find("account DE89 3704 0044 0532 0130 00 here")] == ["iban"]
    assert pii.find("account DE89 3704 0044 0532 0130 01 here") == []
    assert [k for k, *_ in pii.find("call 030 1234567 now")] == ["phone_local"] and pii.find("room 030 1234567 now") == []
    out = pii.redacted(spark.createDataFrame([(1, "me a@b.co", 9, "k"), (2, None, None, None), (3, "", 0, "k")], "doc_id bigint, text string, n_chars bigint, kind string"))
    assert [tuple(r) for r in out.orderBy("doc_id").collect()] == [(1, "me <email>", 10, "k"), (2, None, None, None), (3, "", 0, "k")]


def test_warc_round_trip(spark, tmp_path):
    page = "x" * 1500
    rows = [(5, "http://a/ b", page), (9, None, page), (2, "http://c/", "short"), (3, "http://d/", "short"), (1, "http://e/", None), (7, "http://f/", page + "é"), (8, "http://g/", "\r\n\r\n" + "y" * 1000)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: tuple(r)[1:] for r in archives.op6_warc(spark, str(tmp_path)).collect()}
    for i, _, html in rows:
        b = (html or "").encode()
        assert got[i][:2] == (len(b), hashlib.sha1(b).hexdigest())
    assert got[5][2:] == ("revisit", 9)
    assert {i: r[2:] for i, r in got.items() if i != 5} == {i: ("response", None) for i in (9, 2, 3, 1, 7, 8)}


@pytest.mark.parametrize("version", [1, 2])
def test_arc_lines(version):
    record = archives.arc_record(version, 4, "http://x/a b", b"body\n\x00", "f.arc", 99)
    head, content = archives.parse_arc(record + b"trailing", version)
    assert head["URL"] == "http://x/a%20b" and archives.split_http(content)[1] == b"body\n\x00"
    assert archives.arc_version(archives.arc_head(version, "f.arc")) == version
    with pytest.raises(ValueError, match="cut"):
        archives.parse_arc(record[:-5], version)


def test_audio(spark, folder):
    got = {r["doc_id"]: r for r in audio.op10_audio(spark, folder).collect()}
    for i, t, *_ in corpus():
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        media = audio.wav(payload)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
    x = np.random.default_rng(0).normal(size=1001).astype(np.float32)
    for up, down in ((1, 2), (3, 2), (2, 3)):
        full = np.zeros(len(x) * up + 64, np.float32)
        full[: len(x) * up : up] = x
        h = audio.resample_filter(up, down).T.ravel()
        want = np.convolve(full, h)[: len(x) * up : down]
        assert np.allclose(audio.resample(x, up, down), want, atol=1e-4)
    assert audio.segments(np.array([1, 1, 9, 5, 5, 0.1, 0.1, 9.0])).tolist() == [[2, 5], [7, 8]]
    rows = audio.extract(audio.store(spark.read.parquet(f"{folder}/documents.parquet"))).collect()
    assert all(len(r["log_mel"]) == audio.TENSOR_FRAMES * audio.MELS and r["from_s"] < r["to_s"] for r in rows)


def test_decontamination(spark):
    bench = [(1, "A farmer named Alice had 24 apples and sold 7 kg of them to Robert for 12 dollars in total."), (2, "Name the largest ocean on the planet that we live on today please."), (3, None), (4, "")]
    docs = [
        (10, "Intro words. " + bench[0][1] + " And more."), (11, "Intro. A farmer named Maria had 31 apples and sold 9 kg of them to Peter for 55 dollars in total. End."),
        (12, "name the LARGEST ocean on the planet that we live on today please"), (13, "Nothing of the sort is written in this document about farmers and oceans."), (14, None), (15, ""),
        (16, "A farmer named Maria had 31 apples and sold 31 kg of them to Maria for 31 dollars in total."),
    ]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(10, 1): "exact", (11, 1): "reparameterised", (12, 2): "exact", (16, 1): "reparameterised"}  # two values of 16 may coincide
    assert {r["doc_id"] for r in decontaminate.clean(d, b).collect()} == {13, 14, 15}
    assert decontaminate.contaminated(d.limit(0), b.limit(0)).count() == 0


REPEATED = [
    ("A shop sold 3 apples and 5 pears to the same customer on that day and gave the rest away.", "A shop sold 4 apples and 4 pears to the same customer on that day and gave the rest away."),
    ("The tank held 30 gallons when it was full and lost 2 gallons every hour until it was empty.", "The tank held 40 barrels when it was full and lost 7 barrels every hour until it was empty."),
    ("Yesterday the teacher asked Anna Smith to give Peter Brown the book that Carol White had lent to David Green.", "Yesterday the teacher asked Maria Lopez to give Igor Petrov the book that Jane Doe had lent to Omar Haddad."),
    ("Anna runs ten laps. Then we ask how many laps Anna ran before lunch. Anna rests for an hour after that.", "Kofi runs ten laps. Then we ask how many laps Kofi ran before lunch. Kofi rests for an hour after that."),
]


@pytest.mark.parametrize("i", range(len(REPEATED)))
def test_reparameterised_copies(spark, i):
    item, copy = REPEATED[i]
    unlike = copy.replace("the", "some").replace("and", "or").replace("laps", "miles today")
    d = spark.createDataFrame([(1, copy), (2, "Some words before. " + copy + " Some words after."), (3, unlike), (4, item)], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["kind"], r["n_matched"], r["n_windows"]) for r in decontaminate.contaminated(d, spark.createDataFrame([(7, item)], "item_id bigint, text string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "reparameterised", 2: "reparameterised", 4: "exact"} and all(m == n for k, (_, m, n) in got.items() if k != 2)


def test_one_value_two_values(spark):
    """An item's value that stands for two values of the document is no copy."""
    item = "He paid 5 coins for the bread and then 5 coins for the milk and 5 coins for the rest."
    d = spark.createDataFrame([(1, item.replace("5", "6")), (2, "He paid 6 coins for the bread and then 7 coins for the milk and 8 coins for the rest.")], "doc_id bigint, text string")
    assert [r["doc_id"] for r in decontaminate.contaminated(d, spark.createDataFrame([(1, item)], "item_id bigint, text string")).where("n_matched = n_windows").collect()] == [1]


def test_quality_held_out(spark):
    rng = random.Random(4)
    good, bad, mixed = [f"good{i}" for i in range(40)], [f"junk{i}" for i in range(40)], [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(700):
        low, toxic = rng.random() < 0.4, rng.random() < 0.2
        words = [rng.choice(mixed) for _ in range(30)] + [rng.choice(bad if low else good) for _ in range(8)] + (["vile", "slur"] if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words) if i else None, "en", "s1" if low else "s2", 200))
        if i < 500:
            labels.append((i, int(not low), int(toxic)))
        else:
            labels.append((-i, int(not low), int(toxic)))
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([x for x in labels if x[0] >= 0] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    truth = {-i: (q, t) for i, q, t in labels if i < 0}
    out = {r["doc_id"]: r for r in quality.scored(docs, known).collect()}
    assert len(out) == 700
    right = sum(out[i]["_quality"]["keep"] == (q == 1 and t == 0) for i, (q, t) in truth.items())
    assert right / len(truth) > 0.9
    assert quality.accepted(docs, known).columns == docs.columns
    assert quality.accepted(docs, known.limit(0)).count() == 700  # without labels nothing is rejected


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    from tabulon.llm import registry

    for name, fn in registry.queries().items():
        assert fn(spark, str(tmp_path)).count() == 0, name


def test_clashing_columns(spark, docs):
    extra = docs.withColumns({c: F.lit(1) for c in ("id", "_gone", "gone", "dotted.name", "fp", "component", "h", "f", "row", "doc", "item", "tokens", "spans", "a", "z")})
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id bigint, text string")
    assert simhash.one_of_each(extra).columns == similar.one_of_each(extra).columns == extra.columns
    assert simhash.one_of_each(extra).count() > 0 and similar.one_of_each(extra).count() > 0 and decontaminate.clean(extra, bench).count() > 0 and pii.redacted(extra).count() == docs.count()
    assert decontaminate.clean(extra, bench).columns == extra.columns
    assert pii.redacted(extra).columns == extra.columns
    clash = spark.createDataFrame([(1, "me a@b.co", 9, "x", "y", "z")], "doc_id bigint, text string, n_chars bigint, _old string, _NEW string, _new_ string")
    assert pii.redacted(clash).collect()[0].asDict() == {"doc_id": 1, "text": "me <email>", "n_chars": 10, "_old": "x", "_NEW": "y", "_new_": "z"}
    assert suffixes.deduplicated(extra).count() == docs.count()
    assert passages.passages(extra).count() > 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    item = "Compute how many of the 30 boxes that Anna carried home were still full after 4 days of rain."
    rows = [*corpus(), (500, "Plain words first. " + item + " Plain words last here.", "en", "s", 0), (501, "write to me at someone@example.org if you can read this text", "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows[:20]], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # near copies: a Jaccard similarity of 0.8 or more of the sets of five-word shingles
    words = {r[0]: (r[1] or "").encode().lower().split() for r in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} - {()} for i, w in words.items()}
    near = lambda a, b: 10 * len(a & b) >= 8 * len(a | b)
    root = roots([(a, b) for a, b in itertools.combinations(sets, 2) if near(sets[a], sets[b])], sets)
    assert set(got) == {i for i in sets if root[i] == i and i != 500}
    tok = tokenizer("word_bpe_49k.json")
    for i, t, *_ in rows:
        if i in got:
            ids = tok.encode(pii.redact(t) or "", add_special_tokens=False).ids
            assert got[i]["n_tokens"] == len(ids) and bytes(got[i]["ids"]) == np.array(ids, "<u4").tobytes()
    assert "<email>" in pii.redact(rows[-1][1])
