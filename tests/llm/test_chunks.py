"""Chunk reuse against the tokenizers library."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row

from tabulon.llm import bpe_reuse

public_tokenizers = pytest.importorskip("public_tokenizers")
NAMES = ("word_bpe_49k.json", "byte_bpe_50k.json")
MEMO = {}


def reuse(name):
    if name not in MEMO:
        MEMO[name] = bpe_reuse.Reuse(public_tokenizers.path(name))
    return MEMO[name]


def agrees(r, batch):
    for text, (raw, said) in zip(batch, r.encode(batch), strict=True):
        ids = np.frombuffer(raw, "<u4").tolist()
        assert ids == r.tok.encode(text, add_special_tokens=False).ids
        assert said == r.tok.decode(ids, skip_special_tokens=False)


@pytest.fixture
def short(monkeypatch):
    """Chunks of eight characters on average."""
    monkeypatch.setattr(bpe_reuse, "MASK", 7)


@pytest.mark.parametrize("name", NAMES)
def test_odd_texts(short, name):
    parts = ["a", "don't", "  ", " ", "é", " ́", "　", "\n\n", " x", "<|endoftext|>", "12", "...", "Σ", "가", "한글", "x" * 40, "\U0001f600"]

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(parts), max_size=60).map("".join), max_size=4))
    def run(batch):
        agrees(reuse(name), batch)

    run()


@pytest.mark.parametrize("name", NAMES)
def test_chunks_are_encoded_once_as_units(short, name):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(1, 7))) for _ in range(300)]
    passage = " ".join(rng.choice(words, 400))
    batch = [" ".join([*rng.choice(words, 20), passage, *rng.choice(words, 20)]) for _ in range(20)]
    r = bpe_reuse.Reuse(public_tokenizers.path(name))
    seen, inner = [], r.tok

    class Spy:
        def __getattr__(self, a):
            return getattr(inner, a)

        def encode_batch_fast(self, some, **how):
            seen.extend(some)
            return inner.encode_batch_fast(some, **how)

    r.tok = Spy()
    for text in batch:  # one call a text: chunks are known from the texts before
        (raw, _), = r.encode([text])
        assert np.frombuffer(raw, "<u4").tolist() == inner.encode(text, add_special_tokens=False).ids
    assert any(s.count(" ") > 2 for s in seen)
    assert sum(map(len, seen)) < 2 * (len(passage) + 20 * 40 * 5)  # the passage is encoded once, not twenty times
    assert r.n_reused > 10 * len({c for c in bpe_reuse.chunked([passage])[0]}) and r.n_whole == 0


def test_joins_grow_until_ids_agree(short):
    """Chunks are given wrong first ids: the join has to grow past them, or the text is encoded whole."""
    r = bpe_reuse.Reuse(public_tokenizers.path(NAMES[0]))
    text = "the quick brown fox jumps over the lazy dog and runs to the river bank while the sun sets behind the old mill " * 3
    r.encode([text])
    for c in filter(None, r.chunks.values()):
        c.ids = np.array([0], "<u4").tobytes() + c.ids[4:]
    r.joins.clear()
    agrees(r, [text])
    assert r.n_grown > 0 and r.n_whole == 1


def test_memory_is_forgotten(short, monkeypatch):
    monkeypatch.setattr(bpe_reuse, "MAX_CHARS", 200)
    r = bpe_reuse.Reuse(public_tokenizers.path(NAMES[0]))
    for _ in range(5):
        agrees(r, ["some words that come again and again " * 20, "others that do not"])
    assert len(r.chunks) < 40


def test_names_and_repeated_rows(spark):
    docs = spark.createDataFrame([Row(**{"d.id": i, "text": t, "ids": 1, "n_tokens": "x"}) for i, t in [(1, "a b c d"), (1, "a b c d"), (None, None), (2, "")]], "`d.id` long, text string, ids int, n_tokens string")
    got = bpe_reuse.encode(docs, public_tokenizers.path(NAMES[0]), id_col="d.id").collect()
    assert sorted((r["d.id"] or 0, r["n_tokens"]) for r in got) == [(0, 0), (1, 4), (1, 4), (2, 0)]


def test_report(spark):
    some = ["one two three four five six seven " * 200] * 3 + [None]
    got = bpe_reuse.chunk_report(spark.createDataFrame([(t,) for t in some], "text string")).first()
    want = [c for d in bpe_reuse.chunked([t or "" for t in some]) for c in d]
    assert tuple(got) == (len(want), len(set(want)), sum(map(len, want)), sum(map(len, set(want))))


def test_ascii_is_normalised_before_the_tokenizer():
    """Chunks of ASCII go to the tokenizer without its normaliser, in the same ids; others, and those with an added token, with it."""
    r = bpe_reuse.Reuse(public_tokenizers.path(NAMES[0]))
    seen, inner = [], r.tok.encode_batch_fast

    class Spy:
        def __getattr__(self, a):
            return getattr(r_tok, a)

        def __setattr__(self, a, x):
            setattr(r_tok, a, x)

        def encode_batch_fast(self, some, **how):
            seen.extend((r_tok.normalizer is None, x) for x in some)
            return inner(some, **how)

    r_tok, r.tok = r.tok, Spy()
    odd = ["A Plain\t \n Text\x1c of\x0b  WORDS here", "One Word é MORE Words", "Some <|EndOfText|> Words Here", "Some <|endoftext|> Words Here", "a  b \r\n C"]
    agrees(r, odd)
    assert r_tok.normalizer is not None
    assert sorted(bare for bare, _ in seen) == [False] * 3 + [True] * 2
    assert bpe_reuse.ascii_steps({"type": "Sequence", "normalizers": [{"type": "Lowercase"}, {"type": "StripAccents"}]}) is None
    assert bpe_reuse.ascii_steps(None) is None
