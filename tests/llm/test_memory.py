"""What a Python worker may keep."""

import random
import tracemalloc

import pytest

from tabulon.llm import bpe_reuse, simple8b

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_remembered_chunks_are_forgotten_early():
    rng = random.Random(4)
    vocabulary = [f"word{k}" for k in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=14_000)) for _ in range(150)]
    own = bpe_reuse.Reuse(public_tokenizers.path("word_bpe_49k.json"))
    most = 0
    tracemalloc.start()
    for a, b in bpe_reuse.slices(texts, bpe_reuse.SLICE_CHARS):
        own.encode(texts[a:b])
        most = max(most, own.chars)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert most < 10 << 20 < sum(map(len, texts)) and kept < 90 << 20


def test_a_word_is_encoded_once_whatever_marks_follow():
    """Words that are new to a batch and come with several marks go to the tokenizer's model once, in the tokenizer's ids."""
    memo = simple8b.ChunkIds(public_tokenizers.path("byte_bpe_50k.json"), None)
    seen, model = [], memo.model

    class Spy:
        def tokenize(self, word):
            seen.append(word)
            return model.tokenize(word)

    memo.model = Spy()
    texts_ = ["a Zebrafish, a Zebrafish. a Zebrafish's (Zebrafish) a Zebrafish", "Über Über, Über; don't 12 Zebrafish!? \t x  y", ""]
    ids, sizes = memo.encode(texts_)
    want = [memo.tok.encode(t, add_special_tokens=False).ids for t in texts_]
    assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [len(x) for x in want]
    assert memo.plain and len(seen) == len(set(seen))
