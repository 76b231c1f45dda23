"""BPE encoding and decoding by content-defined chunk reuse.

A gear hash over a text's code points cuts it where the hash of the last WINDOW code points ends in zeros, so a passage that documents
share falls into the same chunks wherever it stands. A chunk is encoded once, as one string: what lies from its first space up to its last.
What is left at a join (the end of one chunk and the start of the next) is encoded together with a word of the chunk before and a word of
the chunk behind. The ids of these words must be those with which the chunks end and begin; if they are not, the stretch grows to 2, 4, 8
words, and a text whose chunks are used up without agreement is encoded whole. So the result is that of the tokenizer for any tokenizer to
which a space before a word is a boundary, and a tokenizer that sees more than a word has its joins grown.

Chunks and joins are remembered for each Python worker, up to MAX_CHARS of text, then forgotten; that costs time only. Null counts as empty:
no ids. Repeated rows and ids stay, each with its own result; an empty table gives no rows; texts of any length are cut in chunks, those
without a space are encoded whole. Other columns are not read, whatever their names."""

from __future__ import annotations

import hashlib
import json
import os
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, table, texts

WINDOW, MASK = 32, (1 << 10) - 1
MAX_CHARS = 8 << 20
#: Characters encoded at once: what the tokenizer makes of them stays in a core's cache.
SLICE_CHARS = 1 << 17
_GEAR = np.random.default_rng(20_240_229).integers(1, 1 << 32, 256, dtype=np.uint32)
_GEAR[0] = 0


def cuts(points: np.ndarray) -> np.ndarray:
    """Ends of chunks in an array of code points: hash[i] = sum of gear[c[i - j]] << j over the window, by doubling."""
    h = _GEAR[(points ^ (points >> 8)) & 255]
    span = 1
    while span < WINDOW:
        more = h.copy()
        more[span:] += h[:-span] << np.uint32(span)
        h, span = more, span * 2
    return np.flatnonzero((h >> np.uint32(20)) & np.uint32(MASK) == 0) + 1


def chunked(batch: list[str]) -> list[list[str]]:
    gap = "\0" * WINDOW
    whole = gap.join(batch)
    ends = cuts(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32))
    out, at = [], 0
    for text in batch:
        own = ends[np.searchsorted(ends, at, "right") : np.searchsorted(ends, at + len(text), "left")].tolist()
        out.append([whole[a:b] for a, b in zip([at, *own], [*own, at + len(text)], strict=True)])
        at += len(text) + WINDOW
    return out


def last_words(text: str, k: int) -> str:
    """The last ``k`` words, each with the space before it; all of ``text`` if it has fewer."""
    at = len(text)
    for _ in range(k):
        at = text.rfind(" ", 0, at)
        if at <= 0:
            return text
    return text[at:]


def first_words(text: str, k: int) -> str:
    at = 0
    for _ in range(k):
        at = text.find(" ", at + 1)
        if at < 0:
            return text
    return text[:at]


class Chunk:
    """A chunk with spaces: ``head``, up to the first, ``body``, encoded, and ``tail``, from the last."""

    __slots__ = ("body", "head", "ids", "said", "tail")

    def __init__(self, text: str):
        a, b = text.find(" "), text.rfind(" ")
        self.head, self.body, self.tail = text[:a], text[a:b], text[b:]


_BLANKS = re.compile(r"[\t-\r][\t-\r ]*| [\t-\r ]+")  # what \s+ matches in ASCII, but single spaces


def ascii_steps(normalizer: dict | None) -> list[Callable[[str], str]] | None:
    """What a tokenizer's normaliser does to ASCII text, or None where that is nothing or not known."""
    out: list[Callable[[str], str]] = []
    for step in normalizer["normalizers"] if normalizer and normalizer["type"] == "Sequence" else [normalizer]:
        if step and step["type"] == "Lowercase":
            out.append(str.lower)
        elif step and step["type"] == "Replace" and (step["pattern"], step["content"]) == ({"Regex": "\\s+"}, " "):
            out.append(lambda text: _BLANKS.sub(" ", text))
        elif not step or step["type"] not in ("NFC", "NFD", "NFKC", "NFKD"):
            return None
    return out or None


class Reuse:
    """Encodes texts; remembers chunks and joins."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of their own would hold memory
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        self.steps, self.normalizer = ascii_steps(spec["normalizer"]), self.tok.normalizer
        self.added = [t["content"].lower() for t in spec["added_tokens"]]  # these are looked for before or after normalisation
        # without a decoder the tokens are joined by spaces, so that chunks can be decoded once, too
        self.tokens = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())] if self.tok.decoder is None else None
        self.chunks: dict[str, Chunk | None] = {}
        self.joins: dict[tuple, tuple] = {}
        self.chars = self.n_encoded = self.n_reused = self.n_grown = self.n_whole = 0

    def said(self, ids: list[int]) -> str:
        return "" if self.tokens is None else " ".join(map(self.tokens.__getitem__, ids))

    def normalised(self, text: str) -> str | None:
        """ASCII text as the tokenizer normalises it; None where the tokenizer has to do that."""
        if not self.steps or not text.isascii():
            return None
        for step in self.steps:
            text = step(text)
        low = text.lower()
        return None if any(t in low for t in self.added) else text

    def encoded(self, some: list[tuple[Chunk, str]]) -> None:
        for (c, _), e in zip(some, self.tok.encode_batch_fast([x for _, x in some], add_special_tokens=False), strict=True):
            ids = e.ids
            c.ids, c.said = np.array(ids, "<u4").tobytes(), self.said(ids)

    def learn(self, new: list[str]) -> None:
        """Encodes the chunks ``new``, each once."""
        made = {c: Chunk(c) if c.find(" ") < c.rfind(" ") else None for c in new}
        some = [c for c in made.values() if c is not None]
        ready = [self.normalised(c.body) for c in some]
        plain, rest = [(c, x) for c, x in zip(some, ready, strict=True) if x is not None], [(c, c.body) for c, x in zip(some, ready, strict=True) if x is None]
        self.encoded(rest)
        if plain:
            self.tok.normalizer = None
            try:
                self.encoded(plain)
            finally:
                self.tok.normalizer = self.normalizer
        self.chunks |= made
        self.chars += sum(map(len, new))
        self.n_encoded += len(some)

    def gaps(self, doc: list[str]) -> list[tuple[Chunk | None, str, Chunk | None]]:
        """What is left between the bodies of the chunks of a text, before the first and behind the last."""
        out, before, open_ = [], None, []
        for text in doc:
            c = self.chunks[text]
            if c is None:
                open_.append(text)
            else:
                out.append((before, "".join([*open_, c.head]), c))
                before, open_ = c, [c.tail]
        return [*out, (before, "".join(open_), None)]

    def join(self, gaps: list[tuple[Chunk | None, str, Chunk | None]]) -> list[tuple[bytes, str] | None]:
        """(ids, decoded) of each gap, or None where no agreement is found."""
        out: list[tuple[bytes, str] | None] = [None] * len(gaps)
        k, left = 1, range(len(gaps))
        while left:
            keys = {}
            for i in left:
                a, core, b = gaps[i]
                keys[i] = (last_words(a.body, k) if a else "", core, first_words(b.body, k) if b else "")
            new = list(dict.fromkeys(x for x in keys.values() if x not in self.joins))
            for key, e in zip(new, self.tok.encode_batch(["".join(x) for x in new], add_special_tokens=False), strict=True):
                at, ids = e.offsets, e.ids
                n = bisect_right(at, len(key[0]), key=lambda x: x[1])
                m = bisect_left(at, len(key[0]) + len(key[1]), key=lambda x: x[0])
                raw = np.array(ids, "<u4").tobytes()
                self.joins[key] = (raw[: 4 * n], raw[4 * n : 4 * m], raw[4 * m :], self.said(ids[n:m])) if n <= m else None
                self.chars += sum(map(len, key))
            more = []
            for i, key in keys.items():
                a, _, b = gaps[i]
                found = self.joins[key]
                if found and (a is None or (found[0] and a.ids.endswith(found[0]))) and (b is None or (found[2] and b.ids.startswith(found[2]))):
                    out[i] = (found[1], found[3])
                elif (a and len(key[0]) < len(a.body)) or (b and len(key[2]) < len(b.body)):
                    more.append(i)
            self.n_grown += len(more)
            k, left = 2 * k, more
        return out

    def encode(self, batch: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        if self.chars > MAX_CHARS:
            self.chunks, self.joins, self.chars = {}, {}, 0
        docs = chunked(batch)
        new = [c for c in dict.fromkeys(c for d in docs for c in d) if c not in self.chunks]
        self.learn(new)
        self.n_reused += sum(map(len, docs)) - len(new)
        gaps = [self.gaps(d) for d in docs]
        joined = iter(self.join([g for own in gaps for g in own]))
        out = []
        for text, own in zip(batch, gaps, strict=True):
            parts = []
            for (_, _, chunk), found in zip(own, [next(joined) for _ in own], strict=True):
                parts.append(found)
                if chunk is not None:
                    parts.append((chunk.ids, chunk.said))
            if None in parts:
                ids = self.tok.encode(text, add_special_tokens=False).ids
                parts = [(np.array(ids, "<u4").tobytes(), self.said(ids))]
                self.n_whole += 1
            raw = b"".join(x for x, _ in parts)
            out.append((raw, " ".join(filter(None, (x for _, x in parts))) if self.tokens is not None else self.tok.decode(np.frombuffer(raw, "<u4").tolist(), skip_special_tokens=False)))
        return out


_MEMO: dict[str, Reuse] = {}


def reuse(path: str) -> Reuse:
    if path not in _MEMO:
        _MEMO[path] = Reuse(path)
    return _MEMO[path]


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", full: bool = True) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) and, if ``full``, (ids as binary, decoded): a row for each row of ``docs``."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * full

    def run(batches):
        for batch in batches:
            some = texts(batch.column(1))
            for a, b in slices(some, SLICE_CHARS):
                done = reuse(tokenizer).encode(some[a:b])
                cols = [
                    batch.column(0).slice(a, b - a), pa.array([len(x) // 4 for x, _ in done]), pa.array([hashlib.sha256(x).hexdigest() for x, _ in done]),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in done]),
                ]
                if full:
                    cols += [pa.array([x for x, _ in done], pa.binary()), pa.array([t for _, t in done], pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * full
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def chunk_report(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(n_chunks, n_distinct, n_chars, distinct_chars) of all texts: what reuse could save at best. Chunks are told apart by 128-bit digests."""

    def run(batches):
        for batch in batches:
            some = texts(batch.column(0))
            for a, b in slices(some):
                own = [c for d in chunked(some[a:b]) for c in d]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(c.encode(), digest_size=16).digest() for c in own], pa.binary()), pa.array([len(c) for c in own], pa.int64())], ["d", "n"])

    each = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "d binary, n bigint").groupBy("d").agg(F.count("*").alias("k"), F.first("n").alias("n"))
    return each.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n_chunks"), F.count("*").alias("n_distinct"), F.coalesce(F.sum(F.col("k") * F.col("n")), F.lit(0)).alias("n_chars"), F.coalesce(F.sum("n"), F.lit(0)).alias("distinct_chars"))


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), full=False)
