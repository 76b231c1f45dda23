"""Token ids in files of Simple-8b words.

A file is a run of row groups. A row group holds whole documents, in ascending order of id: document ids and token counts, the ids that
occur in it by falling frequency (so frequent ids get small ranks), the word offset of each block of BLOCK ranks, and the 64-bit words.
A word's top four bits select how many ranks of which width fill the other sixty; selector 0 is an escape, its value is the next word.
Blocks start on words, so that any block is decoded alone, and all blocks at once by one gather for each selector.

Null text counts as empty: its row holds the end id alone. Rows with the same document id are kept, in order of their text; null
document ids come first; texts of any length are encoded whole. An empty table gives no files and no rows. Other columns are not read."""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, saved, slices, table, texts
from .files import attempt_path, one_task_each, opened

#: (ranks, bits of each) by selector.
SELECTORS = ((1, 64), (120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
BLOCK, GROUP_IDS, END_ID = 1024, 1 << 19, 2
MAX_CHUNKS, PACKED_AT_ONCE = 480_000, BLOCK << 8
_COUNT = np.array([n for n, _ in SELECTORS], np.int64)
_HEAD = struct.Struct("<4sIQIIQ")
_NULL = np.iinfo(np.int64).min


def bit_lengths(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.uint8)
    for shift in (32, 16, 8, 4, 2, 1):
        big = x >> np.uint64(shift) != 0
        out[big] += shift
        x = np.where(big, x >> np.uint64(shift), x)
    return out + (x != 0)


_WIDTH = bit_lengths(np.arange(1 << 16, dtype=np.uint64))


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, word offset of each block). In each block every word takes as many values as fit."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    values = values.astype(np.uint64, copy=False)
    width = _WIDTH[values] if values.max() < len(_WIDTH) else bit_lengths(values)
    room = np.tile(np.arange(BLOCK, 0, -1, dtype=np.int16), -(-n // BLOCK))[:n]
    room[-(n % BLOCK or BLOCK) :] = np.arange(n % BLOCK or BLOCK, 0, -1)
    picked = np.where(width <= 60, 15, 0).astype(np.uint8)
    widest = {1: width}
    for sel in range(14, 0, -1):
        count, bits = SELECTORS[sel]
        half = max(k for k in widest if k <= count)
        while half * 2 < count:  # windows that two shorter ones cover
            widest[half * 2] = np.maximum(widest[half][:-half], widest[half][half:]) if len(widest[half]) > half else np.zeros(0, np.uint8)
            half *= 2
        step = count - half
        own = np.maximum(widest[half][: max(0, len(widest[half]) - step)], widest[half][step:])
        widest[count] = own
        np.copyto(picked[: len(own)], np.uint8(sel), where=(own <= bits) & (room[: len(own)] >= count))
    starts = np.zeros(n, bool)
    at = np.arange(0, n, BLOCK)
    ends = np.minimum(at + BLOCK, n)
    while len(at):
        starts[at] = True
        at = at + _COUNT[picked[at]]
        at, ends = at[at < ends], ends[at < ends]
    at = np.flatnonzero(starts)
    sel = picked[at]
    slot = np.cumsum(np.where(sel == 0, 2, 1)) - np.where(sel == 0, 2, 1)
    words = np.zeros(int(slot[-1]) + (2 if sel[-1] == 0 else 1), np.uint64)
    for s in np.unique(sel):
        own = sel == s
        count, bits = SELECTORS[s]
        if s == 0:
            words[slot[own] + 1] = values[at[own]]
            continue
        if bits:
            fill = values[at[own][:, None] + np.arange(count)] << (np.arange(count, dtype=np.uint64) * np.uint64(bits))
            words[slot[own]] = np.bitwise_or.reduce(fill, axis=1)
        words[slot[own]] |= np.uint64(s) << np.uint64(60)
    return words, slot[np.searchsorted(at, np.arange(0, n, BLOCK))].astype(np.uint64)


def unpack(words: np.ndarray) -> np.ndarray:
    """The values of one block or of any run of blocks."""
    sel = (words >> np.uint64(60)).astype(np.uint8)
    literal = np.zeros(len(words), bool)
    for e in np.flatnonzero(sel == 0):
        if not literal[e]:
            literal[e + 1] = True
    at = np.flatnonzero(~literal)
    sel = sel[at]
    count = _COUNT[sel]
    slot = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in np.unique(sel):
        own = sel == s
        n, bits = SELECTORS[s]
        if s == 0:
            out[slot[own]] = words[at[own] + 1]
        elif bits:
            out[slot[own][:, None] + np.arange(n)] = (words[at[own]][:, None] >> (np.arange(n, dtype=np.uint64) * np.uint64(bits))) & np.uint64((1 << bits) - 1)
    return out


def row_group(doc_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    counts = np.bincount(ids)
    used = np.flatnonzero(counts)
    used = used[np.argsort(-counts[used], kind="stable")]
    rank = np.zeros(len(counts), np.uint64)
    rank[used] = np.arange(len(used), dtype=np.uint64)
    parts, blocks, n = [], [], 0
    for a in range(0, len(ids), PACKED_AT_ONCE):
        words, at = pack(rank[ids[a : a + PACKED_AT_ONCE]])
        parts.append(words)
        blocks.append(at + np.uint64(n))
        n += len(words)
    words, blocks = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (parts, blocks))
    head = _HEAD.pack(b"S8B1", len(doc_ids), len(ids), len(used), len(blocks), len(words))
    return b"".join([head, doc_ids.astype("<i8").tobytes(), sizes.astype("<u4").tobytes(), used.astype("<u4").tobytes(), blocks.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def read_groups(path: str):
    """(document ids, sizes, ids) of each row group of a file."""
    with opened(path, "r") as f:
        while head := f.read(_HEAD.size):
            magic, docs, n, used, blocks, words = _HEAD.unpack(head)
            if magic != b"S8B1":
                raise ValueError(f"{path}: not a token file")
            take = lambda kind, k: np.frombuffer(f.read(np.dtype(kind).itemsize * k), kind)  # noqa: E731, B023
            doc_ids, sizes, table_, at = take("<i8", docs), take("<u4", docs), take("<u4", used), take("<u8", blocks)
            body, step = take("<u8", words), PACKED_AT_ONCE // BLOCK
            ids = [table_[unpack(body[a:z]).astype(np.int64)] for a, z in zip(at[::step], [*at[step::step], len(body)], strict=True)] if n else []
            yield doc_ids, sizes, np.concatenate([np.zeros(0, np.uint32), *ids])


class _Index(dict):
    """Chunk -> its number in ``owner``; a new chunk is numbered and noted for encoding."""

    def __init__(self, owner: ChunkIds, prefix: str):
        self.owner, self.prefix = owner, prefix

    def __missing__(self, chunk: str) -> int:
        self.owner.todo.append(self.prefix + chunk)
        self[chunk] = n = self.owner.n
        self.owner.n += 1
        return n


class ChunkIds:
    """Ids of texts, from the tokenizer's ids of their chunks, each encoded once while it is remembered.

    A text is cut before each single space between two characters that are not white space. Byte-level pre-tokenisation starts a new
    piece at every such space, whatever stands around it, so a text's ids are those of its chunks in turn. A chunk of Latin letters and
    marks is one or two pieces, which go to the tokenizer's model without the rest where the tokenizer's file allows it; others go through
    all of it. A text is first cut at all spaces, and cut again with care if a chunk turns out to begin or end in white space. When
    MAX_CHUNKS are remembered, those that were met once since the last time are forgotten."""

    SPLIT = re.compile(r"(?<=\S)\x20(?=\S)")
    WORD = re.compile(r"(\x20?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\[-`{-~]*)\Z")
    MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")

    def __init__(self, path: str, end_id: int | None):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of their own would hold memory
        self.tok, self.end_id = Tokenizer.from_file(path), end_id
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the bytes that byte-level vocabularies write as themselves
        rest = [b for b in range(256) if b not in shown]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.model, self.marks = self.tok.model, {}
        self.plain = self._plain()
        self.reset()

    def _plain(self) -> bool:
        """Whether words may go to the model alone: no normaliser, a byte-level pre-tokenizer that adds no space, no added token with a space or
        of letters, and the same ids either way for words of each kind."""
        spec = json.loads(self.tok.to_str())
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or any(" " in t["content"] or self.WORD.match(t["content"]) for t in spec.get("added_tokens", [])):
            return False
        tried = ("word", " word", " Ünïcödé", "ſtraße" if self.WORD.match("ſtraße") else "straße", " a", "I")
        return all([t.id for t in self.model.tokenize(w.encode().decode("latin-1").translate(self.letters))] == self.tok.encode(w, add_special_tokens=False).ids for w in tried)

    def reset(self) -> None:
        self.n, self.todo = 0, []
        self.flat, self.ends, self.uses, self.odd = array("I"), array("q", [0]), np.zeros(0, np.int64), bytearray()
        self.first, self.later = _Index(self, ""), _Index(self, " ")
        if self.end_id is not None:  # number 0
            self.flat.append(self.end_id)
            self.ends.append(1)
            self.odd.append(0)
            self.n = 1

    def forget(self) -> None:
        old, uses, flat, ends, odd = self.later, self.uses, self.flat, self.ends, self.odd
        self.reset()
        for chunk, i in old.items():
            if uses[i] > 1:
                self.later[chunk] = self.n
                self.n += 1
                self.flat.extend(flat[ends[i] : ends[i + 1]])
                self.ends.append(len(self.flat))
                self.odd.append(odd[i])
        if self.n > MAX_CHUNKS // 2:
            self.reset()

    def learn(self) -> None:
        """Ids of the chunks noted: letters and marks, the two commonest kinds, are one and two pieces and need no pre-tokenizer."""
        word, model, known, flat, ends = self.WORD.match, self.model.tokenize, self.later, self.flat, self.ends
        found, other, plain, n_known, odd = [], [], self.plain, len(self.ends) - 1, bytearray(len(self.todo))
        own: dict[str, list[int]] = {}  # of the cores met here
        for i, c in enumerate(self.todo):
            core = marks = None
            if plain:
                core = c.rstrip(self.MARKS)
                bare = core[1:] if core[:1] == " " else core
                if bare.isascii() and bare.isalpha():
                    marks = c[len(core) :]
                else:
                    m = word(c)
                    core, marks = m.groups() if m else (None, None)
            if core is None:
                other.append(i)
                found.append(())
                continue
            if (ids := own.get(core)) is None:
                if marks and core[0] == " " and (n := dict.get(known, core[1:], n_known)) < n_known:
                    ids = flat[ends[n] : ends[n + 1]].tolist()
                else:
                    shown = core.replace(" ", self.letters[32]) if core.isascii() else core.encode().decode("latin-1").translate(self.letters)
                    ids = [t.id for t in model(shown)]
                own[core] = ids
            if marks:
                if (after := self.marks.get(marks)) is None:
                    after = self.marks[marks] = self.tok.encode(marks, add_special_tokens=False).ids
                ids = ids + after
            found.append(ids)
        for i, e in zip(other, self.tok.encode_batch_fast([self.todo[i] for i in other], add_special_tokens=False), strict=True):
            found[i] = e.ids
            c = self.todo[i]
            odd[i] = c[-1:].isspace() or c[:1] == " " and c[1:2].isspace()
        flat.extend(chain.from_iterable(found))
        ends.extend(islice(accumulate(map(len, found), initial=ends[-1]), 1, None))
        self.odd += odd
        self.todo = []

    def numbers(self, segs: list[str]) -> np.ndarray:
        own = np.zeros(len(segs) + (self.end_id is not None), np.int64)
        own[0] = self.first[segs[0]]
        own[1 : len(segs)] = np.fromiter(map(self.later.__getitem__, segs[1:]), np.int64, len(segs) - 1)
        return own

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end id if there is one; their number by text)."""
        if not batch:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.n > MAX_CHUNKS:
            self.forget()
        parts = [self.numbers(text.split(" ")) for text in batch]
        self.learn()
        odd = np.array(self.odd, bool)
        if again := [i for i, p in enumerate(parts) if odd[p].any()]:
            for i in again:
                parts[i] = self.numbers(self.SPLIT.split(batch[i]))
            self.learn()
        flat, ends = np.frombuffer(self.flat, np.uint32) if len(self.flat) else np.zeros(0, np.uint32), np.frombuffer(self.ends, np.int64)
        at = np.concatenate(parts)
        uses = np.bincount(at, minlength=self.n)
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        size = ends[at + 1] - ends[at]
        done = np.cumsum(size)
        ids = flat[np.arange(done[-1]) - np.repeat(done - size - ends[at], size)]
        sizes = np.diff(done[np.cumsum([len(p) for p in parts]) - 1], prepend=0)
        return ids, sizes


_MEMO: dict = {}


def chunk_ids(path: str, end_id: int | None) -> ChunkIds:
    """One for each Python worker, which serves many tasks."""
    if (path, end_id) not in _MEMO:
        _MEMO[path, end_id] = ChunkIds(path, end_id)
    return _MEMO[path, end_id]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = END_ID, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """Encodes whole texts and writes them below ``folder`` in ascending id order. Returns (file, ids in all files before it), a row a file."""

    def run(batches):
        memo, path, out = chunk_ids(tokenizer, end_id), attempt_path(folder, ".s8b"), None
        held, n, total, least = [], 0, 0, None

        def flush():
            out.write(row_group(*(np.concatenate(x) for x in zip(*held, strict=True))))

        for batch in batches:
            doc_ids = batch.column(0).fill_null(_NULL).to_numpy(zero_copy_only=False)
            for at in range(0, len(doc_ids), 500):
                some, ids = texts(batch.column(1).slice(at, 500)), doc_ids[at : at + 500]
                for a, b in slices(some):
                    tokens, sizes = memo.encode(some[a:b])
                    if out is None:
                        out, least = opened(path, "w"), int(ids[a])
                    held.append((ids[a:b], sizes, tokens))
                    n += len(tokens)
                    if n >= GROUP_IDS:
                        flush()
                        held, n, total = [], 0, total + n
        if out is not None:
            if held:
                flush()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([least]), pa.array([path]), pa.array([total + n])], ["least", "path", "n"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    files = saved(rows.repartitionByRange("id").sortWithinPartitions("id", "text").mapInArrow(run, "least bigint, path string, n bigint"), "token-files")
    done, start = [], 0
    for _, path, n in sorted(map(tuple, files.collect())):  # a row a file
        done.append((path, start))
        start += n
    return done


def read_tokens(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, start, ids as little-endian unsigned 32-bit integers) of every document."""

    def run(batches):
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for doc_ids, sizes, ids in read_groups(path):
                    ends = np.cumsum(sizes.astype(np.int64))
                    raw = ids.astype("<u4").tobytes()
                    offsets = np.concatenate([[0], ends * 4])
                    for a in range(0, len(doc_ids), 2000):
                        z = min(a + 2000, len(doc_ids))
                        blobs = pa.array([raw[s:e] for s, e in zip(offsets[a:z], offsets[a + 1 : z + 1], strict=True)], pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(doc_ids[a:z], mask=doc_ids[a:z] == _NULL), pa.array(start + offsets[a:z] // 4), blobs], ["doc_id", "start", "ids"])
                    start += int(ends[-1]) if len(ends) else 0

    return one_task_each(spark, files, "path string, start bigint").mapInArrow(run, "doc_id bigint, start bigint, ids binary")


def op1_simple8b(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = write_tokens(table(spark, sf_dir, "documents"), new_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"))

    def digest(batches):
        for b in batches:
            raw = b.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) // 4 for x in raw]), pa.array([zlib.crc32(x) for x in raw])], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_tokens(spark, files).mapInArrow(digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
