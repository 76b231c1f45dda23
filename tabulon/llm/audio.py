"""Media columns: lossless 8-bit audio and features of it.

Bytes become the samples of an unsigned 8-bit mono WAV, stored in a Parquet table of the shared folder and read back. Features: polyphase
resampling to two thirds of the rate, log-mel energies of overlapped frames, and segments found by hysteresis on frame energy. The mel
frames go into fixed-shape Arrow tensors of TENSOR_FRAMES x MELS with their time spans, the last one padded with its floor. Spark has no such
type, so a document's tensors are stored as one Arrow stream in a binary column; what is said of them is computed from the stream read back.

Null text counts as empty. Texts are padded with 255 to a positive multiple of UNIT, so no payload is empty. Equal texts give equal
values, as every number is computed from the document alone. Repeated rows and ids stay; an empty table gives no rows. Long texts are framed
in blocks, so that beside the text and its tensors (two fifths of its size) little memory is held. Other columns are not read, whatever their names."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, new_path, table, utf8

UNIT, RATE, UP, DOWN, TAPS = 576, 16_000, 2, 3, 16
FRAME, HOP, MELS, TENSOR_FRAMES = 256, 128, 20, 32
#: A segment opens where the frame energy rises over OPEN times its mean and closes where it falls below CLOSE times.
OPEN, CLOSE = 1.02, 0.98
BLOCK_FRAMES = 4096
_HEAD = struct.Struct("<4sI4s4sIHHIIHH4sI")


def wav(samples: bytes, rate: int = RATE) -> bytes:
    return _HEAD.pack(b"RIFF", 36 + len(samples) + len(samples) % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + b"\0" * (len(samples) % 2)


def unwav(media: bytes) -> tuple[bytes, int]:
    riff, _, wave, fmt, size, pcm, channels, rate, _, _, bits, data, n = _HEAD.unpack_from(media)
    if (riff, wave, fmt, size, pcm, channels, bits, data) != (b"RIFF", b"WAVE", b"fmt ", 16, 1, 1, 8, b"data"):
        raise ValueError("not an 8-bit mono PCM file")
    return media[_HEAD.size : _HEAD.size + n], rate


def resample_filter(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Windowed-sinc low-pass of ``taps`` to each phase, by phase."""
    n, cut = taps * up, 1 / max(up, down)
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t * cut) * np.hamming(n)
    return (h / h.sum() * up).reshape(taps, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Polyphase: each output sample takes the one phase of the filter that meets input samples."""
    phases = resample_filter(up, down, taps)
    n_out = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps - 1, np.float32), x.astype(np.float32), np.zeros(taps + down, np.float32)])
    out = np.empty(n_out, np.float32)
    for first in range(up):  # outputs that share a phase are evenly spaced
        n = len(range(first, n_out, up))
        at, phase = first * down // up + taps - 1, (first * down) % up
        acc = np.zeros(n, np.float32)
        for j in range(taps):
            acc += phases[phase, j] * padded[at - j : at - j + n * down : down][:n]
        out[first::up] = acc
    return out


def mel_bank(rate: float, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangles evenly spaced on the mel scale: (frame / 2 + 1, mels)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    return np.maximum(0, np.minimum((f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1]))).astype(np.float32)


def segments(energy: np.ndarray, open_: float = OPEN, close: float = CLOSE) -> np.ndarray:
    """(from, to) frames, end exclusive: opened above the high threshold, held until below the low one."""
    mean = float(energy.mean())
    mark = np.where(energy > open_ * mean, 1, np.where(energy < close * mean, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[last], -1) == 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return edge.reshape(-1, 2)


def features(samples: bytes, rate: int = RATE) -> tuple[np.ndarray, np.ndarray, float]:
    """(log-mel frames x MELS, segments in frames, seconds a frame). Frames are done in blocks, so that long input needs little memory."""
    x = resample((np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128)
    low = rate * UP / DOWN
    x = np.concatenate([x, np.zeros(max(0, FRAME - len(x)) + (-(len(x) - FRAME)) % HOP, np.float32)]) if (len(x) - FRAME) % HOP or len(x) < FRAME else x
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window, bank = np.hanning(FRAME).astype(np.float32), mel_bank(low)
    mel, energy = [], []
    for a in range(0, len(frames), BLOCK_FRAMES):
        power = np.abs(np.fft.rfft(frames[a : a + BLOCK_FRAMES] * window)) ** 2
        mel.append(np.log(power.astype(np.float32) @ bank + 1e-6))
        energy.append((frames[a : a + BLOCK_FRAMES] ** 2).mean(axis=1))
    return np.concatenate(mel), segments(np.concatenate(energy)), HOP / low


def tensors(mel: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """(n, TENSOR_FRAMES, MELS) float32 and each one's time span in seconds."""
    n = -(-len(mel) // TENSOR_FRAMES)
    out = np.full((n * TENSOR_FRAMES, MELS), np.float32(np.log(1e-6)), np.float32)
    out[: len(mel)] = mel
    at = np.arange(n) * TENSOR_FRAMES * step
    return out.reshape(n, TENSOR_FRAMES, MELS), np.stack([at, np.minimum(at + TENSOR_FRAMES * step, len(mel) * step)], axis=1)


def padded(text: bytes, unit: int = UNIT) -> bytes:
    return text.ljust(max(1, -(-len(text) // unit)) * unit, b"\xff")


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): the stored table, read back."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                raw = utf8(batch.column(1).slice(a, 256))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 256), pa.array([len(x) for x in raw]), pa.array([wav(padded(x)) for x in raw], pa.binary())], ["id", "n_bytes", "media"])

    out = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_bytes bigint, media binary")
    spark = docs.sparkSession
    path = new_path(spark, "media")
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path).withColumnRenamed("id", id_col)


def tensor_type() -> pa.FixedShapeTensorType:
    """The Arrow type of ``log_mel``."""
    return pa.fixed_shape_tensor(pa.float32(), [TENSOR_FRAMES, MELS])


def tensor_stream(mel: np.ndarray, found: np.ndarray, step: float) -> bytes:
    """An Arrow stream, a row a tensor: log_mel (tensor_type), frames that are not padding, time span, segments that overlap it."""
    t, spans = tensors(mel, step)
    first, last = (found * step).T if len(found) else (np.empty(0), np.empty(0))
    # segments are in order and apart from each other: those that overlap a span are a run
    a, z = np.searchsorted(last, spans[:, 0], "right"), np.searchsorted(first, spans[:, 1], "left")
    at = np.concatenate([np.arange(i, max(i, j)) for i, j in zip(a, z, strict=True)]).astype(np.int64)
    counts = np.concatenate([[0], np.cumsum(np.maximum(z - a, 0))]).astype(np.int32)
    own = pa.ListArray.from_arrays(pa.array(counts), pa.StructArray.from_arrays([pa.array(first[at]), pa.array(last[at])], ["from_s", "to_s"]))
    frames = np.minimum(TENSOR_FRAMES, len(mel) - np.arange(len(t)) * TENSOR_FRAMES).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([pa.FixedShapeTensorArray.from_numpy_ndarray(t), pa.array(frames), pa.array(spans[:, 0]), pa.array(spans[:, 1]), own], ["log_mel", "frames", "from_s", "to_s", "segments"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> pa.Table:
    table = pa.ipc.open_stream(stream).read_all()
    if table.schema.field("log_mel").type != tensor_type():
        raise ValueError(f"tensors of another shape: {table.schema.field('log_mel').type}")
    return table


def described(stream: bytes) -> str:
    """What a document's tensors say: their number and shape, seconds, segments, frames in segments, mean of each mel band."""
    t = read_tensors(stream)
    mel = t.column("log_mel").combine_chunks()
    mel = (mel.chunk(0) if isinstance(mel, pa.ChunkedArray) else mel).to_numpy_ndarray().reshape(-1, MELS)[: sum(t.column("frames").to_pylist())]
    found = {(s["from_s"], s["to_s"]) for own in t.column("segments").to_pylist() for s in own}
    step = HOP * DOWN / (RATE * UP)
    active = sum(round((z - a) / step) for a, z in found)
    said = ",".join(f"{x:.3f}" for x in np.round(mel.mean(axis=0, dtype=np.float64), 3))
    return f"tensors={t.num_rows}x{TENSOR_FRAMES}x{MELS};seconds={t.column('to_s')[-1].as_py():.3f};segments={len(found)};active={active};mel={said}"


def stored_tensors(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, tensors: an Arrow stream): computed from the media
    as read, written to the shared folder and read back. ``media`` is a table of ``store``."""
    kind = media.schema[id_col].dataType.simpleString()
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "tensors"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = []
        for blob in batch.column(2).to_pylist():
            payload, rate = unwav(blob)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), tensor_stream(*features(payload, rate))))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in zip(*rows, strict=True))], names) if rows else None

    out = arrow_map(media.select(F.col(f"`{id_col}`").alias("id"), "n_bytes", F.col(f"`{media_col}`").alias("media")), run, f"id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, tensors binary")
    path = new_path(media.sparkSession, "tensors")
    out.write.option("compression", "zstd").parquet(path)
    return media.sparkSession.read.schema(out.schema).parquet(path).withColumnRenamed("id", id_col)


def extract(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id, tensor, frames, from_s, to_s, log_mel: TENSOR_FRAMES x MELS floats in row order, segments: spans in seconds that overlap it): a
    row a tensor, from the stored streams."""
    stored = stored_tensors(media, id_col, media_col)
    kind = stored.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for i, stream in enumerate(batch.column(1).to_pylist()):
                t = read_tensors(stream)
                mel = pa.concat_arrays([c.storage for c in t.column("log_mel").chunks]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1).take(pa.array([0] * t.num_rows)), pa.array(np.arange(t.num_rows)), *(t.column(c).combine_chunks() for c in ("frames", "from_s", "to_s")), mel, t.column("segments").combine_chunks()], ["id", "tensor", "frames", "from_s", "to_s", "log_mel", "segments"])

    out = stored.select(F.col(f"`{id_col}`").alias("id"), "tensors").mapInArrow(run, f"id {kind}, tensor bigint, frames int, from_s double, to_s double, log_mel array<float>, segments array<struct<from_s:double,to_s:double>>")
    return out.withColumnRenamed("id", id_col)


def op10_audio(spark, sf_dir: str) -> DataFrame:
    stored = stored_tensors(store(table(spark, sf_dir, "documents")))
    facts = stored.columns[:-1]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([described(x) for x in batch.column(len(facts)).to_pylist()], pa.string())], [*facts, "feature"])

    return arrow_map(stored, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stored.schema[:-1]) + ", feature string")
