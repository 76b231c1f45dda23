"""Audio tensors: stored as fixed-shape Arrow tensors and read back; features against plain NumPy."""

import numpy as np
import pyarrow as pa
import pytest

from tabulon.llm import audio


def plain(payload):
    """(mel frames, frame energies) by direct sums."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    h = audio.resample_filter().T.ravel().astype(float)
    up = np.zeros(len(x) * audio.UP)
    up[:: audio.UP] = x
    y = np.convolve(up, h)[:: audio.DOWN][: -(-len(x) * audio.UP // audio.DOWN)]
    n = max(1, -(-(len(y) - audio.FRAME) // audio.HOP) + 1)
    y = np.concatenate([y, np.zeros((n - 1) * audio.HOP + audio.FRAME - len(y))])
    frames = np.stack([y[i * audio.HOP : i * audio.HOP + audio.FRAME] for i in range(n)])
    power = np.abs(np.fft.rfft(frames * np.hanning(audio.FRAME))) ** 2
    return np.log(power @ audio.mel_bank(audio.RATE * audio.UP / audio.DOWN) + 1e-6), (frames**2).mean(axis=1)


@pytest.mark.parametrize("text", ["", "x", "some words " * 40, "loud \x01 and ~~~ quiet " * 3000 + "é" * 5000])
def test_features_by_direct_sums(text):
    payload = audio.padded(text.encode())
    mel, found, step = audio.features(payload)
    want, energy = plain(payload)
    assert audio.UP > 1 and mel.shape == want.shape and np.allclose(mel, want, atol=5e-2)
    assert step == pytest.approx(audio.HOP / (audio.RATE * audio.UP / audio.DOWN))
    assert found.tolist() == audio.segments(energy.astype(np.float32)).tolist()


def test_stream_is_of_fixed_shape():
    mel, found, step = audio.features(audio.padded(("words and ~~~~ " * 500 + "zzz" * 900).encode()))
    raw = audio.tensor_stream(mel, found, step)
    t = audio.read_tensors(raw)
    assert isinstance(t.schema.field("log_mel").type, pa.FixedShapeTensorType) and t.schema.field("log_mel").type.shape == [audio.TENSOR_FRAMES, audio.MELS]
    assert sum(t.column("frames").to_pylist()) == len(mel)
    back = np.concatenate([c.to_numpy_ndarray() for c in t.column("log_mel").chunks]).reshape(-1, audio.MELS)
    assert np.array_equal(back[: len(mel)], mel)
    for a, z, own in zip(t.column("from_s").to_pylist(), t.column("to_s").to_pylist(), t.column("segments").to_pylist(), strict=True):
        assert [(s["from_s"], s["to_s"]) for s in own] == [(s * step, e * step) for s, e in found.tolist() if s * step < z and e * step > a]
    said = dict(x.split("=") for x in audio.described(raw).split(";"))
    assert said["segments"] == str(len(found)) and said["active"] == str(int((found[:, 1] - found[:, 0]).sum())) and len(found) > 0
    assert np.allclose([float(x) for x in said["mel"].split(",")], mel.mean(axis=0), atol=2e-3)


def test_other_shapes_are_refused():
    batch = pa.record_batch([pa.FixedShapeTensorArray.from_numpy_ndarray(np.zeros((2, 4, 5), np.float32))], ["log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    with pytest.raises(ValueError, match="another shape"):
        audio.read_tensors(sink.getvalue().to_pybytes())


def test_query_speaks_of_stored_tensors(spark, tmp_path, monkeypatch):
    rows = [(1, "one text of words " * 300, "a"), (1, "one text of words " * 300, "b"), (None, None, "c"), (3, "", "d")]
    spark.createDataFrame(rows, "doc_id long, text string, n_bytes string").write.parquet(f"{tmp_path}/documents.parquet")
    got = audio.op10_audio(spark, str(tmp_path)).collect()
    assert len(got) == 4 and len({tuple(r)[1:] for r in got}) == 2
    for r in got:
        text = rows[0][1] if r["doc_id"] == 1 else ""
        assert r["feature"] == audio.described(audio.tensor_stream(*audio.features(audio.padded(text.encode()))))
    each = audio.extract(audio.store(spark.read.parquet(f"{tmp_path}/documents.parquet").withColumnRenamed("doc_id", "d.id"), id_col="d.id"), id_col="d.id").collect()
    mel = audio.features(audio.padded(rows[0][1].encode()))[0]
    own = sorted((r["tensor"], r["frames"], tuple(r["log_mel"])) for r in each if r["d.id"] == 1)
    assert len(own) == 2 * -(-len(mel) // audio.TENSOR_FRAMES) and sum(x[1] for x in own) == 2 * len(mel)
    assert np.array_equal(np.array([x[2] for x in own[::2]], np.float32).reshape(-1, audio.MELS)[: len(mel)], mel)
