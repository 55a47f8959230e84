"""WAV files in byte ranges, and files that appear all together or not at all."""

import os
import struct
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveloom._np import audio
from waveloom.sources import wav_source as W


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("wavs")
    r = np.random.default_rng(1)
    clips = {f"c{i}.wav": np.round(r.uniform(-1, 1, (1 + i % 2, n)) * 32767) / 32767 for i, n in enumerate((0, 1, 7, 100, 1001, 50))}
    os.makedirs(path / "sub")
    os.makedirs(path / "_staging-x")
    for name, x in clips.items():
        for where in ("sub", "_staging-x") if name == "c3.wav" else (".",):
            (path / where / name).write_bytes(audio.encode_wav(x, 8000))
    floats = r.standard_normal((2, 33)).astype("<f4")
    body = floats.T.tobytes()
    (path / "f.wav").write_bytes(b"RIFF" + struct.pack("<I", 4 + 24 + 11 + 8 + len(body)) + b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 3, 2, 16000, 128000, 8, 32) + b"odd " + struct.pack("<I", 3) + b"xyz\0" + b"data" + struct.pack("<I", len(body)) + body)
    return str(path), clips | {"f.wav": floats}


def joined(df):
    out = {}
    for r in df.orderBy("file", "start").collect():
        out.setdefault(os.path.basename(r.file), []).append(np.array(r.samples))
    return {k: np.concatenate(v, axis=1) for k, v in out.items()}


@pytest.mark.parametrize(("chunk", "size"), [(1, 60), (7, 100), (64, 1 << 20), (1000, 333)])
def test_all_samples_for_any_cut(spark, folder, chunk, size):
    path, clips = folder
    df = W.read_wav_chunks(spark, path, chunk, partition_bytes=size)
    got = joined(df)
    assert set(got) == {k for k, x in clips.items() if x.shape[1]}
    assert all(np.allclose(got[k], clips[k], atol=1e-6) for k in got)
    assert df.agg(F.max(F.size(F.get("samples", F.lit(0))))).first()[0] <= chunk
    assert size > 1000 or df.rdd.getNumPartitions() > 3


def test_headers_and_ranges(spark, folder):
    path, clips = folder
    h = {os.path.basename(r.file): r for r in W.read_wav_headers(spark, path).collect()}
    assert {k: (r.n_channels, r.n_samples) for k, r in h.items()} == {k: x.shape for k, x in clips.items()}
    assert all(r.length == os.path.getsize(r.file) and abs(r.modified.timestamp() - os.path.getmtime(r.file)) < 1e-3 for r in h.values())
    part = joined(W.read_wav_chunks(spark, f"{path}/c4.wav", 10, start=33, stop=58))
    assert np.allclose(part["c4.wav"], clips["c4.wav"][:, 33:58], atol=1e-6)
    with pytest.raises(Exception, match="samples, not"):
        W.read_wav_chunks(spark, f"{path}/c3.wav" if os.path.exists(f"{path}/c3.wav") else f"{path}/sub/c3.wav", 10, stop=101).collect()
    one = W.read_wav_chunks(spark, path, 10).where((F.col("start") >= 40) & (F.col("start") < 70) & F.col("file").endswith("c4.wav"))
    assert sorted(r.start for r in one.collect()) == [40, 50, 60]


def test_filters_skip_bytes():
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan, StringContains

    reader = W.WavReader({"path": "/x", "chunk": "10"}, False)
    left = list(reader.pushFilters([GreaterThanOrEqual(("start",), 40), LessThan(("start",), 70), EqualTo(("file",), "/x/a.wav"), StringContains(("file",), "a")]))
    assert (reader.low, reader.high, reader.files, len(left)) == (40, 69, {"/x/a.wav"}, 1)


def test_two_gigabytes_in_many_tasks(spark, tmp_path):
    n = 1 << 30  # samples of 16 bits; a sparse file
    with open(tmp_path / "long.wav", "wb") as f:
        f.write(b"RIFF" + struct.pack("<I", 36 + 2 * n) + b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 48000, 96000, 2, 16) + b"data" + struct.pack("<I", 2 * n))
        f.seek(44 + 2 * (n - 5))
        f.write(struct.pack("<5h", 1, 2, 3, 4, 5))
    df = W.read_wav_chunks(spark, str(tmp_path))
    assert df.rdd.getNumPartitions() == 33
    began = time.time()
    tail = W.read_wav_chunks(spark, str(tmp_path), start=n - 5)
    assert np.allclose(np.array(tail.first().samples) * 32767, [[1, 2, 3, 4, 5]], atol=1e-3) and tail.count() == 1
    assert time.time() - began < 20


def test_files_appear_together(spark, tmp_path):
    path = str(tmp_path / "out")
    clips = spark.createDataFrame([("x/a.wav", 8000, [[0.5, -0.5]]), ("x/b.wav", 8000, [[0.0] * 4, [1.0] * 4]), ("n.wav", 8000, None)], "file string, sr int, samples array<array<double>>")
    m = W.write_wavs(clips.repartition(3), path)
    assert {r.file: r.n_samples for r in m.collect()} == {"a.wav": 2, "b.wav": 4, "n.wav": 0}
    assert sorted(os.listdir(path)) == ["_manifest", "a.wav", "b.wav", "n.wav"]
    with pytest.raises(Exception, match="several clips"):
        W.write_wavs(clips.withColumn("file", F.lit("same.wav")), path)

    def fails(batches):
        for b in batches:
            if "bad" in b["file"].tolist():
                raise RuntimeError("this task fails")
            yield b

    bad = clips.unionByName(spark.createDataFrame([("bad", 8000, [[0.1]])], clips.schema)).repartition(4)
    with pytest.raises(Exception, match="this task fails"):
        W.write_wavs(bad.withColumn("file", F.concat(F.lit("z"), "file")).withColumn("file", F.when(F.col("file") == "zbad", "bad").otherwise(F.col("file"))).mapInPandas(fails, clips.schema), path)
    assert sorted(os.listdir(path)) == ["_manifest", "a.wav", "b.wav", "n.wav"] and len(os.listdir(f"{path}/_manifest")) == 1
    assert {r.file for r in W.write_wavs(clips.limit(1), path, overwrite=True).collect()} == {"a.wav"} and sorted(f for f in os.listdir(path) if f[0] != "_") == ["a.wav"]
