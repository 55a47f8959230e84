"""Chunked signals and frames equal whole clips for chunks of any size; no row, group or window holds a clip."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveloom._np import spectra as N
from waveloom.functions import signal as S
from waveloom.operators import chunks, spectral

FFT, HOP = 16, 8


@pytest.fixture(scope="module")
def clips():
    r = np.random.default_rng(8)
    return {k: r.standard_normal(n) for k, n in enumerate((0, 1, 7, 15, 16, 17, 64, 203))}


@pytest.fixture(scope="module")
def table(spark, clips):
    return spark.createDataFrame([(k, x.tolist()) for k, x in clips.items()] + [(99, None)], "clip_id long, x array<double>")


def joined(df, column="x"):
    out = {}
    for r in df.orderBy("clip_id", "start").collect():
        out.setdefault(r.clip_id, []).append(np.array(r[column], float))
    return {k: np.concatenate(v) for k, v in out.items()}


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_cut_gather_and_frames(spark, clips, table, size):
    cut = chunks.cut(table, size)
    assert {k: x.tolist() for k, x in joined(cut).items()} == {k: x.tolist() for k, x in clips.items() if len(x)}
    assert cut.agg(F.max(F.size("x"))).first()[0] <= size
    long = table.select("clip_id", F.posexplode("x").alias("i", "v"))
    assert {k: x.tolist() for k, x in joined(chunks.gather(long, ["i"], size)).items()} == {k: x.tolist() for k, x in clips.items() if len(x)}
    for window, hop in ((16, 8), (5, 9), (20, 3)):
        got = {(r.clip_id, r.t): r.w for r in chunks.frame_signal(cut, window, hop, size).collect()}
        want = {(r.clip_id, r.t): r.w for r in table.select("clip_id", F.posexplode(S.frames("x", window, hop)).alias("t", "w")).collect()}
        assert got == want, (window, hop)


@pytest.mark.parametrize("size", [8, 24, 1000])
def test_transform_and_back(spark, clips, table, size):
    s = chunks.stft(chunks.cut(table, size), FFT, HOP, size)
    got = {(r.clip_id, r.t): np.array(r.re) + 1j * np.array(r.im) for r in s.collect()}
    want = {(k, t): v for k, x in clips.items() for t, v in enumerate(N.stft(x, FFT, HOP))}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)
    back = joined(chunks.istft(s, FFT, HOP, size))
    for k, x in clips.items():
        whole = N.istft(N.stft(x, FFT, HOP), FFT, HOP)
        assert np.allclose(back.get(k, np.zeros(0)), whole)
    assert chunks.istft(s, FFT, HOP, size).agg(F.max(F.size("x"))).first()[0] <= size


@pytest.fixture(scope="module")
def frames(spark):
    r = np.random.default_rng(9)
    x = {(c, h): r.standard_normal((n, 6)) * 20 - 60 for c, n in ((0, 90), (1, 1), (2, 33)) for h in (0, 1)}
    rows = [(c, h, t, v.tolist(), (v / 3).tolist()) for (c, h), m in x.items() for t, v in enumerate(m)]
    return spark.createDataFrame(rows, spectral.FRAME).repartition(5), x


@pytest.mark.parametrize(("size", "fan"), [(1, 4), (7, 2), (1000, 4096)])
def test_running_means_by_chunk(spark, frames, monkeypatch, size, fan):
    df, x = frames
    monkeypatch.setattr(chunks, "FRAMES", size)
    monkeypatch.setattr(chunks, "FAN", fan)  # chunks of chunks of chunks
    got = {(r.clip_id, r.ch, r.t): r.out for r in spectral.ema_mean_norm(df, 0.9, "re", "out").collect()}
    unit = {(r.clip_id, r.ch, r.t): r for r in spectral.ema_unit_norm(df, 0.9, 4).collect()}
    for (c, h), m in x.items():
        want = (m - N.ema(m, N.mean_norm_start(6), 0.9)) / 40
        z = (m + 1j * m / 3)[:, :4]
        w = z / np.sqrt(N.ema(np.abs(z), N.unit_norm_start(4), 0.9))
        for t in range(len(m)):
            assert np.allclose(got[c, h, t], want[t], atol=1e-10)
            assert np.allclose(np.array(unit[c, h, t].re) + 1j * np.array(unit[c, h, t].im), w[t])
    assert len(got) == df.count()


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_neighbours_of_frames(spark, frames, monkeypatch, size):
    df, x = frames
    monkeypatch.setattr(chunks, "FRAMES", size)
    got = {(r.clip_id, r.ch, r.t): np.array(r.re_n) for r in spectral.unfold_frames(df, 4, lookahead=1).collect()}
    snr = {(r.clip_id, r.ch, r.t): r.lsnr for r in spectral.local_snr(df, df.withColumn("re", S.scaled("im", 0.5)), 4).collect()}
    monkeypatch.setattr(chunks, "FRAMES", 100_000)
    whole = {(r.clip_id, r.ch, r.t): r.lsnr for r in spectral.local_snr(df, df.withColumn("re", S.scaled("im", 0.5)), 4).collect()}
    for (c, h), m in x.items():
        padded = np.concatenate([np.zeros((2, 6)), m, np.zeros((1, 6))])
        for t in range(len(m)):
            assert np.allclose(got[c, h, t], padded[t : t + 4])
            assert snr[c, h, t] == pytest.approx(whole[c, h, t])
    assert len(got) == len(snr) == df.count()


def test_features_of_chunks_equal_those_of_clips(spark, table):
    args = (FFT, HOP, [1, 2, 2, 4], 5, 0.9)
    want = {(r.clip_id, r.t): (r.feat_erb, r.re, r.im) for r in spectral.features(table.where("x is not null"), *args).collect()}
    got = {(r.clip_id, r.t): (r.feat_erb, r.re, r.im) for r in chunks.features(chunks.cut(table, 24), *args, 24).collect()}
    assert set(got) == set(want) and all(np.allclose(a, b, atol=1e-9) for k in want for a, b in zip(got[k], want[k]))
