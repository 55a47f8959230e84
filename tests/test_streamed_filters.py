"""Streamed multi-frame filters equal the batch filter for any lookahead, over several micro-batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveloom._np import spectra as N
from waveloom.operators import spectral
from waveloom.streaming import streams

FFT, HOP, ORDER, BINS = 16, 8, 3, 4


def made():
    """A local function, as Spark sends those to its workers."""
    def coefs_of(s):
        """Coefficients and gains that follow from a frame alone, so batch and stream agree on them."""
        k = np.arange(1, ORDER + 1)[None, :, None]
        return 0.3 * np.cos(k * s[:, None, :BINS].real) + 0.2j * np.sin(k + s[:, None, :BINS].imag), 0.5 + 0.4 * np.tanh(np.abs(s))

    return coefs_of


@pytest.fixture(scope="module")
def clips():
    r = np.random.default_rng(3)
    return {k: r.standard_normal(HOP * (20 + 3 * k)) for k in range(3)}


def batch(spark, clips, lookahead):
    """The enhanced signals by spectral.deep_filter; masks and coefficients of frame t filter frame t."""
    out = {}
    for clip, x in clips.items():
        s = N.stft(x, FFT, HOP)
        c, g = made()(s)
        frames = spark.createDataFrame([(clip, 0, t, v.real.tolist(), v.imag.tolist()) for t, v in enumerate(s)], "clip_id long, ch int, t long, re array<double>, im array<double>")
        coefs = spark.createDataFrame([(clip, 0, t, v.real.tolist(), v.imag.tolist()) for t, v in enumerate(c)], "clip_id long, ch int, t long, c_re array<array<double>>, c_im array<array<double>>")
        y = spectral.deep_filter(frames, coefs, ORDER, lookahead, BINS).orderBy("t").collect()
        y = np.array([np.array(v.re) + 1j * np.array(v.im) for v in y])
        y[:, BINS:] = (s * g)[:, BINS:]
        out[clip] = y
    return out


@pytest.mark.parametrize("lookahead", [0, 1, 2])
def test_equals_the_batch_filter(spark, clips, lookahead, tmp_path):
    # coefficients come with the newest frame of a hop, so those that belong to frame t are asked for when t is the newest
    coefs_of = made()

    def provider(s):
        c, g = coefs_of(s)
        return g, c

    rows, r = [], np.random.default_rng(lookahead)
    for clip, x in clips.items():
        cuts = np.sort(r.choice(np.arange(1, len(x)), 14, replace=False))
        rows += [(clip, i, part.tolist()) for i, part in enumerate(np.split(x, cuts))]
    schema = "stream_id long, seq long, samples array<double>"
    for k, (lo, hi) in enumerate(((0, 4), (4, 5), (5, 11), (11, 99))):
        spark.createDataFrame([x for x in rows if lo <= x[1] < hi], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = streams.stream_enhance(source, provider, FFT, HOP, ORDER, lookahead, BINS)
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) >= 4
    got = spark.read.schema(out.schema).parquet(f"{tmp_path}/out").orderBy("stream_id", "t")
    want = batch(spark, clips, lookahead)
    at_once = streams.stream_enhance(spark.createDataFrame(rows, schema), provider, FFT, HOP, ORDER, lookahead, BINS).orderBy("stream_id", "t")
    for clip, x in clips.items():
        y = np.concatenate([np.zeros((lookahead, FFT // 2 + 1), complex), want[clip]])[: len(x) // HOP]
        f = np.fft.irfft(y, FFT, axis=1) * FFT * N.window(FFT)
        whole = np.zeros(len(f) * HOP + FFT - HOP)
        for t, v in enumerate(f):
            whole[t * HOP : t * HOP + FFT] += v
        for df in (got, at_once):
            z = np.concatenate([r.samples for r in df.where(F.col("stream_id") == clip).collect()])
            assert np.abs(z - whole[: len(z)]).max() < 1e-9 and len(z) == len(x) // HOP * HOP
