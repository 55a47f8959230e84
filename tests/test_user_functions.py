"""Functions that a user gives: gains, segment scores, metrics that fail; and queries of signals against plain loops."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waveloom._np import audio, quality
from waveloom.functions import signal as S
from waveloom.operators import quality as Q
from waveloom.operators import spectral, synthesis
from waveloom.plans import adapters, registry

DATA = "/root/testdata/sf0.001"
QUERIES = registry.queries()


def test_gains_of_a_function(spark):
    f = spark.createDataFrame([(c, 0, t, [1.0 + t, 2.0], [0.5, -1.0]) for c in range(3) for t in range(4)], "clip_id long, ch int, t long, re array<double>, im array<double>")

    def provider(batches):
        for pdf in batches:
            yield pdf[["clip_id", "ch", "t"]].assign(gains=[[0.1 * t, 0.5] for t in pdf["t"]])

    got = spectral.enhance(f, Q.provided_gains(f, provider)).collect()
    assert len(got) == 12 and all(r.re == pytest.approx([0.1 * r.t * (1 + r.t), 1.0]) and r.im == pytest.approx([0.05 * r.t, -0.5]) for r in got)


def test_scores_of_a_function(spark):
    x = {1: np.sin(np.arange(200) / 7.0), 2: np.ones(95), 3: np.zeros(3)}

    def predict(batches):
        for b in batches:
            level = b.map(lambda w: float(np.mean(np.square(w))))
            yield pd.DataFrame({"sig_raw": 1 + level, "bak_raw": 2 + level, "ovr_raw": 3 + level})

    got = {r.clip_id: r for r in Q.score_segments(spark.createDataFrame([(k, v.tolist()) for k, v in x.items()], "clip_id long, x array<double>"), predict, 10).collect()}
    segments = spark.createDataFrame([(k, v.tolist()) for k, v in x.items()], "clip_id long, x array<double>").select("clip_id", F.explode(S.segments("x", 10)).alias("w")).collect()
    for k in (1, 2):
        levels = [float(np.mean(np.square(s.w))) for s in segments if s.clip_id == k]
        assert levels and got[k].num_hops == len(levels) and got[k].sig_raw == pytest.approx(1 + np.mean(levels)) and got[k].ovr_raw == pytest.approx(3 + np.mean(levels))


def test_a_metric_that_fails_leaves_the_others(spark, monkeypatch):
    monkeypatch.setattr(Q, "METRICS", dict(Q.METRICS))

    def broken(clean, est, fs):
        if len(clean) < 600:
            raise RuntimeError("too short")
        return float(fs)

    Q.register("rate", Q.Metric(("rate",), broken, 8000))
    r = np.random.default_rng(1)
    rows = [(n, r.standard_normal(n).tolist(), r.standard_normal(n).tolist()) for n in (1000, 3000)] + [(7, [1.0, float("nan")], [1.0, 2.0])]
    got = {(v.filename, v.metric): v for v in Q.evaluate(spark.createDataFrame(rows, "filename long, clean array<double>, enhanced array<double>"), ["si_sdr", "rate"], 16000).collect()}
    assert got[3000, "rate"].value == 8000 and got[1000, "rate"].value is None and got[1000, "rate"].error == "too short"
    assert got[1000, "si_sdr"].value is not None and "finite" in got[7, "si_sdr"].error


def test_quality_queries_equal_the_measures(spark):
    from waveloom.plans import synthesis_queries

    pairs = {r.filename: {k: np.array(r[k]) for k in ("clean", "noisy", "enhanced")} for r in synthesis_queries._long_pairs(spark, DATA).collect()}
    measures = {"fw_ssnr": quality.fw_segmental_snr, "llr": quality.llr, "wss": quality.wss, "stoi": quality.stoi}
    got = QUERIES["q11_evaluate"](spark, DATA).collect()
    assert len(got) == len(pairs) * 2 * 6
    for r in got:
        if r.metric in measures:
            assert r.value == pytest.approx(measures[r.metric](pairs[r.filename]["clean"], pairs[r.filename][r.variant], 16000), abs=1e-4), r
    for name, metric in (("q4_fw_segmental_snr", "fw_ssnr"), ("q5_llr", "llr"), ("q6_wss", "wss"), ("q7_stoi", "stoi")):
        assert {(r.filename, r.variant, r.value) for r in QUERIES[name](spark, DATA).collect()} == {(r.filename, r.variant, r.value) for r in got if r.metric == metric}


def test_augmentation_queries_equal_the_helpers(spark):
    clips = {r.clip_id: np.array(r.x) for r in adapters.signals(spark, DATA).collect()}
    rms = lambda x: float(np.sqrt(np.mean(x**2)))
    seed = 21
    for r in QUERIES["m7_random_speed"](spark, DATA).collect():
        rate = int(round(synthesis._generator(seed, r.idx, "speed").uniform(0.9, 1.1) * 8000 / 500) * 500)
        y = audio.resample(clips[r.idx], 8000, rate)
        assert r.n == len(y) and r.rms == pytest.approx(rms(y), abs=1e-6)
    for r in QUERIES["m6_random_filters"](spark, DATA).collect():
        y = audio.random_lfilt(clips[r.idx], synthesis._generator(seed, r.idx, "lfilt"))
        assert r.rms == pytest.approx(rms(audio.random_biquads(y, 8000, synthesis._generator(seed, r.idx, "biquad"))), abs=1e-6)
    for r in QUERIES["m10_coloured_noise"](spark, DATA).collect():
        g = synthesis._generator(seed, r.idx, "noise")
        assert (r.n, r.rms) == (400, pytest.approx(rms(audio.coloured_noise(g.uniform(-2, 2), 400, 200, g)[0]), abs=1e-6))
    limited = synthesis.limit_bandwidth(spark.createDataFrame([(k, x.tolist(), 9000) for k, x in clips.items()], "idx long, x array<double>, max_freq int"), 48000, seed).collect()
    assert all(np.allclose(r.x, audio.low_pass_resample(clips[r.idx], r.max_freq, 48000)) for r in limited) and {r.max_freq for r in limited} <= {4000, 6000, 8000}


def test_gains_are_computed_once_a_row(spark):
    """A gain that Spark moves into the function over samples is not computed for each of them: a clip of 20,000 samples would take its square."""
    from pyspark.sql import functions as F

    from waveloom.functions import signal as S

    df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: i / 20_000.0).alias("x"))
    plan = df.withColumn("k", S.mix_gain("x", "x", F.lit(0))).select(S.scaled("x", "k").alias("y"))._jdf.queryExecution().optimizedPlan().toString()
    start = plan.index("transform(array(")  # the gain is an element of this array, outside of the function over samples
    assert "aggregate(" in plan[start:plan.index("lambdafunction(transform(", start)]
