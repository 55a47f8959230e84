"""Properties of the operators: seeds, partitions, edge cases, and streams against batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waveloom.functions import signal as S
from waveloom.operators import catalog, curation, scoring, spectral, synthesis
from waveloom.operators import quality as quality_ops
from waveloom.sources import audio as sources
from waveloom.sources.paths import new_path
from waveloom.streaming import streams


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("snr", [-10, -5, 0, 5, 10, 20, 40])
@pytest.mark.parametrize("gain", [-6, 0, 6])
def test_mixture_has_the_asked_snr(spark, snr, gain):
    rng = np.random.default_rng(100 + snr + gain)
    x, y = (rng.uniform(-0.1, 0.1, 2000).tolist() for _ in range(2))
    r = synthesis.mix_at_snr(frame(spark, [(x, y, snr, gain)], "speech array<double>, noise array<double>, snr int, gain int")).first()
    c, n, m = (np.array(v) for v in (r.speech, r.noise, r.noisy))
    assert abs(10 * np.log10((c**2).sum() / (n**2).sum()) - snr) < 1e-4
    assert np.allclose(c + n, m) and np.abs(m).max() <= 1


def test_split_does_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id").alias("key"), (F.col("id") % 3).alias("g"))
    a = catalog.split_dataset(df, "g", 5).toPandas().sort_values("key")
    b = catalog.split_dataset(df.repartition(7), "g", 5).toPandas().sort_values("key")
    assert list(a.split) == list(b.split)
    assert catalog.split_leaks(catalog.split_dataset(df, "g", 5)).count() == 0
    for _, g in a.groupby("g"):
        n = len(g)
        assert (g.split == "train").sum() == int(0.7 * n) and (g.split == "valid").sum() == int(0.15 * n)


@pytest.mark.parametrize("n", [1, 2, 4, 17])
@pytest.mark.parametrize("size", [1, 2, 16])
def test_batches(spark, n, size):
    s = spark.range(n).select(F.col("id").alias("idx"), F.lit("train").alias("split"))
    full = catalog.make_batches(s, size, 1).toPandas()
    rest = catalog.make_batches(s, size, 1, drop_last=False).toPandas()
    assert len(full) == n // size * size and len(rest) == n and sorted(rest.pos) == list(range(n))


def test_empty_and_null_clips(spark):
    df = frame(spark, [(1, []), (2, None), (3, [1.0, float("nan")])], "k int, x array<double>")
    r = {x.k: x for x in df.select("k", S.rms("x").alias("rms"), S.argmax("x").alias("at"), S.is_finite("x").alias("ok"), curation.usable_noise("x").alias("use")).collect()}
    assert r[1].rms is None and r[2].rms is None and not r[3].ok and not r[1].use


def test_segments_of_short_clips(spark):
    df = frame(spark, [(1, [1.0] * 30), (2, [1.0] * 91)], "k int, x array<double>")
    got = {r.k: r.n for r in df.select("k", F.size(S.segments("x", 10)).alias("n")).collect()}
    assert got == {1: 3, 2: 1}


def test_patience(spark):
    for values, rule, stop in (([1, 1, 1, 1], "min", 3), ([1, 0.9, 1, 1, 1], "min", 4), ([1, 1.1, 1, 1, 1], "max", 4), ([4, 3, 2, 1], "min", None)):
        df = frame(spark, [("r", i, float(v)) for i, v in enumerate(values)], "run string, epoch long, value double")
        assert scoring.early_stop(df, 3, rule).first().stop_epoch == stop


def test_word_edits(spark):
    df = frame(spark, [("The cat sat.", "the cat sat"), ("a b c", "a x c d"), ("é a", "e a"), ("", "a b")], "a string, b string")
    assert [r.e for r in df.select(scoring.word_edits("a", "b").alias("e")).collect()] == [0, 2, 1, 2]


def test_identity_deep_filter_and_order_one_mask(spark):
    f = frame(spark, [(1, 0, t, [1.0 * t, 2.0], [0.5, 1.0 * t]) for t in range(5)], "clip_id long, ch int, t long, re array<double>, im array<double>")
    one, zero = [1.0, 1.0], [0.0, 0.0]
    coefs = f.select("clip_id", "ch", "t", F.array(*[F.array(*map(F.lit, v)) for v in (zero, zero, one)]).alias("c_re"), F.array(*[F.array(*map(F.lit, zero))] * 3).alias("c_im"))
    y = spectral.deep_filter(f, coefs, 3).orderBy("t").collect()
    assert [(r.re, r.im) for r in y] == [(r.re, r.im) for r in f.orderBy("t").collect()]
    shifted = spectral.deep_filter(f, coefs, 3, lookahead=1).orderBy("t").collect()
    assert shifted[0].re == [1.0, 2.0] and shifted[4].re == [0.0, 0.0]


def test_evaluate_leaves_bad_pairs_out(spark):
    p = frame(spark, [("a", [0.1, 0.2] * 2000, [0.1, 0.21] * 2000), ("b", [float("nan")] * 100, [0.1] * 100)], "filename string, clean array<double>, enhanced array<double>")
    got = quality_ops.evaluate(p, ["si_sdr", "stoi"], 16000).toPandas()
    assert got[got.filename == "b"].error.notna().all() and got[(got.filename == "a") & (got.metric == "si_sdr")].value.iloc[0] > 20


def test_compose_gates(spark):
    clips = frame(spark, [(i, [1.0]) for i in range(200)], "idx long, x array<double>")
    out = synthesis.compose(clips, [("a", 0.5, lambda x, _: S.scaled(x, 2.0))], 1).toPandas()
    n = sum(v[0] == 2.0 for v in out.x)
    assert 70 < n < 130
    again = synthesis.compose(clips.repartition(5), [("a", 0.5, lambda x, _: S.scaled(x, 2.0))], 1).toPandas()
    assert dict(zip(out.idx, (v[0] for v in out.x))) == dict(zip(again.idx, (v[0] for v in again.x)))


def test_replace_by_key(spark):
    cols = "ds_type string, key string, ds_name string, n_samples long, sr int, max_freq int, n_channels int"
    new = frame(spark, [("speech", "a", "n", 5, 100, 0, 1), ("speech", "c", "n", 0, 100, 0, 1), ("speech", "d", "n", 9, 100, 40, 17)], cols)
    old = frame(spark, [("speech", "a", "o", 1, 100, 10, 1, False), ("speech", "b", "o", 1, 100, 10, 1, False)], cols + ", is_short boolean")
    got = {r.key: (r.ds_name, r.max_freq) for r in catalog.build_clip_dataset(new, old).collect()}
    assert got == {"a": ("n", 50), "b": ("o", 10)}


def _wav_clips(spark):
    return frame(spark, [("x/a.wav", 8000, [[0.5, -0.5, 0.25]]), ("x/b.wav", 8000, [[0.0] * 4, [1.0] * 4])], "file string, sr int, samples array<array<double>>")


def test_wav_files(spark):
    path = new_path(spark, "t-wav")
    assert sources.write_wav_clips(_wav_clips(spark), path, "e").count() == 2
    got = {r.file.rsplit("/", 1)[1]: r for r in sources.read_wav_clips(spark, path).collect()}
    assert set(got) == {"a_e.wav", "b_e.wav"} and got["b_e.wav"].n_channels == 2 and got["a_e.wav"].n_samples == 3


@pytest.mark.parametrize("cuts", [[50], [1, 2, 30, 17], [10, 0, 40]])
def test_streams_do_not_depend_on_packets(cuts):
    rng = np.random.default_rng(0)
    x = rng.standard_normal(50)
    half = lambda s: (np.full(s.shape, 0.5), None)

    class Batch:
        """Holds what `stateful` is given, to run the step by hand."""

    def steps(make):
        held = {}
        old = streams.stateful
        streams.stateful = lambda rows, order, schema, step, fields, **kw: held.update(step=step)
        try:
            make()
        finally:
            streams.stateful = old
        return held["step"]

    for make, column in ((lambda: streams.rechunk(None, 4), "samples"), (lambda: streams.stream_features(None, 16, 8, [1, 2, 2, 4], 5, 0.9), "feat_erb"), (lambda: streams.stream_enhance(None, half, 16, 8, beta=0.02, atten_db=12, lookahead=1), "samples")):
        step = steps(make)
        whole = step({}, pd.DataFrame({"samples": [x]}))
        state, parts, at = {}, [], 0
        for n in cuts:
            parts.append(step(state, pd.DataFrame({"samples": [x[at : at + n]]})))
            at += n
        got = pd.concat(parts)
        assert list(got.t) == list(whole.t)
        assert np.allclose(np.stack(list(got[column])), np.stack(list(whole[column])))


def test_no_reference_scores_without_segments(spark):
    def predict(batches):
        for b in batches:
            yield pd.DataFrame({"sig_raw": [3.0] * len(b), "bak_raw": [3.0] * len(b), "ovr_raw": [3.0] * len(b)})

    clips = frame(spark, [(1, [0.1] * 200), (2, [])], "clip_id long, x array<double>")
    got = {r.clip_id: r.sig for r in quality_ops.score_segments(clips, predict, 10).collect()}
    assert got[2] is None and got[1] == pytest.approx(-0.08397278 * 9 + 1.22083953 * 3 + 0.0052439)


def test_named_transforms(spark):
    from waveloom.functions import signal as S
    from waveloom.operators import synthesis as M

    clips = spark.createDataFrame([(i, [float((i * 7 + k) % 11 - 5) for k in range(40)]) for i in range(30)], "idx long, x array<double>")
    config = [{"name": "gain", "db": 6.0}, {"name": "clip", "p": 0.4, "share": 0.5}, {"name": "remove_dc"}, {"name": "zero_runs"}, {"name": "crop", "n": 20}]
    got = {r.idx: r.x for r in M.compose(clips, M.named_steps(config, 3), 3).collect()}
    plain = [("gain", 1.0, lambda x, _: S.scaled(x, 10 ** 0.3)), ("clip", 0.4, lambda x, _: S.clip_samples(x, 0.5)), ("remove_dc", 1.0, lambda x, _: S.remove_dc(F.array(x))[0]), ("crop", 1.0, lambda x, i: S.random_crop(x, F.lit(20), 3, i))]
    assert got == {r.idx: r.x for r in M.compose(clips, plain, 3).collect()} and {len(v) for v in got.values()} == {20}
    with pytest.raises(ValueError):
        M.named_steps([{"name": "no such"}], 1)


def test_multires_distance_by_loop(spark):
    import math

    from waveloom.operators import spectral as P

    r = np.random.default_rng(2)
    rows = [(k, r.standard_normal(50 + k).tolist(), r.standard_normal(50).tolist()) for k in range(3)] + [(9, [], [1.0])]
    got = {x.filename: x.distance for x in P.multires_distance(spark.createDataFrame(rows, "filename long, enhanced array<double>, clean array<double>"), [8, 16], 0.6, 2.0, 0.5).collect()}

    def frames(x, fft):
        x = np.concatenate([x[1 : fft // 2 + 1][::-1], x, x[-fft // 2 - 1 : -1][::-1]])
        for at in range(0, len(x) - fft + 1, fft // 4):
            yield np.array([sum(x[at + i] * (0.5 - 0.5 * math.cos(2 * math.pi * i / fft)) * np.exp(-2j * np.pi * i * k / fft) for i in range(fft)) / math.sqrt(fft) for k in range(fft // 2 + 1)])

    for k, a, b in rows[:3]:
        want = 0.0
        for fft in (8, 16):
            d, c, n = 0.0, 0.0, 0
            for u, v in zip(frames(np.array(a[:50]), fft), frames(np.array(b[:50]), fft)):
                for p, q in zip(u, v):
                    x, y = abs(p) ** 0.6, abs(q) ** 0.6
                    d += (x - y) ** 2
                    c += abs(p / abs(p) * x - q / abs(q) * y) ** 2
                    n += 1
            want += 2 * d / n + 0.5 * c / n / 2
        assert got[k] == pytest.approx(want, rel=1e-9)
    assert got[9] is None


def test_overfit_batches_and_ordered_epochs(spark):
    s = spark.createDataFrame([(i, i % 2, f"k{i:03d}") for i in range(75)], "idx long, split int, key string")
    got = catalog.make_batches(s, 8, 1, overfit=True).toPandas()
    assert all(sorted(g.idx) == [i for i in range(75) if i % 2 == split][:8] for (split, _), g in got.groupby(["split", "batch_no"])) and got.batch_no.max() == 3
    plain = catalog.make_batches(s, 8, 1, drop_last=False, shuffle=False).toPandas().sort_values(["split", "pos"])
    assert plain[plain.split == 0].idx.tolist() == list(range(0, 75, 2)) and (plain.batch_no == plain.pos // 8).all()
    keys = s.select(F.lit("d").alias("ds_name"), "key", F.lit(1.5).alias("factor"))
    ordered = catalog.epoch_keys(keys, 1, shuffle=False).orderBy("pos").toPandas()
    assert ordered.key.tolist() == [f"k{i % 75:03d}" for i in range(113)]  # 112.5, rounded up


def test_quartiles_over_many_equal_values(spark):
    from waveloom.operators import scoring

    rows = [("a", float(v)) for v in [3.0] * 500 + list(range(200))] + [("b", 1.5), ("b", None), ("c", None)]
    got = {r.metric: r for r in scoring.describe_scores(spark.createDataFrame(rows, "metric string, value double")).collect()}
    x = [v for m, v in rows if m == "a"]
    assert [got["a"].q1, got["a"].q2, got["a"].q3] == pytest.approx(list(np.quantile(x, [0.25, 0.5, 0.75])))
    assert (got["b"].n, got["b"].q1, got["b"].high) == (1, 1.5, 1.5) and got["c"].n == 0 and got["c"].q2 is None
