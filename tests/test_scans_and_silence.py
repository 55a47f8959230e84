"""Running values over ranges equal plain loops when one group holds all rows; silence, empty clips and zero lengths stop nothing."""

import random

import pytest
from pyspark.sql import functions as F

from waveloom.functions import signal as S
from waveloom.operators import catalog, curation, scans, scoring, spectral, synthesis


@pytest.fixture(scope="module")
def log(spark):
    """One run with most rows, a short one and one row of a null run, in small ranges."""
    r = random.Random(1)
    rows = [("long", e, float(r.randint(0, 400))) for e in range(700)] + [("short", e, float(r.randint(0, 9))) for e in range(7)] + [(None, 0, 5.0)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "run string, epoch long, value double").repartition(7), sorted(rows, key=lambda x: (x[0] or "", x[1]))


@pytest.mark.parametrize("range_rows", [60, 500_000])
def test_runs_in_ranges(spark, log, monkeypatch, range_rows):
    df, rows = log
    monkeypatch.setattr(scans, "RANGE_ROWS", range_rows)
    monkeypatch.setattr(scans.in_ranges, "__defaults__", (range_rows,))
    want, best, last, stop = {}, {}, {}, {}
    for run, e, v in rows:
        better = run not in best or v < best[run]
        best[run] = min(v, best.get(run, v))
        last[run] = e if better else last[run]
        if e - last[run] >= 40:
            stop.setdefault(run, e)
        want[run, e] = (better, best[run])
    assert {(r.run, r.epoch): (r.is_best, r.best) for r in scoring.running_best(df).collect()} == want
    assert {r.run: r.stop_epoch for r in scoring.early_stop(df, 40).collect()} == {run: stop.get(run) for run in best}
    got = {(r.run, r.epoch): r.recent for r in scoring.recent_loss(df, 100, 1).collect()}
    for run in best:
        values = [v for k, _, v in rows if k == run]
        for e in range(len(values)):
            part = values[max(0, e - 99) : e + 1]
            assert got[run, e] == pytest.approx(sum(part) / len(part))
    kept = {(r.run, r.epoch) for r in scoring.retention(df, 3).where("kept").collect()}
    assert kept == {("long", e) for e in (697, 698, 699)} | {("short", e) for e in (4, 5, 6)} | {(None, 0)}
    assert scans.in_ranges(df, "run", ["epoch"]).select("_p").distinct().count() >= (10 if range_rows == 60 else 1)


def test_settings_carried_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(scans.in_ranges, "__defaults__", (25,))
    frames = [(s, t, t) for s in ("a", "b") for t in range(300)]
    controls = [("a", 3, 1.5), ("a", 3, 1.0), ("a", 250, None), ("a", 280, -2.0), ("c", 0, 9.0)]
    got = scoring.asof_controls(spark.createDataFrame(frames, "stream_id string, ts long, id long"), spark.createDataFrame(controls, "stream_id string, ts long, value double")).collect()
    assert len(got) == 600
    for r in got:
        assert r.setting == (None if r.stream_id == "b" or r.ts < 3 else 1.5 if r.ts < 280 else -2.0)


def test_draws_of_a_small_pool_are_dealt_evenly(spark):
    plan, pool = spark.range(2000).withColumnRenamed("id", "idx"), spark.createDataFrame([(f"c{i}", [float(i)] * 50) for i in range(3)], "key string, x array<double>")
    out = catalog.attach_draws(plan, pool, "noise", 2, 5, crop=("x", 8))
    rows = out.collect()
    assert len(rows) == 4000 and {len(r.x) for r in rows} == {8} and all(r.x[0] == int(r.key[1:]) for r in rows)
    plain = catalog.attach_draws(plan, pool.drop("x"), "noise", 2, 5)
    assert sorted((r.idx, r.slot, r.key) for r in rows) == sorted((r.idx, r.slot, r.key) for r in plain.collect())
    demand = plain.groupBy("key").count().collect()
    assert len(demand) == 3 and catalog.attach_draws(plan, pool.limit(0), "noise", 2, 5).count() == 0


def test_silence_has_a_level_and_stays(spark):
    clips = spark.createDataFrame([("zeros", [[0.0] * 400]), ("none", [[]]), ("null", None), ("nothing", []), ("negative", [[-1.0] * 400]), ("loud", [[0.0] * 200 + [1.0] * 200])], "key string, samples array<array<double>>")
    e = {r.key: r.e for r in clips.select("key", S.windowed_energy("samples", 100).alias("e")).collect()}
    assert set(e["zeros"]) == {-200.0} and e["null"] is None and e["nothing"] is None and set(e["none"]) <= {-200.0}
    got = {r.key: len(r.samples[0]) for r in curation.trim_silence(clips, 100).collect()}
    assert got["zeros"] == 400 and set(got) & {"none", "null", "nothing"} == set()


def test_nothing_to_divide_by(spark):
    w = scoring.wer(spark.createDataFrame([("a", 2, 0), ("b", 1, 4), ("b", 3, 0)], "g string, edits int, words int"), ["g"])
    assert sorted(tuple(r) for r in w.collect()) == [("a", None, None, 1, 1), ("b", 1.0, 0.75, 2, 1)]
    t = scoring.rtf_stats(spark.createDataFrame([("a", 1.0, 0.0), ("b", 3.0, 2.0), ("b", 1.0, 0.0), ("b", None, 2.0)], "g string, processing double, audio double"), ["g"])
    assert sorted(tuple(r) for r in t.collect()) == [("a", None, None, 0, 1), ("b", 1.5, 1.5, 1, 1)]


def test_empty_noises_add_nothing(spark):
    rows = [(1, 0, [1.0, 2.0], 0), (1, 1, [], 0), (1, 2, None, 0), (2, 0, [], 0), (3, 0, [3.0], None)]
    got = {r.idx: r.noise for r in synthesis.combine_noises(spark.createDataFrame(rows, "idx long, slot int, x array<double>, gain int"), 2, 1).collect()}
    assert sorted(got[1]) == [1.0, 2.0] and got[2] == [0.0, 0.0] and got[3] == [3.0, 3.0]


def test_repeated_names_are_reported(spark):
    files = lambda *names: spark.createDataFrame([(n,) for n in names], "file string")
    got = {r.name: (r.sides, r.n_clean, r.n_noisy) for r in catalog.pair_by_name(files("a/x.wav", "b/x.wav", "a/y.wav", "a/z.wav", None), files("n/x.wav", "m/x.wav", "n/y.wav", "n/w.wav")).collect()}
    assert got == {"x.wav": ("repeated", 2, 2), "y.wav": ("both", 1, 1), "z.wav": ("clean", 1, 0), "w.wav": ("noisy", 0, 1)}


def test_bandwidth_by_counts(spark):
    r = random.Random(2)
    frames = [(c, 0, t, [1.0 if k <= r.choice([3, 6, 9]) else 0.0 for k in range(13)], [0.0] * 13) for c in range(3) for t in range(40)]
    df = spark.createDataFrame(frames, "clip_id long, ch int, t long, re array<double>, im array<double>")
    got = {x.clip_id: x.max_bin for x in spectral.estimate_bandwidth(df, 13, 48000, window=4).collect()}
    assert set(got) == {0, 1, 2} and all(isinstance(v, int) for v in got.values())


def test_many_keys_of_a_group(spark):
    keys = spark.range(30_000).select(F.col("id").alias("key"), F.lit("one").alias("ds_type"))
    out = catalog.sample_keys(keys, 5000, 3)
    assert out.count() == 5000 == out.distinct().count() and out.columns == ["key", "ds_type"]
