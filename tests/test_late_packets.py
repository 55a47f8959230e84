"""Streams of several micro-batches with shuffled, late, repeated and lost packets, against the same operator over a table."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waveloom.plans.stream_queries import without_empty_batches
from waveloom.streaming import streams

SCHEMA = "stream_id long, seq long, samples array<double>"


def source(spark, path, slices, schema):
    for k, rows in enumerate(slices):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        time.sleep(0.02)  # files in this order
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")


def to_the_end(spark, df, path, timers=True):
    start = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start
    if timers:
        with without_empty_batches(spark):
            q = start()
    else:
        q = start()
    assert q.awaitTermination(100) and len([p for p in q.recentProgress if p["numInputRows"]]) >= 4
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def packets(seed, streams_, n):
    r = np.random.default_rng(seed)
    return [(s, i, r.standard_normal(r.integers(0, 6)).tolist()) for s in range(streams_) for i in range(n)]


def flat(df, *cols):
    return sorted((row.stream_id, *[tuple(np.round(row[c], 9)) if isinstance(row[c], list) else row[c] for c in cols]) for row in df.collect())


def test_shuffled_and_repeated_packets(spark, tmp_path):
    rows = packets(1, 3, 24)
    order = np.random.default_rng(2).permutation(len(rows))
    slices = [[rows[i] for i in part] for part in np.array_split(order, 5)]
    slices[3] += slices[0][:7]  # a second time
    make = lambda p: streams.rechunk(p, 4)
    got = to_the_end(spark, make(source(spark, tmp_path, slices, SCHEMA)), tmp_path)
    want = flat(make(spark.createDataFrame(rows + rows[:9], SCHEMA)), "t", "samples")
    assert flat(got, "t", "samples") == want and len(want) > 30
    whole = {s: np.concatenate([x for k, _, x in rows if k == s]) for s in range(3)}
    assert all(np.allclose(x, np.round(whole[s][t * 4 : t * 4 + 4], 9)) for s, t, x in want)


def test_batch_in_small_pieces(spark):
    from waveloom.streaming import ordered

    rows = [(s % 3 if s % 4 else None, i, float(i)) for s in range(8) for i in range(9)]
    df = spark.createDataFrame(rows, "stream_id long, seq long, v double")

    def step(state, pdf):
        state["sum"] = state.get("sum", 0.0) + pdf["v"].sum()
        return pd.DataFrame({"last": [pdf["seq"].iloc[-1]], "sum": [state["sum"]]})

    got = ordered.as_batch(df, ["seq"], "stream_id long, last long, sum double", step, "stream_id", once=True, piece=2).collect()
    assert {r.stream_id: r.sum for r in got if r.last == 8} == {k: 36.0 for k in (None, 0, 1, 2) if k in {r[0] for r in rows}}


@pytest.mark.parametrize("case", ["lost", "idle"])
def test_timers(spark, tmp_path, case):
    """lost: packet 2 never comes in time, so packets 3 and 4 wait, go on behind packet 1 when the timer gives up, and a late 2 is dropped.
    idle: state of a quiet stream goes, so a stream that comes back starts with packet 0 anew."""
    path = f"{tmp_path}/in"
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    put([(1, 0, [0.0, 1.0]), (1, 1, [2.0, 3.0])])
    src = spark.readStream.schema(SCHEMA).parquet(path)
    out = streams.rechunk(src, 2, wait_ms=4000) if case == "lost" else streams.rechunk(src, 2, wait_ms=1000, idle_ms=4000)
    q = out.writeStream.format("memory").queryName(f"timers_{case}").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="500 milliseconds").start()
    got = lambda: [(r.t, r.samples) for r in spark.table(f"timers_{case}").orderBy("t", F.col("samples")[0]).collect()]

    def wait(n, most=40):
        end = time.time() + most
        while len(got()) < n and time.time() < end:
            assert q.isActive, q.exception()
            time.sleep(0.3)
        return got()

    try:
        first = [(0, [0.0, 1.0]), (1, [2.0, 3.0])]
        assert wait(2) == first
        if case == "lost":
            put([(1, 4, [8.0, 9.0]), (1, 3, [6.0, 7.0])])
            assert wait(4) == [*first, (2, [6.0, 7.0]), (3, [8.0, 9.0])]  # in order, behind packet 1
            put([(1, 2, [4.0, 5.0]), (1, 5, [10.0, 11.0])])
            assert wait(5)[4] == (4, [10.0, 11.0])
            time.sleep(1.5)
            assert len(got()) == 5
        else:
            time.sleep(6)
            put([(1, 0, [5.0, 5.0])])
            assert wait(3) == [(0, [0.0, 1.0]), (0, [5.0, 5.0]), (1, [2.0, 3.0])]
    finally:
        q.stop()


def test_controls_of_a_stream_of_their_own(spark, tmp_path):
    r = np.random.default_rng(7)
    base = pd.Timestamp("2024-01-01")
    at = lambda s: (base + pd.Timedelta(seconds=float(s))).to_pydatetime()
    frames = [(int(s), at(t), int(t * 10 + s)) for s in range(3) for t in range(40)]
    controls = [(int(s), at(t), float(r.integers(1, 4))) for s in range(3) for t in (3, 3, 11.5, 20, 21, 33)]
    ends = [(None, at(500), None)], [(None, at(500), 0.0)]
    fs, cs = "stream_id long, ts timestamp, id long", "stream_id long, ts timestamp, value double"

    def cut(rows, k, jitter):
        slot = [min(k - 1, max(0, int((row[1] - base.to_pydatetime()).total_seconds() / 40 * k + j))) for row, j in zip(rows, r.uniform(-jitter, jitter, len(rows)))]
        return [[x for x, s in zip(rows, slot) if s == i] for i in range(k)]

    a = source(spark, f"{tmp_path}/f", [*cut(frames, 5, 0.9), ends[0]], fs)
    b = source(spark, f"{tmp_path}/c", [*cut(controls, 5, 0.5), ends[1]], cs)
    got = to_the_end(spark, streams.with_controls(a, b, "30 seconds"), tmp_path, timers=False)
    want = streams.with_controls(spark.createDataFrame(frames, fs), spark.createDataFrame(controls, cs))
    cols = ("id", "setting", "changed")
    key = lambda df: sorted((r.stream_id, *["-" if r[c] is None else r[c] for c in cols]) for r in df.where("stream_id is not null").collect())
    assert key(got) == key(want) and len(key(got)) == 120
    for s, i, setting, _ in key(want):
        before = [(t, v) for k, t, v in controls if k == s and t <= at((i - s) / 10)]
        assert setting == (max(before)[1] if before else "-")
