"""Scans of many short clips are not called for each of them, and go on from batch to batch."""

import numpy as np
import pytest

from waveloom._np import spectra as N
from waveloom.operators import chunks


@pytest.mark.parametrize(("size", "fan"), [(4, 2), (11, 4096)])
def test_running_means_over_batches(spark, monkeypatch, size, fan):
    plans, keep = [], chunks.save
    monkeypatch.setattr(chunks, "FAN", fan)
    monkeypatch.setattr(chunks, "save", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), keep(df, name))[1])
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "3")  # chunks and groups of chunks are longer
    try:
        r = np.random.default_rng(4)
        x = {c: r.standard_normal((n, 3)) for c, n in enumerate([1, 40, 2, 7, 4, 1, 13])}
        df = spark.createDataFrame([(c, 0, t, v.tolist()) for c, m in x.items() for t, v in enumerate(m)], "clip_id long, ch int, t long, v array<double>").repartition(3)
        got = {(q.clip_id, q.t): q.s for q in chunks.ema(df, {"v": ("s", [1.0, 2.0, 3.0])}, 0.8, size).collect()}
    finally:
        spark.conf.set(name, before)
    want = {(c, t): v for c, m in x.items() for t, v in enumerate(N.ema(m, np.array([1.0, 2.0, 3.0]), 0.8))}
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-12) for k in want)
    assert len(plans) > 1 and not any("FlatMapGroupsInPandas" in p for p in plans)
