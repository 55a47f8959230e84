"""Bucketed signal tables meet without a shuffle."""

import pytest

from waveloom.operators import quality
from waveloom.sources import pairs


def test_no_exchange_between_signals(spark, tmp_path):
    for name, k in (("bp_clean", 1.0), ("bp_noisy", 0.5), ("bp_enh", 0.9)):
        spark.sql(f"drop table if exists {name}")
        clips = spark.createDataFrame([(f"{name}/c{i}.wav", [k * (i + j) for j in range(20)]) for i in range(30) if name != "bp_noisy" or i % 5], "file string, x array<double>")
        pairs.save_bucketed(clips, name, 4)
    both = pairs.paired(spark, "bp_clean", "bp_noisy", "bp_enh")
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("Scan parquet") == 3
    rows = both.collect()
    assert len(rows) == 24 and all(r.noisy[3] == r.clean[3] / 2 for r in rows)
    assert quality.evaluate(both, ["si_sdr"], 16000, noisy=True).where("error is null").count() == 48
    twice = spark.createDataFrame([("a/x.wav", [1.0]), ("b/x.wav", [1.0])], "file string, x array<double>")
    with pytest.raises(ValueError, match="2 files are named"):
        pairs.save_bucketed(twice, "bp_twice", 4)
    for name in ("bp_clean", "bp_noisy", "bp_enh"):
        spark.sql(f"drop table {name}")
