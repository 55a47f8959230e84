"""Measures of one pair share what they derive from a signal; short signals are repeated where they are scored."""

import numpy as np
import pytest

from waveloom._np import quality
from waveloom.operators import quality as Q
from waveloom.plans import registry

NAMES = ["si_sdr", "ssnr", "fw_ssnr", "llr", "wss", "stoi"]


def test_spectra_are_made_once_a_signal(monkeypatch):
    r = np.random.default_rng(2)
    clean, one, two = (r.standard_normal(8000) for _ in range(3))
    apart = {(i, m): Q.METRICS[m].fn(clean, x, 16000) for i, x in enumerate((one, two)) for m in NAMES}
    calls, whole = [], quality._spectra
    monkeypatch.setattr(quality, "_spectra", lambda x, fs: (calls.append(1), whole(x, fs))[1])
    with quality.shared():
        together = {(i, m): Q.METRICS[m].fn(clean, x, 16000) for i, x in enumerate((one, two)) for m in NAMES}
    assert together == apart and len(calls) == 3  # 8 before
    assert quality.fw_segmental_snr(clean, one, 16000) == apart[0, "fw_ssnr"] and len(calls) == 5  # nothing is kept outside


def test_short_signals_are_repeated_in_the_task(spark):
    r = np.random.default_rng(3)
    x = {n: r.standard_normal((2, n)) for n in (1, 67, 5000, 9000)}
    table = lambda long: spark.createDataFrame([(n, *(np.resize(v, max(n, 8000) if long else n).tolist() for v in m)) for n, m in x.items()] + [(0, [], []), (-1, None, None)], "filename long, clean array<double>, enhanced array<double>")
    got, want = ({(v.filename, v.metric): (v.value, v.error) for v in Q.evaluate(table(long), NAMES, 16000, at_least=n).collect()} for long, n in ((False, 8000), (True, 0)))
    assert set(got) == set(want) and len(got) == 36 and all(got[k] == pytest.approx(want[k]) if got[k][0] is not None else got[k] == want[k] for k in want)
    plan = registry.queries()["q11_evaluate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "8000" not in plan  # no array of 8,000 samples before the rows are dealt
