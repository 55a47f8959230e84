"""Edits against the plain table, failed steps and rejected rows against planted ones, table functions in SQL."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveloom._np import edits
from waveloom._np import spectra as N
from waveloom.functions import signal as S
from waveloom.functions import tables
from waveloom.operators import quality, rejects, scoring, synthesis


def plain(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            d[i][j] = max(i, j) if not i or not j else min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    i, j, ins, dele, sub = len(a), len(b), 0, 0, 0
    while i or j:
        if i and j and d[i][j] == d[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            sub, i, j = sub + (a[i - 1] != b[j - 1]), i - 1, j - 1
        elif i and d[i][j] == d[i - 1][j] + 1:
            dele, i = dele + 1, i - 1
        else:
            ins, j = ins + 1, j - 1
    return d[-1][-1], (ins, dele, sub)


@pytest.mark.parametrize("words", [2, 5, 90])
def test_edits_equal_the_plain_table(words):
    r = random.Random(words)
    for _ in range(300):
        a, b = ([f"w{r.randrange(words)}" for _ in range(r.randint(0, 40))] for _ in range(2))
        if r.random() < 0.5:
            b = [w if r.random() < 0.8 else "x" for w in a if r.random() < 0.9]
        n, three = plain(a, b)
        assert edits.distance(a, b) == edits.distance(b, a) == n and edits.counts(a, b) == three and sum(three) == n


def test_long_texts_take_seconds():
    r = random.Random(1)
    a = [f"w{int(r.paretovariate(0.8)) % 9000}" for _ in range(20_000)]
    b = [w if r.random() < 0.9 else "?" for w in a if r.random() < 0.95]
    began = time.time()
    n, three = edits.distance(a, b), edits.counts(a, b)
    assert sum(three) == n and three[0] - three[1] == len(b) - len(a) and time.time() - began < 10


def test_word_counts_of_rows(spark):
    rows = [("the cat sat", "the hat sat down"), ("a", ""), ("same", "Same!"), (None, "x")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [tuple(r.c) for r in df.select(scoring.word_edit_counts(F.col("a"), F.col("b")).alias("c")).collect()]
    assert got == [(1, 0, 1), (0, 0, 1), (0, 0, 0), (None, None, None)]
    assert [r.e for r in df.select(scoring.word_edits(F.col("a"), F.col("b")).alias("e")).collect()] == [2, 1, 0, None]


def test_failed_steps_are_named(spark):
    clips = spark.createDataFrame([(i, [float(i)] * 3) for i in range(40)], "idx long, x array<double>")
    odd = lambda x, idx: F.when(idx % 2 == 0, S.scaled(x, 2.0))  # noqa: E731  fails on odd clips
    never = lambda x, idx: F.lit(None).cast("array<double>")
    out = synthesis.compose(clips, [("odd", 1.0, odd), ("half", 0.5, never), ("gain", 1.0, lambda x, _: S.scaled(x, 10.0))], 3, failed="why")
    rows = {r.idx: r for r in out.collect()}
    assert all(r.x == [r.idx * (20.0 if r.idx % 2 == 0 else 10.0)] * 3 for r in rows.values())
    assert {i for i, r in rows.items() if "odd" in r.why} == set(range(1, 40, 2)) and 5 < sum("half" in r.why for r in rows.values()) < 35
    assert rejects.problems(out, "idx", "why").where("reason = 'odd'").count() == 20
    assert "why" not in synthesis.compose(clips, [("odd", 1.0, odd)], 3).columns


def test_rejected_rows_and_counts(spark):
    clips = spark.createDataFrame([(0, [1.0]), (1, [float("nan")]), (2, []), (3, None), (4, [2.0])], "idx long, x array<double>")
    kept, bad, seen = rejects.split(clips, [("finite", S.is_finite("x")), ("long", F.size("x") >= 1)])
    assert sorted(r.idx for r in kept.collect()) == [0, 4]
    assert {r.idx: r.reasons for r in bad.collect()} == {1: ["finite"], 2: ["long"], 3: ["finite", "long"]}
    assert seen.get == {"rows": 5, "kept": 2, "finite": 2, "long": 2}
    pairs = spark.createDataFrame([("a", [0.1] * 9000, [0.1] * 9000), ("b", [float("inf")] * 9000, [0.1] * 9000), ("c", None, [0.1])], "filename string, clean array<double>, enhanced array<double>")
    errors = rejects.failed_scores(quality.evaluate(pairs, ["si_sdr"], 16000)).collect()
    assert {r.filename for r in errors} == {"b", "c"}


def test_table_functions(spark):
    tables.register(spark)
    r = np.random.default_rng(1)
    x = {k: r.standard_normal(n).tolist() for k, n in enumerate((0, 5, 16, 90))}
    spark.createDataFrame([*x.items(), (9, None)], "clip_id long, x array<double>").createOrReplaceTempView("udtf_clips")
    f = {(r.clip_id, r.t): r.w for r in spark.sql("select clip_id, t, w from udtf_clips, lateral clip_frames(x, 16, 8)").collect()}
    assert f == {(k, t): v[t * 8 : t * 8 + 16] for k, v in x.items() for t in range((len(v) - 8) // 8)}
    s = {(r.clip_id, r.t): np.array(r.re) + 1j * np.array(r.im) for r in spark.sql("select clip_id, t, re, im from udtf_clips, lateral clip_spectrum(x, 16, 8)").collect()}
    want = {(k, t): v for k, c in x.items() for t, v in enumerate(N.stft(np.array(c), 16, 8))}
    assert set(s) == set(want) and all(np.allclose(s[k], want[k]) for k in want)
    with pytest.raises(Exception, match="array of samples"):
        spark.sql("select * from udtf_clips, lateral clip_frames(clip_id, 16, 8)").collect()
