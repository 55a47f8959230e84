"""Queries on fixtures that are longer than the given tables' clips, texts and streams: nothing is cut."""

import datetime
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from waveloom.operators import synthesis
from waveloom.plans import adapters, registry, synthesis_queries

Q = registry.queries()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_word_edits_of_whole_texts(spark, tmp_path):
    texts = [([f"w{i * 7 % 31}" for i in range(n)], [f"w{i * 5 % 29}" for i in range(m)]) for n, m in ((30, 30), (41, 40), (90, 130), (300, 7))]
    texts.append(([f"a{i}" for i in range(200)], [f"{'ab'[i % 2]}{i}" for i in range(3, 220)]))  # more distinct words than one-byte characters
    rows = [(i, t, role, " ".join(x)) for i, pair in enumerate(texts) for t, (role, x) in enumerate(zip(("user", "assistant"), pair))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: (r.words, r.edits) for r in Q["x8_word_edits"](spark, str(tmp_path)).collect()}
    assert got == {i: (len(a), edits(a, b)) for i, (a, b) in enumerate(texts)}
    (a9,) = Q["a9_word_error_rate"](spark, str(tmp_path)).collect()
    assert (a9.n, a9.wer) == (5, round(sum(e for _, e in got.values()) / sum(n for n, _ in got.values()), 6))


def zeroed(x, idx, seed, max_percent, low, high):
    bits = lambda slot: int(hashlib.md5(f"{seed}:{idx}:{slot}".encode()).hexdigest()[:12], 16)
    share, done, i, out = 0.01 + bits("share") / 2**48 * (max_percent / 100 - 0.01), 0.0, 0, list(x)
    while done < share:
        at, n = bits(f"at{i}") % max(len(x) - high, 1), bits(f"n{i}") % (high - low) + low
        out[at:at + n] = [0.0] * len(out[at:at + n])
        done, i = done + n / len(x), i + 1
    return out, i


def test_zero_runs_until_the_share_is_reached(spark):
    sizes = [0, 1, 5, 67, 750, 20_000, 100_000]
    clips = spark.createDataFrame([(i, [1.0 + j for j in range(n)]) for i, n in enumerate(sizes)], "idx long, x array<double>")
    got = {r.idx: r.y for r in clips.select("idx", synthesis.zero_runs("x", "idx", 21, 30.0, 2, 6).alias("y")).collect()}
    want = {i: zeroed([1.0 + j for j in range(n)], i, 21, 30.0, 2, 6) if n else ([], 0) for i, n in enumerate(sizes)}
    assert got == {i: y for i, (y, _) in want.items()} and max(k for _, k in want.values()) > 1000


def test_silent_samples_are_no_zero_runs(spark, tmp_path):
    """Samples that were zero before count only where a run covers them."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(u * 1000 + k, u, start + datetime.timedelta(seconds=k), "click", float(k % 2)) for u, n in enumerate((40, 67)) for k in range(n)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.clip_id: r.zeros for r in Q["m9_zero_runs"](spark, str(tmp_path)).collect()}
    assert got == {u: zeroed([1.0] * n, u, 21, 30.0, 2, 6)[0].count(0.0) for u, n in ((0, 40), (1, 67))}


def test_latency_of_all_calls(spark, tmp_path):
    calls = [(k, k % 3 + 1, f"{k % 2}", (0.3, 0.4, 1.2, 0.7, 0.2)[k * k // 7 % 5 if k % 50 < 10 else 0] * (k % 3 * 200 + 450_000)) for k in range(4600)]
    spark.createDataFrame(calls, "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    want = []
    for stream in (1, 2, 3):
        delay, n = 100, -1
        for seq, (_, cust, _, price) in enumerate((c for c in calls if c[1] == stream), 1):
            rtf, n = price / (cust * 200 + 250_000), n + 1
            if rtf >= 1:
                delay, n = delay + 100, 0
            elif rtf < 0.5 and n > 10 and delay > 100:
                delay, n = delay - 100, 0
            want.append((stream, seq, delay, delay >= 400))
    got = sorted(tuple(r) for r in Q["w6_latency_adapt"](spark, str(tmp_path)).select("stream_id", "seq", "delay", "failed").collect())
    assert got == want and len({w[2] for w in want if w[1] > 1000}) > 3


def events(spark, path, sizes):
    """Users 0, 1, ... with so many events."""
    start = datetime.datetime(2024, 1, 1)
    rows = [(u * 100_000 + k, u, start + datetime.timedelta(seconds=k), "click", float((k * 37 + u * 11) % 97 - 40)) for u, n in enumerate(sizes) for k in range(n)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_interferers_over_whole_clips(spark, tmp_path):
    d = events(spark, tmp_path, [30, 67, 250, 41])
    want = {}
    for r in adapters.pairs(spark, d).collect():
        s, o = np.array(r.clean), 2 * np.array(r.noise)
        k = 1 / np.sqrt(((o @ o) + 1e-10) / ((s @ s) + 1e-10) * 10 + 1e-10)
        y = s + k * o
        top = max(np.abs(v).max() for v in (y, s, k * o))
        want |= {(r.clip_id, i): v / (top + 1e-10) if top - 1 > 1e-10 else v for i, v in enumerate(y.tolist())}
    got = {(r.clip_id, r.i): r.x for r in Q["m14_add_interferers"](spark, d).collect()}
    assert got == pytest.approx(want, abs=2e-6)


def test_long_clips_are_scored_whole(spark, tmp_path):
    d = events(spark, tmp_path, [60, 9000])
    sizes = {r.filename: [len(r.clean), len(r.noisy), len(r.enhanced)] for r in synthesis_queries._long_pairs(spark, d).collect()}
    assert sizes == {0: [8000] * 3, 1: [9000] * 3}
    n = {(r.clip_id, r.kind): r.n for r in Q["e9_log_spectra"](spark, d).groupBy("clip_id", "kind").agg(F.count("t").alias("n")).collect()}
    assert all(n[1, k] > 5 * n[0, k] for k in ("power", "mos", "asr"))


def test_max_freq_gathers_no_lists(spark, tmp_path):
    docs = [(i, "t", "en", f"src{i % 3}", 5) for i in range(90)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    df = Q["f9_pair_max_freq"](spark, str(tmp_path))
    assert "collect_list" not in df._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in df.collect()) == sorted((f"src{k}", sr, 6000.0 if sr == 48000 else 8000.0, sr == 48000) for k in range(3) for sr in (16000, 48000))


def test_every_clip_has_a_partner_whatever_the_ids(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    users = [5, 1000, 17, 10**12, -4]
    rows = [(i * 100 + k, u, start + datetime.timedelta(seconds=k), "click", float(k + i)) for i, u in enumerate(users) for k in range(20)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert {r.clip_id for r in adapters.pairs(spark, str(tmp_path)).collect()} == set(users)
    parts = synthesis_queries._parts(spark, str(tmp_path)).collect()
    assert {(r.idx, r.slot) for r in parts} == {(u, k) for u in users for k in range(4)} and len(parts) == 20
