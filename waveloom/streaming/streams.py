"""Frame logic on unbounded streams: each operator is one step function with a small state per stream.

The same step runs in a batch (frames of a stream in order) and in a stream (typed state kept between micro-batches, packets put in order by
`ordered`), so both give the same rows however the packets are cut and in whatever order they arrive. Packets: stream_id, seq, samples.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waveloom._np import spectra as N

from .ordered import Array, Fields, Step, by_event_time, in_order, microseconds, of_columns

_HOPS: Fields = {"t": "long", "rest": Array()}


def stateful(rows: DataFrame, order: list[str], schema: str, step: Step, fields: Fields, **kw) -> DataFrame:
    """`in_order` over the first column of `order`: seq numbers without gaps on a stream, any order in a batch. kw: first (number), wait_ms
    (how long a gap may hold packets up), idle_ms (state of a stream that is quiet for so long is dropped)."""
    return in_order(rows, order[0], schema, step, fields, **kw)


def _hops(state: dict, pdf: dict, hop: int) -> tuple[int, np.ndarray]:
    """Number of the first whole hop that is now complete, and all of them as rows; the rest stays in the state."""
    x = np.concatenate([state.get("rest", np.zeros(0)), *[np.asarray(s, float) for s in pdf["samples"]]])
    n, first = len(x) // hop, state.get("t", 0)
    state["rest"], state["t"] = x[n * hop :], first + n
    return first, x[: n * hop].reshape(n, hop)


def rechunk(packets: DataFrame, hop: int, **kw) -> DataFrame:
    """stream_id, t, samples: packets of any sizes as whole hops in order."""
    @of_columns
    def step(state: dict, pdf: dict) -> dict:
        first, h = _hops(state, pdf, hop)
        return {"t": np.arange(first, first + len(h)), "samples": list(h)}

    return stateful(packets, ["seq"], "t long, samples array<double>", step, fields=_HOPS, **kw)


def _analyse(state: dict, h: np.ndarray, fft: int) -> np.ndarray:
    """Spectra of new hops after those in the state."""
    hop = h.shape[1]
    x = np.concatenate([state.get("memory", np.zeros(fft - hop)), h.reshape(-1)])
    state["memory"] = x[len(x) - (fft - hop) :]
    if not len(h):
        return np.zeros((0, fft // 2 + 1), complex)
    f = np.lib.stride_tricks.sliding_window_view(x, fft)[::hop]
    return np.fft.rfft(f * N.window(fft), axis=1) / (fft**2 / (2 * hop))


def _ema(state: dict, name: str, x: np.ndarray, start: np.ndarray, alpha: float) -> np.ndarray:
    s = N.ema(x, state.get(name, start), alpha)
    if len(s):
        state[name] = s[-1]
    return s


def stream_features(packets: DataFrame, fft: int, hop: int, widths: list[int], nb_df: int, alpha: float, **kw) -> DataFrame:
    """stream_id, t, feat_erb, re, im: the features of the batch job, with analysis memory and running means kept."""
    edges = np.concatenate([[0], np.cumsum(widths)[:-1]])

    @of_columns
    def step(state: dict, pdf: dict) -> dict:
        first, h = _hops(state, pdf, hop)
        s = _analyse(state, h, fft)
        erb = 10 * np.log10(np.add.reduceat(np.abs(s) ** 2, edges, axis=1) / np.array(widths) + 1e-10) if len(s) else np.zeros((0, len(widths)))
        erb = (erb - _ema(state, "mean", erb, N.mean_norm_start(len(widths)), alpha)) / 40
        z = s[:, :nb_df]
        z = z / np.sqrt(_ema(state, "unit", np.abs(z), N.unit_norm_start(z.shape[1]), alpha))
        return {"t": np.arange(first, first + len(h)), "feat_erb": list(erb), "re": list(z.real), "im": list(z.imag)}

    return stateful(packets, ["seq"], "t long, feat_erb array<double>, re array<double>, im array<double>", step, fields=_HOPS | {"memory": Array(), "mean": Array(), "unit": Array()}, **kw)


def silence_gate(frames: DataFrame, threshold: float = 1e-7, run: int = 5, seq: str = "t", **kw) -> DataFrame:
    """frames (stream_id, t, level: mean square) with silent: more than `run` frames in a row under the threshold. seq: the column
    that numbers the frames on a stream.

    As a batch, the run is counted by windows; as a stream, a counter is kept. With a column skipped (the frame got no mask; false: it
    got one), a skipped frame counts up as well and a masked one ends the run.
    """
    masks = "skipped" in frames.columns
    if not frames.isStreaming and not masks:
        w = W.partitionBy("stream_id").orderBy(seq)
        quiet = F.col("level") < threshold
        last = F.coalesce(F.max(F.when(~quiet, F.col("_n"))).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
        return frames.withColumn("_n", F.row_number().over(w)).withColumn("silent", (F.col("_n") - last) > run).select("stream_id", "t", "silent")

    @of_columns
    def step(state: dict, pdf: dict) -> dict:
        out, n = [], state.get("n", 0)
        for v, skipped in zip(pdf["level"], pdf["skipped"] if masks else [None] * len(pdf["level"])):
            n = n + 1 if v < threshold else 0
            out.append(n > run)
            if skipped is not None and n <= run:  # silent frames end before their masks
                n = n + 1 if skipped else 0
        state["n"] = n
        return {"t": pdf["t"], "silent": np.array(out, bool)}

    return stateful(frames, [seq], "t long, silent boolean", step, fields={"n": "long"}, **kw)


def stream_enhance(packets: DataFrame, provider: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray | None]], fft: int, hop: int, order: int = 1, lookahead: int = 0, nb_df: int = 0, beta: float | None = None, atten_db: float | None = None, **kw) -> DataFrame:
    """stream_id, t, samples: enhanced hops, fft - hop + lookahead * hop samples late.

    provider(spectra [T, F]) gives gains [T, F] and, for multi-frame filters, coefficients [T, order, nb_df] or None. The first nb_df
    bins are filtered over `order` frames; then come the post-filter and the attenuation limit.
    """
    @of_columns
    def step(state: dict, pdf: dict) -> dict:
        _, h = _hops(state, pdf, hop)
        s = _analyse(state, h, fft)
        bins = fft // 2 + 1
        gains, coefs = provider(s) if len(s) else (np.zeros((0, bins)), None)
        ring = np.concatenate([state.get("ring", np.zeros((order - 1 + lookahead, bins), complex)), s])
        masks = np.concatenate([state.get("masks", np.zeros((lookahead, bins))), gains])
        taps = np.concatenate([state.get("taps", np.zeros((lookahead, order, nb_df), complex)), coefs]) if coefs is not None and nb_df else None
        n = len(s)
        x = ring[order - 1 : order - 1 + n]  # frames `lookahead` behind the newest
        y = x * masks[:n]
        if taps is not None:
            # of the frame `lookahead` behind the newest, the frames from order - 1 - lookahead before it on
            stack = np.stack([ring[o + lookahead : o + lookahead + n, :nb_df] for o in range(order)], axis=1)
            y = y.copy()
            y[:, :nb_df] = (stack * taps[:n]).sum(axis=1)
            state["taps"] = taps[n:]
        if beta is not None and n:
            g = np.clip(np.abs(y) / (np.abs(x) + 1e-12), 1e-12, 1)
            y = y * ((1 + beta) / (1 + beta * (1 / np.sin(np.pi * g / 2)) ** 2))
        if atten_db is not None and abs(atten_db) < 100:
            k = 10 ** (-abs(atten_db) / 20)
            y = x * k + y * (1 - k)
        state["ring"], state["masks"] = ring[n:], masks[n:]
        f = np.fft.irfft(y, fft, axis=1) * fft * N.window(fft) if n else np.zeros((0, fft))
        out = np.concatenate([state.get("tail", np.zeros(fft - hop)), np.zeros(n * hop)])
        for i in range(fft // hop):
            part = f[:, i * hop : (i + 1) * hop].reshape(-1)
            out[i * hop : i * hop + len(part)] += part
        state["tail"] = out[n * hop :]
        first = state.get("o", 0)
        state["o"] = first + n
        return {"t": np.arange(first, first + n), "samples": list(out[: n * hop].reshape(n, hop))}

    bins = fft // 2 + 1
    fields = _HOPS | {"memory": Array(), "ring": Array((bins,), "complex"), "masks": Array((bins,)), "taps": Array((order, nb_df), "complex"), "tail": Array(), "o": "long"}
    return stateful(packets, ["seq"], "t long, samples array<double>", step, fields=fields, **kw)


def with_controls(frames: DataFrame, controls: DataFrame, delay: str = "10 seconds", control_delay: str | None = None) -> DataFrame:
    """stream_id, id, setting, changed: each frame (stream_id, ts, id) with the value of the control (stream_id, ts, value) last set at or
    before it (the greatest value of equal times; null before the first), and whether that changed since the frame before, which is when it is sent on.

    Both are streams or both tables. Streams have watermarks of their own: frames may come `delay` late, controls `control_delay` (None:
    as frames), and a frame is put out once both have passed it, so settings equal those of the batch for all that
    comes within the delays; what is later is dropped. Null times: a frame gets no row, a control sets nothing.
    """
    late = [(frames, delay, "frame"), (controls, control_delay or delay, "control")]
    none = lambda kind: F.lit(None).cast(kind)
    parts = []
    for rows, wait, kind in late:
        rows = rows.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
        rows = rows.withWatermark("ts", wait) if rows.isStreaming else rows
        frame = kind == "frame"
        parts.append(rows.select("stream_id", "ts", microseconds("ts").alias("us"), F.lit(int(frame)).alias("kind"), (F.col("id").cast("long") if frame else none("long")).alias("id"), (none("double") if frame else F.col("value").cast("double")).alias("value")))

    @of_columns
    def step(state: dict, pdf: dict) -> dict:
        out = []
        for kind, i, v in zip(pdf["kind"], pdf["id"], pdf["value"]):
            if not kind:
                state["v"] = None if pd.isna(v) else v
            else:
                now, sent = state.get("v"), state.get("sent")
                out.append((None if pd.isna(i) else int(i), now, now is not None and now != sent))
                state["sent"] = now
        return {"id": pd.array([x[0] for x in out], dtype="Int64"), "setting": np.array([x[1] for x in out], float), "changed": np.array([x[2] for x in out], bool)}

    # controls (kind 0) come before frames of the same time
    return by_event_time(parts[0].unionByName(parts[1]), ["us", "kind", "id", "value"], "id long, setting double, changed boolean", step, {"v": "double", "sent": "double"})


def latency_adapt(calls: DataFrame, sr: int, frame: int, start: int | None = None, **kw) -> DataFrame:
    """calls (stream_id, seq, rtf) with delay in samples after each: one frame more at rtf >= 1; one less, down to the start, at
    rtf < 0.5 after more than 10 * sr / frame calls since the last change. failed from when the delay reaches sr."""
    low = frame if start is None else start

    @of_columns
    def step(state: dict, pdf: dict) -> dict:
        delay, n, out = state.get("delay", low), state.get("n", -1), []
        for rtf in pdf["rtf"]:
            n += 1
            if rtf >= 1:
                delay, n = delay + frame, 0
            elif rtf < 0.5 and n > 10 * sr / frame and delay > low:
                delay, n = max(low, delay - frame), 0
            out.append(delay)
        state |= {"delay": delay, "n": n}
        return {"seq": pdf["seq"], "delay": np.array(out, "int64"), "failed": np.array(out, "int64") >= sr}

    return stateful(calls, ["seq"], "seq long, delay long, failed boolean", step, fields={"delay": "long", "n": "long"}, **kw)


def level_meter(packets: DataFrame, window: str = "1 hour", delay: str = "10 minutes", clip: float = 0.9999) -> DataFrame:
    """stream_id, start, n, rms, peak, clipped per tumbling window of event time; packets: stream_id, ts, sample."""
    rows = packets.withWatermark("ts", delay) if packets.isStreaming else packets
    a = F.abs("sample")
    out = rows.groupBy(F.window("ts", window), "stream_id").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("sample") * F.col("sample"))).alias("rms"), F.max(a).alias("peak"), F.sum((a > clip).cast("int")).alias("clipped"))
    return out.select("stream_id", F.col("window.start").alias("start"), "n", "rms", "peak", "clipped")
