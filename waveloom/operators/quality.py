"""Quality of degraded against clean signals: a registry of metrics and the evaluation job."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waveloom._np import audio
from waveloom._np import quality as Q
from waveloom.functions import signal as S

from . import scoring
from .balance import balanced


@dataclass(frozen=True)
class Metric:
    """A batch function of (clean, degraded, rate), the names of its values, and the rate it wants (None: any)."""

    names: tuple[str, ...]
    fn: Callable[[np.ndarray, np.ndarray, int], float | tuple[float, ...] | None]
    rate: int | None = None


def _si_sdr(clean: np.ndarray, est: np.ndarray, _: int) -> float:
    a = (clean @ est + Q.EPS) / (clean @ clean + Q.EPS)
    return float(10 * np.log10((a * a * (clean @ clean) + Q.EPS) / (((est - a * clean) ** 2).sum() + Q.EPS)))


def _segmental_snr(clean: np.ndarray, est: np.ndarray, fs: int) -> float:
    size, hop = Q._shape(fs)
    c, d = (Q.frames(x, size, hop) * Q.hann(size) for x in (clean, est))
    snr = 10 * np.log10((c**2).sum(axis=1) / (((c - d) ** 2).sum(axis=1) + Q.EPS) + Q.EPS)[:-1]
    return float(np.clip(snr, -10, 35).mean()) if len(snr) else float("nan")


METRICS: dict[str, Metric] = {}


def register(name: str, metric: Metric) -> None:
    METRICS[name] = metric


register("si_sdr", Metric(("si_sdr",), _si_sdr))
register("ssnr", Metric(("ssnr",), _segmental_snr, 16000))
register("fw_ssnr", Metric(("fw_ssnr",), Q.fw_segmental_snr, 16000))
register("llr", Metric(("llr",), Q.llr, 16000))
register("wss", Metric(("wss",), Q.wss, 16000))
register("stoi", Metric(("stoi",), Q.stoi))


def evaluate(pairs: DataFrame, metrics: list[str], fs: int, noisy: bool = False, at_least: int = 0) -> DataFrame:
    """filename, variant, metric, value, error: the chosen metrics of enhanced (and noisy) against clean signals.

    Signals are read once per pair and brought to each metric's rate; lengths are cut to the shorter one. A metric that fails for a
    pair has a null value and its message in error, and the job goes on. Pairs are dealt so that all tasks have about as many samples, and a
    pair without a signal has errors and no values. Shorter signals are repeated to at_least samples, in the task, so that short rows travel.
    """
    chosen = {m: METRICS[m] for m in metrics}
    variants = ("enhanced", "noisy") if noisy else ("enhanced",)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                at: dict[tuple, np.ndarray] = {}
                for c in ("clean", *variants):
                    if r[c] is not None and 0 < len(r[c]) < at_least:
                        r[c] = np.resize(np.asarray(r[c], float), at_least)

                def brought(name: str, n: int, rate: int) -> np.ndarray:
                    """n samples of a signal at a rate, made once for all metrics and variants."""
                    if (name, n, rate) not in at:
                        x = np.asarray(r[name][:n], float)
                        if not np.isfinite(x).all():
                            raise ValueError("samples that are not finite")
                        at[name, n, rate] = audio.resample(x, fs, rate)
                    return at[name, n, rate]

                with Q.shared():
                    for variant in variants:
                        for m in chosen.values():
                            try:
                                n = min(len(r["clean"]), len(r[variant]))
                                rate = m.rate or fs
                                got = m.fn(brought("clean", n, rate), brought(variant, n, rate), rate)
                                got = got if isinstance(got, tuple) else (got,)
                                rows += [(r["filename"], variant, k, None if v is None or np.isnan(v) else float(v), None) for k, v in zip(m.names, got)]
                            except Exception as e:  # noqa: BLE001
                                rows += [(r["filename"], variant, k, None, str(e)[:200]) for k in m.names]
            yield pd.DataFrame(rows, columns=["filename", "variant", "metric", "value", "error"])

    kind = pairs.schema["filename"].dataType.simpleString()
    dealt = balanced(pairs.select("filename", "clean", *variants), "filename", F.greatest(F.size("clean"), F.lit(at_least)))
    return dealt.mapInPandas(run, f"filename {kind}, variant string, metric string, value double, error string")


def score_segments(clips: DataFrame, predict: Callable[[Iterator[pd.Series]], Iterator[pd.DataFrame]], sr: int, personal: bool = False) -> DataFrame:
    """No-reference scores: segments of the clips through a user's model, mapped and averaged per clip.

    predict is an iterator function from series of segments to frames with sig_raw, bak_raw, ovr_raw; it is called once per task, so
    a model is loaded once. A clip without a whole segment has null scores.
    """
    @F.pandas_udf("sig_raw double, bak_raw double, ovr_raw double")
    def model(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from predict(batches)

    segs = clips.select("clip_id", F.explode(S.segments("x", sr)).alias("w")).select("clip_id", model("w").alias("p")).select("clip_id", "p.*")
    return clips.select("clip_id").join(scoring.aggregate_segments(segs, personal), "clip_id", "left")


def provided_gains(frames: DataFrame, provider: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None, clean: DataFrame | None = None, kind: str = "irm") -> DataFrame:
    """clip_id, ch, t, gains from a user's function over batches of frames; without one, ideal masks from the clean frames."""
    from .spectral import ideal_mask

    if provider is not None:
        return frames.mapInPandas(provider, "clip_id long, ch int, t long, gains array<double>")
    c = clean.select("clip_id", "ch", "t", F.col("re").alias("_r"), F.col("im").alias("_i"))
    return frames.join(c, ["clip_id", "ch", "t"]).select("clip_id", "ch", "t", ideal_mask("_r", "_i", "re", "im", kind).alias("gains"))


#: Rows of matrices that are worked on at once.
PIECE = 256


def multiframe_filter(corr: DataFrame, n: int, kind: str = "mvdr") -> DataFrame:
    """clip_id, ch, t, w_re, w_im (arrays of n arrays of bins) from matrices rss_re, rss_im, rnn_re, rnn_im (arrays [n][n][bins]).

    The noisy correlation is Rss + loaded Rnn; the inter-frame vector is the last column of Rss over its last element.
    """
    def numbers(part: pa.RecordBatch, name: str) -> np.ndarray:
        """[rows, bins, n, n] of rows with equally many bins."""
        flat = lambda c: part.column(c).flatten().flatten().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, n, n, -1)
        return (flat(name + "_re") + 1j * flat(name + "_im")).transpose(0, 3, 1, 2)

    def nested(x: np.ndarray) -> pa.Array:
        """[rows, n, bins] as arrays of arrays."""
        rows, _, bins = x.shape
        inner = pa.ListArray.from_arrays(pa.array(np.arange(rows * n + 1, dtype="int32") * bins), pa.array(np.ascontiguousarray(x).reshape(-1)))
        return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype="int32") * n), inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = pc.list_value_length(batch.column("rss_re").flatten().flatten()).to_numpy(zero_copy_only=False)[:: n * n]
            ends = np.append(np.flatnonzero(np.diff(bins)) + 1, len(bins)).tolist() if len(bins) else []
            start = 0
            for end in ends:  # rows with equally many bins, in pieces, so that memory does not grow with the batch
                for at in range(start, end, PIECE):
                    part = batch.slice(at, min(PIECE, end - at))
                    ss, nn = numbers(part, "rss"), numbers(part, "rnn")
                    last = ss[..., -1]
                    rxx = ss + Q.loaded(nn)
                    w = Q.mvdr_weights(last / (last[..., -1:] + 1e-10), rxx) if kind == "mvdr" else Q.wiener_weights(last, rxx)
                    w = w.transpose(0, 2, 1)
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("clip_id", "ch", "t")], nested(w.real), nested(w.imag)], ["clip_id", "ch", "t", "w_re", "w_im"])
                start = end

    return corr.mapInArrow(run, "clip_id long, ch int, t long, w_re array<array<double>>, w_im array<array<double>>")


def log_spectra(clips: DataFrame, kind: str = "power", sr: int = 16000) -> DataFrame:
    """clip_id, t, v: 'power' log power, 'mos' or 'asr' log-mel levels of clips (clip_id, x)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for clip, x in zip(pdf["clip_id"], pdf["x"]):
                v = Q.log_power(x) if kind == "power" else Q.log_mel(x, sr, kind)
                if len(v):
                    yield pd.DataFrame({"clip_id": clip, "t": np.arange(len(v)), "v": list(v)})

    return clips.select("clip_id", "x").mapInPandas(run, "clip_id long, t long, v array<double>")


def missing_scores(scores: DataFrame) -> Column:
    return F.count(F.when(scores["error"].isNotNull(), 1))
