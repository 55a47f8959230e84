"""Cleaning of clips: silence trimming, usability rules, quality filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waveloom.functions import signal as S


def usable_noise(x, least: int = 100, least_peak: float = 1e-10) -> Column:
    return (F.size(S.col(x)) >= least) & F.coalesce(S.max_abs(x) >= least_peak, F.lit(False))


def usable_speech(x, least_rms: float = 1e-10, least: int = 0) -> Column:
    """least: 2048 samples where the band is to be extended."""
    return F.coalesce(S.rms(x) >= least_rms, F.lit(False)) & (F.size(S.col(x)) >= least)


def trim_silence(clips: DataFrame, sr: int, start_db: float = -120.0, stop_db: float = -100.0, start_skip: int = 14, stop_skip: int = 10, start_back: int = 15, stop_back: int = 10, least_stop: int = 10) -> DataFrame:
    """clips (samples channel-first) without silence at their ends, and n_before.

    Windows of sr / 10 samples (hop sr / 20) carry an energy in dB. The start is the first window after start_skip
    above start_db, less start_back windows; the stop, counted from the end, the first one after stop_skip above
    stop_db, less stop_back. A clip with nothing left is dropped; one whose stop is within least_stop samples of its
    end stays whole, its start too. In a silent clip no window is above either level (all have -200 dB), so it stays whole; whether it
    is of use is for usable_speech and usable_noise to say. Clips that are null, have no channel or no sample are dropped.
    """
    hop = sr // 20
    e = F.transform(S.windowed_energy("samples", sr), lambda v, i: F.struct(v.alias("e"), i.alias("i")))
    out = clips.withColumn("_e", e).withColumn("n_before", F.size(F.get("samples", F.lit(0))))
    first = F.get(F.filter("_e", lambda z: (z["e"] > start_db) & (z["i"] > start_skip)), F.lit(0))["i"]
    back = F.filter(F.reverse("_e"), lambda z: (z["e"] > stop_db) & (F.size("_e") - 1 - z["i"] > stop_skip))
    back_i = F.size("_e") - 1 - F.get(back, F.lit(0))["i"]
    out = out.withColumn("_a", F.greatest(F.coalesce((first - start_back) * hop, F.lit(0)), F.lit(0))).withColumn("_z", F.coalesce(-(back_i - stop_back) * hop, F.lit(0)))
    out = out.where(F.col("_a") - F.col("_z") < F.col("n_before"))
    kept = F.transform("samples", lambda c: F.slice(c, F.col("_a") + 1, F.greatest(F.col("n_before") + F.col("_z") - F.col("_a"), F.lit(0))))
    return out.withColumn("samples", F.when(F.col("_z") < -least_stop, kept).otherwise(F.col("samples"))).drop("_e", "_a", "_z")


def filter_by_mos(clips: DataFrame, scores: DataFrame, on: str = "key", sig: float = 4.2, bak: float = 4.5, ovr: float = 4.0) -> DataFrame:
    """Clips whose three scores are all strictly above their thresholds."""
    good = scores.where((F.col("sig") > sig) & (F.col("bak") > bak) & (F.col("ovr") > ovr)).select(on)
    return clips.join(good, on, "left_semi")


def drop_unknown(transcripts: DataFrame, column: str = "text") -> DataFrame:
    return transcripts.where(~(F.col(column).contains("<UNKNOWN") | F.col(column).contains("unknown")))


def split_finite(clips: DataFrame, column: str = "samples") -> tuple[DataFrame, DataFrame]:
    """Clips with finite samples only, and the rest."""
    ok = S.is_finite(column)
    return clips.where(ok), clips.where(~ok)
