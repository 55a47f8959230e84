"""Noisy/clean training pairs: plans, assembly, mixing and augmentations. Draws are hashes, so a seed gives one corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waveloom._np import audio
from waveloom.functions import draws
from waveloom.functions import signal as S

SNRS, GAINS, INTERFERER_SNRS = [-5, 0, 5, 10, 20, 40], [-6, 0, 6], [30, 20, 15]


def sample_plan(keys: DataFrame, seed: int, snrs: list[int] = SNRS, gains: list[int] = GAINS) -> DataFrame:
    """keys (idx, ...) with snr, gain, n_noises (2 to 5), noise_gains, interferer_snr and has_speech (false for SNRs of -100 or less)."""
    idx = F.col("idx")
    noise_gains = F.transform(F.sequence(F.lit(0), F.col("n_noises").cast("int") - 1), lambda i: F.element_at(F.array(*map(F.lit, gains)), (draws.below(len(gains), seed, idx, F.concat(F.lit("noise_gain"), i.cast("string"))) + 1).cast("int")))
    out = keys.withColumn("snr", draws.choice(snrs, seed, idx, "snr")).withColumn("gain", draws.choice(gains, seed, idx, "gain"))
    out = out.withColumn("n_noises", (draws.below(4, seed, idx, "n_noises") + 2).cast("int")).withColumn("noise_gains", noise_gains)
    return out.withColumn("interferer_snr", draws.choice(INTERFERER_SNRS, seed, idx, "interferer")).withColumn("has_speech", F.col("snr") > -100)


def assemble_speech(parts: DataFrame, n: int, seed: int) -> DataFrame:
    """idx, speech: the parts of each idx (slot, x) in order until there are n samples, then n of them from a drawn start.

    Parts after the one that meets the target are left out before any samples are gathered.
    """
    before = F.coalesce(F.sum(F.size("x")).over(W.partitionBy("idx").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    used = parts.withColumn("_b", before).where(F.col("_b") < n)
    joined = used.groupBy("idx").agg(F.flatten(F.sort_array(F.collect_list(F.struct("slot", "x")))["x"]).alias("x"))
    return joined.select("idx", S.random_crop("x", F.lit(n), seed, F.col("idx")).alias("speech"))


def combine_noises(noises: DataFrame, n: int | str, seed: int, channels: int = 1) -> DataFrame:
    """idx, noise: each noise (slot, x, gain in dB) fitted to n samples (or to those in a column, the same for all slots of an
    idx), with its gain, summed in the order of the slots and divided by the number of channels (not of noises). A noise that is null or
    empty adds nothing; an idx with no other gets zeros. A null gain is none (0 dB)."""
    length = F.col(n) if isinstance(n, str) else F.lit(n)
    silent = F.array_repeat(F.lit(0.0), length.cast("int"))
    fit = F.when(F.size("x") > 0, S.scaled(S.fit_length("x", length, seed, F.concat_ws("-", "idx", "slot")), S.db_to_gain(F.coalesce(F.col("gain").cast("double"), F.lit(0.0))))).otherwise(silent)
    fitted = noises.withColumn("y", fit)
    rows = fitted.groupBy("idx").agg(F.sort_array(F.collect_list(F.struct("slot", "y")))["y"].alias("ys"))
    zero = F.transform(F.get("ys", F.lit(0)), lambda v: F.lit(0.0))
    return rows.select("idx", F.transform(F.aggregate("ys", zero, S.added), lambda v: v / channels).alias("noise"))


def mix_at_snr(df: DataFrame, clean: str = "speech", noise: str = "noise", snr: str = "snr", gain: str = "gain", distorted: str | None = None) -> DataFrame:
    """df with clean and noise at their levels in the mixture `noisy`, all scaled down alike if one of them exceeds 1."""
    g = S.db_to_gain(F.col(gain))
    out = df.withColumn("_c", S.scaled(clean, g)).withColumn("_k", S.mix_gain("_c", noise, snr)).withColumn("_n", S.scaled(noise, "_k"))
    out = out.withColumn("_m", S.added(S.scaled(distorted, g) if distorted else "_c", "_n"))
    top = F.greatest(S.max_abs("_c"), S.max_abs("_n"), S.max_abs("_m"))
    out = out.withColumn("_f", F.when(top - 1 > 1e-10, 1 / (top + 1e-10)).otherwise(1.0))
    return out.withColumns({clean: S.scaled("_c", "_f"), noise: S.scaled("_n", "_f"), "noisy": S.scaled("_m", "_f")}).drop("_c", "_k", "_n", "_m", "_f")


def add_interferers(df: DataFrame, interferers: DataFrame, seed: int, p: float = 1.0) -> DataFrame:
    """df (idx, speech, interferer_snr) with other voices mixed into speech where the draw is under p. interferers: idx, slot, x,
    gain; each is fitted to the length of the speech."""
    sized = interferers.join(df.select("idx", F.size("speech").alias("_len")), "idx")
    other = combine_noises(sized, "_len", seed).withColumnRenamed("noise", "_o")
    both = df.join(other, "idx", "left").withColumn("_on", F.col("_o").isNotNull() & (draws.uniform(seed, F.col("idx"), "interfere") < p)).withColumn("_zero", F.lit(0))
    safe = both.withColumn("_o", F.coalesce("_o", S.scaled("speech", 0.0)))
    mixed = mix_at_snr(safe.withColumn("_s", F.col("speech")), "_s", "_o", "interferer_snr", "_zero")
    return mixed.withColumn("speech", F.when(F.col("_on"), F.col("noisy")).otherwise(F.col("speech"))).drop("_s", "_o", "_on", "_zero", "noisy")


def zero_run_positions(n, idx, seed: int, max_percent: float = 10.0, low: int = 120, high: int = 1800) -> Column:
    """Positions (from 0, each once) in a clip of n samples that runs of low to high samples cover, drawn until the drawn share (1 to
    max_percent percent) is reached; none without samples.

    Drawn are as many runs as reach the share if all are shortest; one more for rounding.
    """
    n, idx = S.col(n), S.col(idx)
    share = 0.01 + draws.uniform(seed, idx, "share") * (max_percent / 100 - 0.01)
    most = F.ceil(F.lit(max(max_percent / 100, 0.01)) * n / low).cast("int")
    runs = F.transform(F.sequence(F.lit(0), most), lambda i: F.struct(
        draws.below(F.greatest(n - high, F.lit(1)), seed, idx, F.concat(F.lit("at"), i.cast("string"))).cast("int").alias("at"),
        (draws.below(high - low, seed, idx, F.concat(F.lit("n"), i.cast("string"))) + low).cast("int").alias("n")))
    start = F.struct(F.lit(0.0).alias("done"), F.lit(0).alias("k"), share.alias("share"))
    used = lambda v: F.aggregate(v, start, lambda a, z: F.struct(
        F.when(a["done"] < a["share"], a["done"] + z["n"] / n).otherwise(a["done"]).alias("done"),
        F.when(a["done"] < a["share"], a["k"] + 1).otherwise(a["k"]).alias("k"), a["share"].alias("share")), lambda a: F.slice(v, 1, a["k"]))
    # sets of positions, not a search through all runs for each sample; arrays of one element hold what is used twice
    hit = lambda v: F.array_distinct(F.flatten(F.transform(used(v), lambda z: F.sequence(z["at"], F.least(z["at"] + z["n"], n) - 1))))
    return F.when(n > 0, F.transform(F.array(runs), hit)[0]).otherwise(F.array().cast("array<int>"))


def zeroed_at(x, positions) -> Column:
    """Samples with zeros at the positions (from 0, each once)."""
    x, positions = S.col(x), S.col(positions)
    n = F.size(x)
    at = lambda h, value: F.transform(h, lambda i: F.struct(i.alias("i"), value(i).alias("v")))
    kept = lambda h: F.array_except(F.sequence(F.lit(0), n - 1), h)
    joined = lambda h: F.sort_array(F.concat(at(h, lambda i: F.lit(0.0)), at(kept(h), lambda i: F.get(x, i))))["v"]
    return F.when(n > 0, F.transform(F.array(positions), joined)[0]).otherwise(x)


def zero_runs(x, idx, seed: int, max_percent: float = 10.0, low: int = 120, high: int = 1800) -> Column:
    """Runs of low to high samples set to zero until the drawn share (1 to max_percent percent) is reached."""
    return zeroed_at(x, zero_run_positions(F.size(S.col(x)), idx, seed, max_percent, low, high))


def _generator(seed: int, idx, name: str) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}:{idx}:{name}".encode()).digest()[:8], "big"))


def _each_clip(clips: DataFrame, fn: Callable[[dict], np.ndarray], column: str = "x", drop: tuple[str, ...] = ()) -> DataFrame:
    """clips with `column` replaced by fn(row), one clip at a time inside Arrow batches."""
    kept = [f for f in clips.schema.fields if f.name not in drop]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf.drop(columns=list(drop))
            out[column] = [np.asarray(fn(row), float) for row in pdf.to_dict("records")]
            yield out

    return clips.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept))


def random_lfilt(clips: DataFrame, seed: int) -> DataFrame:
    return _each_clip(clips, lambda r: audio.random_lfilt(np.asarray(r["x"], float), _generator(seed, r["idx"], "lfilt")))


def random_biquad(clips: DataFrame, sr: int, seed: int) -> DataFrame:
    return _each_clip(clips, lambda r: audio.random_biquads(np.asarray(r["x"], float), sr, _generator(seed, r["idx"], "biquad")))


def biquad(clips: DataFrame, kind: str, freq: float, q: float, gain_db: float, sr: int) -> DataFrame:
    b, a = audio.biquad_coefficients(kind, freq, q, gain_db, sr)
    return _each_clip(clips, lambda r: audio.biquad_filter(np.asarray(r["x"], float), b, a))


def resample(clips: DataFrame, sr: int, new_sr: int) -> DataFrame:
    return _each_clip(clips, lambda r: audio.resample(np.asarray(r["x"], float), sr, new_sr))


def random_speed(clips: DataFrame, sr: int, seed: int) -> DataFrame:
    """Resampled to 0.9 to 1.1 times sr, rounded to 500 Hz, and read at sr."""
    return _each_clip(clips, lambda r: audio.resample(np.asarray(r["x"], float), sr, int(round(_generator(seed, r["idx"], "speed").uniform(0.9, 1.1) * sr / 500) * 500)))


#: Cut-off frequencies in Hz that a bandwidth limit is drawn from: fixed values.
CUT_OFFS = [4000, 6000, 8000, 10000, 12000, 16000, 20000, 22050]


def limit_bandwidth(clips: DataFrame, sr: int, seed: int) -> DataFrame:
    """Low-passed at a drawn cut-off below the clip's max_freq, which becomes the cut-off's; clips with no cut-off below stay."""
    below = F.filter(F.array(*map(F.lit, CUT_OFFS)), lambda c: c < F.col("max_freq"))
    drawn = clips.withColumn("_f", F.when(F.size(below) > 0, F.get(below, draws.below(F.greatest(F.size(below), F.lit(1)), seed, F.col("idx"), "cut").cast("int"))))
    out = _each_clip(drawn, lambda r: r["x"] if pd.isna(r["_f"]) else audio.low_pass_resample(np.asarray(r["x"], float), int(r["_f"]), sr))
    return out.withColumn("max_freq", F.coalesce("_f", "max_freq")).drop("_f")


def coloured_noise(plan: DataFrame, n: int, sr: int, seed: int, low: float = -2.0, high: float = 2.0) -> DataFrame:
    """plan (idx, ...) with x: n samples of noise of a drawn colour and level."""
    def make(r: dict) -> np.ndarray:
        rng = _generator(seed, r["idx"], "noise")
        return audio.coloured_noise(rng.uniform(low, high), n, sr, rng)[0]

    return _each_clip(plan.withColumn("x", F.array().cast("array<double>")), make)


def reverb(clips: DataFrame, sr: int, drr: float = 0.3, rt60: float = 0.5, offset_ms: int = 20) -> DataFrame:
    """clips (x, rir) with x the target and reverberant the signal for the mixture; rir comes by the draw join."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            both = [audio.reverb(np.asarray(x, float)[None], np.asarray(h, float)[None], sr, drr, rt60, offset_ms) for x, h in zip(pdf["x"], pdf["rir"])]
            yield pdf.drop(columns=["rir"]).assign(x=[b[0][0] for b in both], reverberant=[b[1][0] for b in both])

    kept = [f for f in clips.schema.fields if f.name != "rir"]
    return clips.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", reverberant array<double>")


def clip_to_sdr(clips: DataFrame, target: float) -> DataFrame:
    """Clipped so that the measure of audio.clip_level meets the target; clips that cannot meet it stay."""
    def one(r: dict) -> np.ndarray:
        x = np.asarray(r["x"], float)
        c = audio.clip_level(x, target)
        return x if c is None else np.clip(x, -c, c)

    return _each_clip(clips, one)


def compose(clips: DataFrame, steps: list[tuple[str, float, Callable[[Column, Column], Column]]], seed: int, column: str = "x", failed: str | None = None) -> DataFrame:
    """Steps (name, p, fn(samples, idx) -> samples) in order; a step is left out when its draw for the clip exceeds p (never at
    p >= 1, always at 0) or when it gives null, which stands for a failed step: the clip goes on as it was before. `failed`: a column to be
    added, the names of the steps that were drawn for a clip and failed, in order."""
    out = clips if failed is None else clips.withColumn(failed, F.array().cast("array<string>"))
    for name, p, fn in steps:
        if p <= 0:
            continue
        drawn = F.lit(True) if p >= 1 else draws.uniform(seed, F.col("idx"), name) <= p
        out = out.withColumn("_new", F.when(drawn, fn(F.col(column), F.col("idx"))))
        if failed is not None:
            out = out.withColumn(failed, F.when(drawn & F.col("_new").isNull(), F.array_append(failed, F.lit(name))).otherwise(F.col(failed)))
        out = out.withColumn(column, F.coalesce("_new", column)).drop("_new")
    return out


#: Transforms by name: make(seed, **params) gives fn(samples, idx) -> samples; and the probability they have if none is given.
TRANSFORMS: dict[str, tuple[Callable[..., Callable[[Column, Column], Column]], float]] = {}


def register_transform(name: str, make: Callable[..., Callable[[Column, Column], Column]], p: float = 1.0) -> None:
    TRANSFORMS[name] = make, p


register_transform("gain", lambda seed, db: lambda x, _: S.scaled(x, 10 ** (db / 20)))
register_transform("random_gain", lambda seed, gains=GAINS: lambda x, idx: S.scaled(x, S.db_to_gain(draws.choice(gains, seed, idx, "random_gain").cast("double"))))
register_transform("clip", lambda seed, share: lambda x, _: S.clip_samples(x, share), 0.0)
register_transform("zero_runs", lambda seed, **kw: lambda x, idx: zero_runs(x, idx, seed, **kw), 0.0)
register_transform("crop", lambda seed, n: lambda x, idx: S.random_crop(x, F.lit(n), seed, idx))
register_transform("remove_dc", lambda seed: lambda x, _: S.remove_dc(F.array(x))[0])


def named_steps(config: list[dict], seed: int) -> list[tuple[str, float, Callable[[Column, Column], Column]]]:
    """Steps for compose from a list such as [{"name": "clip", "p": 0.3, "share": 0.5}]; an unknown name is an error."""
    out = []
    for entry in config:
        entry = dict(entry)
        name = entry.pop("name")
        if name not in TRANSFORMS:
            raise ValueError(f"no transform {name}")
        make, p = TRANSFORMS[name]
        p = entry.pop("p", p)
        out.append((name, p, make(seed, **entry)))
    return out
