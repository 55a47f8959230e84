"""Column functions over sample arrays. All are built-in expressions; null arrays give null."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import draws

EPS = 1e-10


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def total(x) -> Column:
    """Sum in index order."""
    return F.aggregate(col(x), F.lit(0.0), lambda a, v: a + v)


def mean(x) -> Column:
    return F.when(F.size(col(x)) > 0, total(x) / F.size(col(x)))


def energy(x) -> Column:
    return F.aggregate(col(x), F.lit(0.0), lambda a, v: a + v * v)


def dot(x, y) -> Column:
    return total(F.zip_with(col(x), col(y), lambda a, b: a * b))


def rms(x) -> Column:
    return F.when(F.size(col(x)) > 0, F.sqrt(energy(x) / F.size(col(x))))


def max_abs(x) -> Column:
    return F.array_max(F.transform(col(x), F.abs))


def once(k, use) -> Column:
    """use(k) with k computed once a row: an expression that Spark moves into a function over samples is computed for each of them."""
    return F.get(F.transform(F.array(col(k)), use), F.lit(0))


def scaled(x, k) -> Column:
    if isinstance(k, (int, float)):
        return F.transform(col(x), lambda v: v * k)
    return once(k, lambda g: F.transform(col(x), lambda v: v * g))


def added(x, y) -> Column:
    return F.zip_with(col(x), col(y), lambda a, b: a + b)


def pcm_to_float(x, base: int = 32767) -> Column:
    """16-bit samples to [-1, 1]."""
    return F.transform(col(x), lambda v: v.cast("double") / base)


def float_to_pcm(x, base: int = 32767) -> Column:
    """Samples to 16 bits, cut towards zero; what is out of range is set to its edge."""
    return F.transform(col(x), lambda v: F.least(F.greatest(v * base, F.lit(-32768.0)), F.lit(32767.0)).cast("int"))


def channel(x, index) -> Column:
    """One channel of a channel-first array."""
    return F.get(col(x), col(index))


def random_channel(x, seed, idx) -> Column:
    return F.get(col(x), draws.below(F.size(col(x)), seed, idx, "channel").cast("int"))


def mono_mix(x) -> Column:
    """The mean over the channels of a channel-first array."""
    x = col(x)
    first = F.transform(F.get(x, F.lit(0)), lambda v: v * 0.0)
    return F.transform(F.aggregate(x, first, added), lambda v: v / F.size(x))


def slice_range(x, start, stop) -> Column:
    """Samples start to stop (exclusive); an error where stop is past the end."""
    x, start, stop = col(x), col(start), col(stop)
    good = F.slice(x, start + 1, stop - start)
    return F.when(stop <= F.size(x), good).otherwise(F.raise_error(F.lit("range past the end of a clip")).cast("array<double>"))


def random_crop(x, n, seed, idx) -> Column:
    """At most n samples from a start drawn from [0, length - n)."""
    x, n = col(x), col(n)
    return F.when(F.size(x) > n, F.slice(x, (draws.below(F.size(x) - n, seed, idx, "crop") + 1).cast("int"), n)).otherwise(x)


def fit_length(x, n, seed=None, idx=None) -> Column:
    """Repeated until there are n samples, then cut to n from a drawn start (from 0 without a seed)."""
    x, n = col(x), col(n)
    times = F.ceil(n / F.greatest(F.size(x), F.lit(1))).cast("int")
    long = F.flatten(F.array_repeat(x, times))
    room = F.size(long) - n
    start = F.lit(0) if seed is None else F.when(room > 0, draws.below(F.greatest(room, F.lit(1)), seed, idx, "fit")).otherwise(0)
    return F.slice(long, (start + 1).cast("int"), n)


def pad_to(x, n) -> Column:
    """Zeros at the end up to n samples; longer arrays stay."""
    x, n = col(x), col(n)
    return F.concat(x, F.array_repeat(F.lit(0.0), F.greatest(n - F.size(x), F.lit(0))))


def undelay(x, fft: int, hop: int, n) -> Column:
    """The n samples from the delay fft - hop on, of the signal padded by fft zeros."""
    return F.slice(F.concat(col(x), F.array_repeat(F.lit(0.0), fft)), F.lit(fft - hop + 1), col(n))


def rms_normalize(x) -> Column:
    """x / (rms + 1e-8)."""
    k = rms(x) + 1e-8
    return F.transform(col(x), lambda v: v / k)


def remove_dc(channels) -> Column:
    """A channel-first array less the mean over all channels and samples."""
    m = mean(F.flatten(col(channels)))
    return F.transform(col(channels), lambda c: F.transform(c, lambda v: v - m))


def clip_samples(x, c) -> Column:
    """Clipped at c times the largest absolute value."""
    x = col(x)
    edge = max_abs(x) * col(c)
    return F.transform(x, lambda v: F.least(F.greatest(v, -edge), edge))


def db_to_gain(c) -> Column:
    return F.pow(F.lit(10.0), col(c) / 20)


def power_db(c) -> Column:
    return 10 * F.log10(col(c) + EPS)


def amp_db(c, eps: float = EPS) -> Column:
    return 20 * F.log10(col(c) + eps)


def argmax(x) -> Column:
    """Index of the first largest sample."""
    x = col(x)
    return F.when(F.size(x) > 0, F.array_position(x, F.array_max(x)) - 1)


def argmax_abs(x, signed: bool = False) -> Column:
    """Index of the first sample with the largest absolute value; signed=True compares samples as they are."""
    return argmax(x if signed else F.transform(col(x), F.abs))


def median_upper(x) -> Column:
    """Element n // 2 of the sorted samples, without interpolation."""
    return F.get(F.sort_array(col(x)), F.floor(F.size(col(x)) / 2).cast("int"))


def is_finite(x) -> Column:
    return ~F.exists(col(x), lambda v: F.isnan(v) | (F.abs(v) == float("inf")))


def frames(x, window: int, hop: int, pad: int = 0) -> Column:
    """Array of full windows: floor((n - window + hop) / hop) of them, after `pad` zeros on both sides."""
    x = col(x)
    if pad:
        z = F.array_repeat(F.lit(0.0), pad)
        x = F.concat(z, x, z)
    n = F.floor((F.size(x) - window + hop) / hop).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(x, i * hop + 1, F.lit(window)))).otherwise(F.array().cast("array<array<double>>"))


def windowed_energy(channels, sr: int) -> Column:
    """Per window of sr / 10 samples (hop sr / 20, half a window of zeros around): 20 * mean(log10((x / max)^2 + 1e-10)),
    averaged over the channels of a channel-first array. max is the largest sample, not the largest absolute one. Where that is 0, as in
    silence, every window has -200 dB; a channel without samples has one window of zeros; no channels give null."""
    channels = col(channels)
    top = F.array_max(F.flatten(channels))
    ws, hop = sr // 10, sr // 20

    def one(c):
        return F.transform(frames(c, ws, hop, ws // 2), lambda w: 20 * total(F.transform(w, lambda v: F.log10(F.pow(F.coalesce(F.try_divide(v, top), F.lit(0.0)), 2) + EPS))) / ws)

    each = F.transform(channels, one)
    first = F.transform(F.get(each, F.lit(0)), lambda v: v * 0.0)
    return F.transform(F.aggregate(each, first, added), lambda v: F.try_divide(v, F.size(channels)))


def segments(x, sr: int, seconds: float = 9.01) -> Column:
    """Windows of 9.01 s with a hop of 1 s; a short clip is doubled until it is long enough."""
    n = int(seconds * sr)
    x = col(x)
    doublings = F.greatest(F.ceil(F.log2(F.lit(float(n)) / F.size(x))), F.lit(0)).cast("int")
    long = F.when(F.size(x) > 0, F.flatten(F.array_repeat(x, F.pow(F.lit(2.0), doublings).cast("int")))).otherwise(x)
    hops = (F.floor(F.size(long) / sr) - seconds).cast("int") + 1  # cast cuts towards zero
    starts = F.when(hops > 0, F.sequence(F.lit(0), hops - 1)).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda i: F.slice(long, i * sr + 1, F.lit(n))), lambda w: F.size(w) == n)


def mix_gain(clean, noise, snr) -> Column:
    """Factor for the noise that gives the asked signal-to-noise ratio in dB."""
    return 1 / F.sqrt((energy(noise) + EPS) / (energy(clean) + EPS) * F.pow(F.lit(10.0), col(snr) / 10) + EPS)


def si_sdr(reference, estimate, eps: float = 2.220446049250313e-16) -> Column:
    """Scale-invariant signal-to-distortion ratio in dB."""
    r, e = col(reference), col(estimate)
    a = (dot(r, e) + eps) / (energy(r) + eps)
    noise = F.aggregate(F.zip_with(r, e, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), F.lit(0.0), lambda s, z: s + (z["y"] - a * z["x"]) * (z["y"] - a * z["x"]))
    return 10 * F.log10((a * a * energy(r) + eps) / (noise + eps))


def segment_snr(clean, degraded, fs: int, frame_ms: int = 30, low: float = -10.0, high: float = 35.0) -> Column:
    """Mean over frames (Hann window, three quarters overlap, the last frame left out) of the limited SNR in dB."""
    ws = round(frame_ms * fs / 1000)
    hop = ws // 4
    hann = F.array(*[F.lit(0.5 * (1 - math.cos(2 * math.pi * (i + 1) / (ws + 1)))) for i in range(ws)])
    n = F.floor(F.size(col(clean)) / hop - ws / hop).cast("int")

    def one(i):
        c = F.zip_with(F.slice(col(clean), i * hop + 1, F.lit(ws)), hann, lambda a, w: a * w)
        d = F.zip_with(F.slice(col(degraded), i * hop + 1, F.lit(ws)), hann, lambda a, w: a * w)
        noise = energy(F.zip_with(c, d, lambda a, b: a - b))
        return F.least(F.greatest(10 * F.log10(energy(c) / (noise + 2.220446049250313e-16) + 2.220446049250313e-16), F.lit(low)), F.lit(high))

    return F.when(n > 0, mean(F.transform(F.sequence(F.lit(0), n - 1), one)))


def clip_sdr(clean, clipped) -> Column:
    """20 * log10 of the ratio of energies of a signal and of what clipping took from it."""
    lost = energy(F.zip_with(col(clean), col(clipped), lambda a, b: a - b))
    return 20 * F.log10(energy(clean) / (lost + EPS) + EPS)
