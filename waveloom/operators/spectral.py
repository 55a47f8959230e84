"""Spectral features and enhancement over frames (clip_id, ch, t, re, im); complex numbers are two aligned arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from waveloom._np import spectra as N
from waveloom.functions import signal as S

from . import chunks

FRAME = "clip_id long, ch int, t long, re array<double>, im array<double>"
_OF_CLIP = ("clip_id", "ch")


def hz_to_erb(c) -> Column:
    return 9.265 * F.log1p(S.col(c) / (24.7 * 9.265))


def erb_to_hz(c) -> Column:
    return 24.7 * 9.265 * (F.exp(S.col(c) / 9.265) - 1)


def power(re="re", im="im") -> Column:
    return F.zip_with(S.col(re), S.col(im), lambda a, b: a * a + b * b)


def magnitude(re="re", im="im") -> Column:
    return F.zip_with(S.col(re), S.col(im), lambda a, b: F.sqrt(a * a + b * b))


def band_means(x, widths: list[int]) -> Column:
    """Mean of each band of an array of bins."""
    out, at = [], 1
    for w in widths:
        out.append(S.total(F.slice(S.col(x), at, w)) / w)
        at += w
    return F.array(*out)


def erb_energy(frames: DataFrame, widths: list[int], db: bool = True) -> DataFrame:
    """frames with erb: the mean power of each band, in dB if asked."""
    e = band_means(power(), widths)
    return frames.withColumn("erb", F.transform(e, S.power_db) if db else e)


def erb_expand(gains, widths: list[int]) -> Column:
    """Band gains repeated over the bins of their bands."""
    g = S.col(gains)
    return F.concat(*[F.array_repeat(F.get(g, F.lit(i)), w) for i, w in enumerate(widths)])


def apply_gains(frames: DataFrame, gains: str = "gains", widths: list[int] | None = None, floor_db: float | None = None) -> DataFrame:
    """re and im times gains (bands if widths are given), which are at least 10^(-floor_db / 20)."""
    g = erb_expand(gains, widths) if widths else F.col(gains)
    if floor_db is not None:
        low = 10 ** (-abs(floor_db) / 20)
        g = F.transform(g, lambda v: F.greatest(v, F.lit(low)))
    out = frames.withColumn("_g", g)
    return out.withColumns({c: F.zip_with(c, "_g", lambda a, b: a * b) for c in ("re", "im")}).drop("_g")


def limit_attenuation(noisy, enhanced, db: float) -> Column:
    """noisy * l + enhanced * (1 - l), l = 10^(-|db| / 20): 100 dB or more changes nothing, under 0.01 dB gives noisy back."""
    db = abs(db)
    if db >= 100:
        return S.col(enhanced)
    if db < 0.01:
        return S.col(noisy)
    k = 10 ** (-db / 20)
    return F.zip_with(S.col(noisy), S.col(enhanced), lambda a, b: a * k + b * (1 - k))


def post_filter(noisy_mag, enhanced_mag, beta: float = 0.02, tail: str = "all", eps: float = 1e-12) -> Column:
    """Factors for the enhanced bins: ((1 + beta) g / (1 + beta (g / (g sin(pi g / 2)))^2)) / g with g the limited ratio of magnitudes.
    tail='skip' leaves the bins after the last whole group of four as they are."""
    def one(n, e):
        g = F.least(F.greatest(e / (n + eps), F.lit(eps)), F.lit(1.0))
        s = g * F.sin(g * math.pi / 2)
        return ((1 + beta) * g / (1 + beta * F.pow(g / s, 2))) / g

    f = F.zip_with(S.col(noisy_mag), S.col(enhanced_mag), one)
    if tail == "all":
        return f
    n = F.size(f)
    return F.transform(f, lambda v, i: F.when(i < n - n % 4, v).otherwise(1.0))


def ideal_mask(clean_re, clean_im, noisy_re, noisy_im, kind: str, gamma: float = 1.0, eps: float = 1e-10) -> Column:
    """'wg' S2 / (S2 + N2), 'irm' S / (S + N) or 'iam' S / X, limited to [0, 1], to the power gamma; N is the complex difference."""
    z = F.arrays_zip(*[S.col(c).alias(n) for c, n in ((clean_re, "a"), (clean_im, "b"), (noisy_re, "c"), (noisy_im, "d"))])

    def one(v):
        s2 = v["a"] * v["a"] + v["b"] * v["b"]
        n2 = (v["c"] - v["a"]) * (v["c"] - v["a"]) + (v["d"] - v["b"]) * (v["d"] - v["b"])
        x2 = v["c"] * v["c"] + v["d"] * v["d"]
        m = {"wg": s2 / (s2 + n2 + eps), "irm": F.sqrt(s2) / (F.sqrt(s2) + F.sqrt(n2) + eps), "iam": F.sqrt(s2) / (F.sqrt(x2) + eps)}[kind]
        m = F.least(F.greatest(m, F.lit(0.0)), F.lit(1.0))
        return m if gamma == 1.0 else F.pow(m, gamma)

    return F.transform(z, one)


def spectrogram_db(re="re", im="im") -> Column:
    return F.transform(power(re, im), lambda p: 10 * F.log10(F.greatest(p, F.lit(1e-10))))


def ema_mean_norm(frames: DataFrame, alpha: float, column: str = "erb", out: str = "erb_norm") -> DataFrame:
    """(x - s) / 40 with s the running mean of each band, from -60 to -90 at the start. Scanned in chunks of frames."""
    rows = _scanned(frames, column, N.mean_norm_start, alpha)
    return rows.withColumn(out, F.zip_with(column, "_mean", lambda x, s: (x - s) / 40)).drop("_mean")


def ema_unit_norm(frames: DataFrame, alpha: float, nb_df: int | None = None) -> DataFrame:
    """re and im (the first nb_df bins if given) over the root of the running mean of the magnitude."""
    first = frames if nb_df is None else frames.withColumns({c: F.slice(c, 1, nb_df) for c in ("re", "im")})
    s = _scanned(first.withColumn("_m", magnitude()), "_m", N.unit_norm_start, alpha)
    return s.withColumns({c: F.zip_with(c, "_mean", lambda a, b: a / F.sqrt(b)) for c in ("re", "im")}).drop("_m", "_mean")


def ema_mag_norm(frames: DataFrame, alpha: float) -> DataFrame:
    """frames with mag_norm: the magnitude less its running mean."""
    s = _scanned(frames.withColumn("_m", magnitude()), "_m", N.mean_norm_start, alpha)
    return s.withColumn("mag_norm", F.zip_with("_m", "_mean", lambda x, m: x - m)).drop("_m", "_mean")


def _scanned(frames: DataFrame, column: str, start, alpha: float) -> DataFrame:
    """frames with _mean, the running mean of an array column whose width is that of any row."""
    any_row = frames.select(F.size(column)).first()
    return chunks.ema(frames, {column: ("_mean", start(any_row[0] if any_row else 0).tolist())}, alpha)


def _local_energy(ws: int, energy: str, w_: W) -> Column:
    ws += 1 - ws % 2
    h = ws // 2
    w = [0.5 * (1 - math.cos(2 * math.pi * i / ws)) for i in range(ws)]
    out = F.lit(0.0)
    for k in range(-h, h + 1):
        out = out + w[k + h] * F.coalesce((F.lead if k >= 0 else F.lag)(energy, abs(k)).over(w_), F.lit(0.0))
    return out / ws


def local_snr_window(ms: float, sr: int, fft: int, hop: int) -> int:
    return max(1, round(1 + (ms - fft / sr * 1000) / (hop / sr * 1000)))


def local_snr(clean: DataFrame, noise: DataFrame, ws: int, ws_noise: int | None = None, low: float = -15.0, high: float = 35.0) -> DataFrame:
    """clip_id, ch, t, lsnr: dB ratio of Hann-weighted local energies, limited to [low - 1, high + 1]."""
    e = lambda d, n: d.select(*_OF_CLIP, "t", S.total(power()).alias(n))
    reach = (max(ws, ws_noise or 2 * ws) + 1) // 2
    both, w = chunks.overlapping(e(clean, "_s").join(e(noise, "_n"), [*_OF_CLIP, "t"]), reach, reach)
    snr = _local_energy(ws, "_s", w) / F.greatest(_local_energy(ws_noise or 2 * ws, "_n", w), F.lit(1e-12))
    db = 10 * F.log10(F.greatest(snr, F.lit(1e-12)))
    return chunks.own(both.withColumn("lsnr", F.least(F.greatest(db, F.lit(low - 1)), F.lit(high + 1)))).select(*_OF_CLIP, "t", "lsnr")


def unfold_frames(frames: DataFrame, order: int, lookahead: int = 0) -> DataFrame:
    """frames with re_n and im_n: `order` frames up to `lookahead` ahead of each, the oldest first, zeros outside the clip.
    Chunks of frames are worked on apart, with the frames they need lent from their neighbours."""
    rows, w = chunks.overlapping(frames, max(order - 1 - lookahead, 0), max(lookahead, 0))
    zeros = F.transform("re", lambda v: v * 0.0)
    step = [order - 1 - lookahead - o for o in range(order)]
    at = lambda c, k: F.coalesce((F.lag(c, k) if k >= 0 else F.lead(c, -k)).over(w), zeros)
    return chunks.own(rows.withColumns({f"{c}_n": F.array(*[at(c, k) for k in step]) for c in ("re", "im")}))


def deep_filter(frames: DataFrame, coefs: DataFrame, order: int, lookahead: int = 0, nb_df: int | None = None, alpha: float | None = None) -> DataFrame:
    """Y[t, f] = sum over o of X[t - (order - 1 - lookahead) + o, f] * C[t, o, f] for the first nb_df bins; others stay.

    coefs: clip_id, ch, t, c_re, c_im, arrays of `order` arrays of bins. alpha blends: alpha * Y + (1 - alpha) * X.
    """
    u = unfold_frames(frames, order, lookahead).join(coefs, [*_OF_CLIP, "t"])

    def part(real: bool) -> Column:
        zero = F.transform("re", lambda v: v * 0.0)
        total = zero
        for o in range(order):
            z = F.arrays_zip(*[F.get(c, F.lit(o)).alias(n) for c, n in (("re_n", "a"), ("im_n", "b"), ("c_re", "c"), ("c_im", "d"))])
            prod = F.transform(z, (lambda v: v["a"] * v["c"] - v["b"] * v["d"]) if real else (lambda v: v["a"] * v["d"] + v["b"] * v["c"]))
            total = F.zip_with(total, prod, lambda x, y: x + y)
        x = F.col("re" if real else "im")
        n = F.size(x) if nb_df is None else F.lit(nb_df)
        y = total if alpha is None else F.zip_with(total, x, lambda a, b: alpha * a + (1 - alpha) * b)
        return F.transform(x, lambda v, i: F.when(i < n, F.get(y, i)).otherwise(v))

    return u.withColumns({"_y": part(True), "_z": part(False)}).select(*_OF_CLIP, "t", F.col("_y").alias("re"), F.col("_z").alias("im"))


def frame_corr(frames: DataFrame, n: int) -> DataFrame:
    """clip_id, ch, t, i, j, r_re, r_im: x_i * conj(x_j) of the last n frames, an array of bins for each pair of frames."""
    u = unfold_frames(frames, n)
    ij = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(n) for j in range(n)])
    rows = u.select(*_OF_CLIP, "t", "re_n", "im_n", F.explode(ij).alias("k"))
    z = F.arrays_zip(*[F.get(c, F.col("k")[w]).alias(m) for c, w, m in (("re_n", "i", "a"), ("im_n", "i", "b"), ("re_n", "j", "c"), ("im_n", "j", "d"))])
    return rows.select(*_OF_CLIP, "t", "k.i", "k.j", F.transform(z, lambda v: v["a"] * v["c"] + v["b"] * v["d"]).alias("r_re"), F.transform(z, lambda v: v["b"] * v["c"] - v["a"] * v["d"]).alias("r_im"))


def stft(clips: DataFrame, fft: int, hop: int, aligned: bool = False) -> DataFrame:
    """Frames of clips (clip_id, x; one channel)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for clip, x in zip(pdf["clip_id"], pdf["x"]):
                s = N.stft(np.asarray(x, float), fft, hop, aligned)
                if len(s):
                    yield pd.DataFrame({"clip_id": clip, "ch": 0, "t": np.arange(len(s)), "re": list(s.real), "im": list(s.imag)})

    return clips.select("clip_id", "x").mapInPandas(run, FRAME)


def istft(frames: DataFrame, fft: int, hop: int) -> DataFrame:
    """clip_id, ch, x of frames; the frames of one clip are one group."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        x = N.istft(np.stack(pdf["re"].to_list()) + 1j * np.stack(pdf["im"].to_list()), fft, hop)
        return pd.DataFrame({"clip_id": [pdf["clip_id"].iloc[0]], "ch": [pdf["ch"].iloc[0]], "x": [x]})

    return frames.groupBy(*_OF_CLIP).applyInPandas(run, "clip_id long, ch int, x array<double>")


def features(clips: DataFrame, fft: int, hop: int, widths: list[int], nb_df: int, alpha: float) -> DataFrame:
    """clip_id, ch, t, feat_erb (normalised band levels), re and im (normalised first bins): one pass over clip rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = np.concatenate([[0], np.cumsum(widths)[:-1]])
        for pdf in batches:
            for clip, x in zip(pdf["clip_id"], pdf["x"]):
                s = N.stft(np.asarray(x, float), fft, hop)
                if not len(s):
                    continue
                erb = 10 * np.log10(np.add.reduceat(np.abs(s) ** 2, edges, axis=1) / np.array(widths) + 1e-10)
                erb = (erb - N.ema(erb, N.mean_norm_start(len(widths)), alpha)) / 40
                z = s[:, :nb_df]
                z = z / np.sqrt(N.ema(np.abs(z), N.unit_norm_start(z.shape[1]), alpha))
                yield pd.DataFrame({"clip_id": clip, "ch": 0, "t": np.arange(len(s)), "feat_erb": list(erb), "re": list(z.real), "im": list(z.imag)})

    return clips.select("clip_id", "x").mapInPandas(run, "clip_id long, ch int, t long, feat_erb array<double>, re array<double>, im array<double>")


#: Upper edges in Hz of the bands in which bandwidth is sought: fixed values.
BANDWIDTH_EDGES = [8000, 10000, 12000, 16000, 18000, 20000, 22000, 24000]


def _band_of(bins: int, sr: int) -> list[int]:
    return [next((b for b, e in enumerate(BANDWIDTH_EDGES) if k * (sr / 2) / (bins - 1) <= e), len(BANDWIDTH_EDGES) - 1) for k in range(bins)]


def estimate_bandwidth(frames: DataFrame, bins: int, sr: int = 48000, cut_db: float = -120.0, window: int = 200) -> DataFrame:
    """clip_id, max_bin: the upper median over windows of frames of the last bin under the first band that stays below cut_db."""
    cut_db = -abs(cut_db)
    band = _band_of(bins, sr)
    last = [max(k for k in range(bins) if band[k] == b) for b in sorted(set(band))]
    level = frames.select("clip_id", "t", F.transform(magnitude(), lambda m: 20 * F.log10(m + 1e-16)).alias("db"))
    each = level.groupBy("clip_id", "t").agg(F.array(*[F.avg(F.get("db", F.lit(k))) for k in range(bins)]).alias("db"))  # mean over channels
    means = [S.total(F.array(*[F.get("db", F.lit(k)) for k in range(bins) if band[k] == b])) / band.count(b) for b in sorted(set(band))]
    tops = each.groupBy("clip_id", F.floor(F.col("t") / window).alias("w")).agg(F.array(*[F.max(m) for m in means]).alias("m"))
    first = F.array_position(F.transform(F.slice("m", 2, len(last) - 1), lambda v: v < cut_db), True)
    at = F.when(first > 0, first - 1).otherwise(len(last) - 1)
    found = tops.select("clip_id", F.get(F.array(*map(F.lit, last)), at.cast("int")).alias("b"))
    counts = found.groupBy("clip_id", "b").agg(F.count(F.lit(1)).alias("n"))  # a row for each band at most
    order = W.partitionBy("clip_id")
    upto, n = F.sum("n").over(order.orderBy("b")), F.sum("n").over(order)
    return counts.withColumn("_at", upto > F.floor(n / 2)).where("_at").groupBy("clip_id").agg(F.min("b").alias("max_bin"))


def extension_map(bins: int, cut_bin: int, sr: int, overlap: int = 0) -> list[int]:
    """Which bin each bin is copied from when the spectrum above cut_bin is filled from below."""
    source = list(range(bins))
    if bins - cut_bin <= 1:
        return source
    cut = cut_bin - overlap
    step = sr // ((bins - 1) * 2)
    low = 4000 // step if cut > 4000 // step else 3000 // step
    size, missing = cut - low, bins - cut
    start = max(low, cut - missing)
    if size <= 0:
        return source
    for k in range(missing):
        source[cut + k] = start + k % size
    return source


def extend_bandwidth(frames: DataFrame, bins: int, cut_bin: int, sr: int, overlap: int = 0) -> DataFrame:
    """frames with the bins above cut_bin copied from lower ones (from 4 kHz on, or 3 kHz where the cut is lower)."""
    m = F.array(*map(F.lit, extension_map(bins, cut_bin, sr, overlap)))
    moved = lambda c: F.transform(m, lambda k: F.get(F.col(c), k))
    return frames.withColumns({c: moved(c) for c in ("re", "im")})


def enhance(frames: DataFrame, gains: DataFrame, widths: list[int] | None = None, beta: float | None = None, atten_db: float | None = None) -> DataFrame:
    """Masked frames: gains (clip_id, ch, t, gains), then the post-filter if beta is given, then the attenuation limit."""
    both = frames.join(gains, [*_OF_CLIP, "t"])
    noisy = both.withColumns({"_a": F.col("re"), "_b": F.col("im")})
    out = apply_gains(noisy, "gains", widths)
    if beta is not None:
        out = out.withColumn("_p", post_filter(magnitude("_a", "_b"), magnitude(), beta)).withColumns({c: F.zip_with(c, "_p", lambda a, b: a * b) for c in ("re", "im")})
    if atten_db is not None:
        out = out.withColumns({"re": limit_attenuation("_a", "re", atten_db), "im": limit_attenuation("_b", "im", atten_db)})
    return out.select(*_OF_CLIP, "t", "re", "im")


def reduce_mask(gains: DataFrame, how: str = "max") -> DataFrame:
    """gains with those of all channels of a frame replaced by their largest or mean."""
    bins = gains.select("clip_id", "t", F.posexplode("gains").alias("f", "g"))
    one = bins.groupBy("clip_id", "t", "f").agg((F.max if how == "max" else F.avg)("g").alias("g"))
    one = one.groupBy("clip_id", "t").agg(F.sort_array(F.collect_list(F.struct("f", "g")))["g"].alias("gains"))
    return gains.drop("gains").join(one, ["clip_id", "t"])


def air_absorption(frames: DataFrame, bins: int, sr: int, condition: str, distance: float) -> DataFrame:
    a = F.array(*[F.lit(float(v)) for v in N.air_attenuation(condition, distance, bins, sr)])
    return frames.withColumns({c: F.zip_with(c, a, lambda x, y: x * y) for c in ("re", "im")})


def spectral_distance(a, b, gamma: float = 1.0, under: float = 1.0) -> Column:
    """Mean over bins of the squared difference of compressed magnitudes, times `under` where b is less than a (the target)."""
    c = (lambda v: v) if gamma == 1.0 else (lambda v: F.pow(F.greatest(v, F.lit(1e-12)), gamma))
    d = F.zip_with(S.col(a), S.col(b), lambda x, y: F.pow(c(y) - c(x), 2) * F.when(c(y) < c(x), under).otherwise(1.0))
    return S.mean(d)


def spectrum_distance(re, im, target_re, target_im, gamma: float = 1.0, magnitudes: float = 1.0, numbers: float = 1.0, under: float = 1.0) -> Column:
    """magnitudes * spectral_distance of the compressed magnitudes + numbers * mean squared difference of the real and
    imaginary parts, whose magnitudes are compressed as well."""
    a, b = magnitude(re, im), magnitude(target_re, target_im)
    out = magnitudes * spectral_distance(b, a, gamma, under)
    if numbers:
        def part(x, m):
            return S.col(x) if gamma == 1.0 else F.zip_with(S.col(x), m, lambda v, k: F.when(k > 0, v / k).otherwise(0.0) * F.pow(F.greatest(k, F.lit(1e-12)), gamma))

        d = [S.mean(F.zip_with(part(x, a), part(y, b), lambda u, v: (u - v) * (u - v))) for x, y in ((re, target_re), (im, target_im))]
        out = out + numbers * (d[0] + d[1]) / 2
    return out


def masked_distance(noisy: DataFrame, gains: DataFrame, clean: DataFrame, **kw) -> DataFrame:
    """clip_id, ch, t, distance: noisy frames with the gains on, against clean frames. Parameters as spectrum_distance."""
    c = clean.select(*_OF_CLIP, "t", F.col("re").alias("_cr"), F.col("im").alias("_ci"))
    both = enhance(noisy, gains).join(c, [*_OF_CLIP, "t"])
    return both.select(*_OF_CLIP, "t", spectrum_distance("re", "im", "_cr", "_ci", **kw).alias("distance"))


def multires_distance(pairs: DataFrame, ffts: list[int], gamma: float = 1.0, magnitudes: float = 1.0, numbers: float = 0.0) -> DataFrame:
    """filename, distance: over transforms of several sizes (hop a quarter of each), the sum of the mean squared differences
    of the compressed magnitudes of `enhanced` and `clean`, and of their complex numbers if asked. Cut to the shorter."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for x, y in zip(pdf["enhanced"], pdf["clean"]):
                n, total = min(len(x), len(y)), 0.0
                for fft in ffts if n else ():
                    a, b = (N.centred_stft(np.asarray(v[:n], float), fft, fft // 4) for v in (x, y))
                    p, q = (np.abs(v) if gamma == 1.0 else np.maximum(np.abs(v), 1e-12) ** gamma for v in (a, b))
                    total += magnitudes * ((p - q) ** 2).mean()
                    if numbers:
                        a, b = (m * np.exp(1j * np.angle(v)) for m, v in ((p, a), (q, b)))
                        total += numbers * (np.abs(a - b) ** 2).mean() / 2
                out.append(total if n else None)
            yield pd.DataFrame({"filename": pdf["filename"], "distance": pd.Series(out, dtype=float)})

    kind = pairs.schema["filename"].dataType.simpleString()
    return pairs.select("filename", "enhanced", "clean").mapInPandas(run, f"filename {kind}, distance double")


def mask_distance(predicted, target, gamma: float = 0.6, under: float = 2.0, powers: tuple = (2, 4), factors: tuple = (1.0, 10.0), max_bin: int | None = None) -> Column:
    """Sum over powers of factor * mean(d^(power / 2)), d the squared difference of the compressed gains, times `under`
    where the prediction is less."""
    p, t = S.col(predicted), S.col(target)
    if max_bin is not None:
        p, t = F.slice(p, 1, max_bin), F.slice(t, 1, max_bin)
    g = lambda v: F.pow(F.greatest(v, F.lit(1e-12)), gamma)
    out = F.lit(0.0)
    for n, f in zip(powers, factors):
        d = F.zip_with(p, t, lambda a, b: F.pow(F.pow(g(a) - g(b), 2) * F.when(g(a) < g(b), under).otherwise(1.0), n / 2))
        out = out + f * S.mean(d)
    return out


def lsnr_error(predicted, target) -> Column:
    """Mean squared error of local SNRs; an aggregate."""
    return F.avg(F.pow(S.col(predicted) - S.col(target), 2))
