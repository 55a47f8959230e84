"""Short-time spectra, running normalisation and band shapes."""

from __future__ import annotations

import numpy as np


def window(n: int) -> np.ndarray:
    """Power-complementary window for half overlap."""
    return np.sin(np.pi / 2 * np.sin(np.pi * (np.arange(n) + 0.5) / n) ** 2)


def stft(x: np.ndarray, fft: int, hop: int, aligned: bool = False) -> np.ndarray:
    """Frames (time, bins). A frame holds the last fft - hop samples before it and hop new ones, zeros before the
    start. aligned=True drops the first fft / hop - 1 frames and appends as many of zeros."""
    n = len(x) // hop
    w = window(fft)
    if not n:
        return np.zeros((0, fft // 2 + 1), complex)
    padded = np.concatenate([np.zeros(fft - hop), x[: n * hop]])
    frames = np.lib.stride_tricks.sliding_window_view(padded, fft)[::hop][:n]
    out = np.fft.rfft(frames * w, axis=1) / (fft**2 / (2 * hop))
    if aligned:
        lost = fft // hop - 1
        out = np.concatenate([out[lost:], np.zeros((min(lost, n), out.shape[1]))])
    return out


def centred_stft(x: np.ndarray, fft: int, hop: int) -> np.ndarray:
    """Frames (time, bins) around every hop-th sample, with a Hann window, mirrored ends and unit-energy scaling."""
    padded = np.pad(x, fft // 2, mode="reflect" if len(x) > fft // 2 else "symmetric")
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(fft) / fft)
    return np.fft.rfft(np.lib.stride_tricks.sliding_window_view(padded, fft)[::hop] * w, axis=1) / np.sqrt(fft)


def istft(spec: np.ndarray, fft: int, hop: int) -> np.ndarray:
    """Overlap-add of the unnormalised inverse transforms; time * hop samples, fft - hop late."""
    t = len(spec)
    frames = np.fft.irfft(spec, fft, axis=1) * fft * window(fft) if t else np.zeros((0, fft))
    out = np.zeros(t * hop + fft - hop)
    for i in range(fft // hop):
        part = frames[:, i * hop : (i + 1) * hop].reshape(-1)
        out[i * hop : i * hop + len(part)] += part
    return out[: t * hop]


def ema(x: np.ndarray, start: np.ndarray, alpha: float) -> np.ndarray:
    """s[t] = x[t] * (1 - alpha) + s[t - 1] * alpha along the first axis, from s[-1] = start."""
    out = np.empty_like(x)
    s = start
    for t in range(len(x)):
        s = x[t] * (1 - alpha) + s * alpha
        out[t] = s
    return out


def mean_norm_start(n: int) -> np.ndarray:
    return np.linspace(-60.0, -90.0, n)


def unit_norm_start(n: int) -> np.ndarray:
    return np.linspace(1e-3, 1e-4, n)


def erb_widths(sr: int, fft: int, bands: int, least: int) -> list[int]:
    """Bins of each band, about equal on the ERB scale and at least `least`; what a band takes too much is taken from the
    next ones; the last band holds the Nyquist bin too. They sum to fft / 2 + 1."""
    scale = 24.7 * 9.265
    i = np.arange(1, bands + 1)
    ends = np.rint(scale * np.expm1(np.log1p(sr / 2 / scale) / bands * i) / (sr / fft)).astype(int)
    ends = np.maximum.accumulate(np.maximum(ends, least) - i * least) + i * least
    ends[-1] = min(ends[-1] + 1, fft // 2 + 1)
    return np.diff(ends, prepend=0).tolist()


def norm_alpha(sr: int, hop: int, tau: float) -> float:
    """exp(-hop / sr / tau) rounded to three digits, or as many as keep it below 1."""
    a, digits = float(np.exp(-hop / sr / tau)), 3
    while round(a, digits) >= 1.0:
        digits += 1
    return round(a, digits)


#: Attenuation coefficients per metre (times 1e-3) at the centre bands, by condition: fixed values.
AIR_CENTRES = [125, 250, 500, 1000, 2000, 4000, 8000, 16000, 24000]
AIR = {
    "10C_30-50%": [0.1, 0.2, 0.5, 1.1, 2.7, 9.4, 29.0, 91.5, 289.0],
    "10C_50-70%": [0.1, 0.2, 0.5, 0.8, 1.8, 5.9, 21.1, 76.6, 280.2],
    "10C_70-90%": [0.1, 0.2, 0.5, 0.7, 1.4, 4.4, 15.8, 58.0, 214.9],
    "20C_30-50": [0.1, 0.3, 0.6, 1.0, 1.9, 5.8, 20.3, 72.3, 259.9],
    "20C_50-70%": [0.1, 0.3, 0.6, 1.0, 1.7, 4.1, 13.5, 44.4, 148.7],
    "20C_70-90%": [0.1, 0.3, 0.6, 1.1, 1.7, 3.5, 10.6, 31.2, 93.8],
    "Strong-High-1": [0.1, 0.2, 0.7, 1.5, 3.9, 8.1, 21.6, 80.2, 213.1],
    "Strong-High-2": [0.1, 0.3, 0.9, 3.8, 8.9, 21.1, 44.6, 80.2, 153.1],
}


def air_attenuation(condition: str, distance: float, bins: int, sr: int) -> np.ndarray:
    """Amplitude factor of each bin: exp(-distance * coefficient) at the centres, linear between them, flat below the first."""
    values = np.exp(-distance * np.array(AIR[condition]) * 1e-3)
    return np.interp(np.linspace(0, sr / 2, bins), [0, *AIR_CENTRES], [values[0], *values])
