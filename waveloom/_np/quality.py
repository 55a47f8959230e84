"""Objective quality of one clean and one degraded signal, and multi-frame filters."""

from __future__ import annotations

import contextlib
import functools

import numpy as np

from . import audio

EPS = np.finfo(float).eps
#: Critical bandwidths in Hz; each centre is the one before plus its bandwidth, from 50 Hz. Fixed values.
BANDWIDTHS = [70.0, 70.0, 70.0, 70.0, 70.0, 70.0, 70.0, 77.3724, 86.0056, 95.3398, 105.411, 116.256, 127.914, 140.423, 153.823, 168.154, 183.457, 199.776, 217.153, 235.631, 255.255, 276.072, 298.126, 321.465, 346.136]


_KEPT: dict | None = None


@contextlib.contextmanager
def shared():
    """Inside, what measures derive from one signal alone is computed once for all of them. Signals must stay as they are."""
    global _KEPT
    before, _KEPT = _KEPT, {}
    try:
        yield
    finally:
        _KEPT = before


def _of_signal(fn):
    """A function of a signal and plain values whose results `shared` keeps; the signal is kept beside them, so that its id stays its own."""
    @functools.wraps(fn)
    def found(x: np.ndarray, *args):
        if _KEPT is None:
            return fn(x, *args)
        k = (fn, id(x), args)
        if k not in _KEPT:
            _KEPT[k] = x, fn(x, *args)
        return _KEPT[k][1]

    return found


@functools.lru_cache(16)
def hann(n: int) -> np.ndarray:
    """Hann window without its zero ends."""
    return 0.5 * (1 - np.cos(2 * np.pi * np.arange(1, n + 1) / (n + 1)))


def _shape(fs: int, frame: float = 0.03, overlap: float = 0.75) -> tuple[int, int]:
    return round(frame * fs), int((1 - overlap) * frame * fs)


def frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    n = (len(x) - (size - hop)) // hop
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop][:n] if n > 0 else np.zeros((0, size))


@functools.lru_cache(16)
def critical_filters(fs: int, bins: int) -> np.ndarray:
    """Gaussian-like filters (bands, bins) of the critical bands, without what is under -30 dB."""
    width = np.array(BANDWIDTHS)
    centre = 50 + np.concatenate([[0], np.cumsum(width)[:-1]])
    k = np.arange(bins)
    at = np.floor(centre / (fs / 2) * bins)[:, None]
    f = np.exp(-11 * ((k - at) / (width / (fs / 2) * bins)[:, None]) ** 2 + np.log(width[0] / width)[:, None])
    return f * (f > np.exp(-30 / (2 * 2.303)))


@_of_signal
def _lifted_spectra(x: np.ndarray, fs: int) -> np.ndarray:
    return _spectra(np.asarray(x, float) + EPS, fs)


def _spectra(x: np.ndarray, fs: int) -> np.ndarray:
    """Magnitudes (frames, bins) without the Nyquist bin."""
    size, hop = _shape(fs)
    fft = 1 << int(np.ceil(np.log2(2 * size)))
    n = int(len(x) / hop - size / hop)
    f = frames(x[: n * hop + size - hop], size, hop)
    return np.abs(np.fft.rfft(f * hann(size), fft, axis=1))[:, :-1]


@_of_signal
def _band_shares(x: np.ndarray, fs: int) -> np.ndarray:
    s = _lifted_spectra(x, fs)
    return s / s.sum(axis=1, keepdims=True) @ critical_filters(fs, s.shape[1]).T


def fw_segmental_snr(clean: np.ndarray, degraded: np.ndarray, fs: int, gamma: float = 0.2) -> float:
    """Frequency-weighted segmental SNR over the critical bands, limited to [-10, 35]."""
    c, d = (_band_shares(x, fs) for x in (clean, degraded))
    if not len(c):
        return float("nan")
    weight = c**gamma
    snr = 10 * np.log10(c**2 / np.maximum((c - d) ** 2, EPS))
    return float(np.clip((weight * snr).sum(axis=1) / weight.sum(axis=1), -10, 35).mean())


def _autocorrelation(f: np.ndarray, order: int) -> np.ndarray:
    return np.stack([np.einsum("ij,ij->i", f[:, : f.shape[1] - k], f[:, k:]) for k in range(order + 1)], axis=1)


def _toeplitz(r: np.ndarray) -> np.ndarray:
    n = r.shape[1]
    return r[:, np.abs(np.arange(n)[:, None] - np.arange(n))]


def _predictor(r: np.ndarray) -> np.ndarray:
    """[1, -a] of the linear predictor for each row of autocorrelations; a silent frame gives [1, 0, ...]."""
    p = r.shape[1] - 1
    m = _toeplitz(r[:, :p])
    quiet = r[:, 0] <= EPS
    m[quiet] = np.eye(p)
    m = m + 1e-12 * r[:, :1, None] * np.eye(p)
    a = np.linalg.solve(m, r[:, 1:, None])[:, :, 0]
    a[quiet] = 0
    return np.concatenate([np.ones((len(r), 1)), -a], axis=1)


@_of_signal
def _predicted(x: np.ndarray, fs: int) -> tuple[np.ndarray, np.ndarray]:
    """Autocorrelations of the frames and their predictors."""
    size, hop = _shape(fs)
    r = _autocorrelation(frames(np.asarray(x, float), size, hop)[:-1] * hann(size), 10 if fs < 10000 else 16)
    return r, _predictor(r)


def _lowest(d: np.ndarray, share: float = 0.95) -> float:
    d = np.sort(d)[: int(round(len(d) * share))]
    return float(d.mean()) if len(d) else float("nan")


def llr(clean: np.ndarray, degraded: np.ndarray, fs: int) -> float:
    """Log-likelihood ratio of linear predictors (order 16, or 10 under 10 kHz), without the worst twentieth of the frames."""
    (r, own), (_, other) = (_predicted(x, fs) for x in (clean, degraded))
    if not len(r):
        return float("nan")
    m = _toeplitz(r)
    form = lambda a: np.einsum("fi,fij,fj->f", a, m, a)
    ratio = form(other) / (form(own) + EPS)
    return _lowest(np.log(np.where(ratio > 0, ratio, 1000)))


def _local_peaks(slope: np.ndarray, energy: np.ndarray) -> np.ndarray:
    """For each band the energy at the peak its slope leads to: up along rising slopes, or back along falling ones."""
    n = slope.shape[1]
    at = np.broadcast_to(np.arange(n), slope.shape)
    stop = np.minimum.accumulate(np.where(slope <= 0, at, n)[:, ::-1], axis=1)[:, ::-1]
    start = np.maximum.accumulate(np.where(slope > 0, at, -1), axis=1)
    return np.take_along_axis(energy, np.where(slope > 0, stop - 1, start + 1), axis=1)


@_of_signal
def _slopes(x: np.ndarray, fs: int) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the levels of the critical bands, and their weights."""
    s = _lifted_spectra(x, fs) ** 2
    e = np.maximum(10 * np.log10(np.maximum(s @ critical_filters(fs, s.shape[1]).T, 1e-30)), -100)
    slope = np.diff(e, axis=1)
    return slope, 20 / (20 + e.max(axis=1, keepdims=True) - e[:, :-1]) / (1 + _local_peaks(slope, e) - e[:, :-1])


def wss(clean: np.ndarray, degraded: np.ndarray, fs: int) -> float:
    """Weighted spectral slope distance over the critical bands, without the worst twentieth of the frames."""
    if min(len(_lifted_spectra(x, fs)) for x in (clean, degraded)) == 0:
        return float("nan")
    (c, w), (d, v) = (_slopes(x, fs) for x in (clean, degraded))
    weight = (w + v) / 2
    return _lowest((weight * (c - d) ** 2).sum(axis=1) / weight.sum(axis=1))


def _without_silence(x: np.ndarray, y: np.ndarray, size: int, hop: int, db: float = 40.0) -> tuple[np.ndarray, np.ndarray]:
    """Both signals overlap-added from the frames in which x is within db of its loudest one."""
    pad = size - len(x) % size  # hop divides size
    x, y = (np.pad(v, (pad // 2, pad - pad // 2)) for v in (x, y))
    w = np.hanning(size + 2)[1:-1]
    fx, fy = frames(x, size, hop) * w, frames(y, size, hop) * w
    level = 20 * np.log10(np.linalg.norm(fx, axis=1) / np.sqrt(size) + EPS)
    keep = level > level.max() - db
    n = int(keep.sum())
    out = np.zeros((3, (n - 1) * hop + size))
    parts = np.stack([fx[keep], fy[keep], np.broadcast_to(w, (n, size))])
    for j in range(0, size, hop):  # overlap-add of all frames, one hop of each at a time
        block = parts[:, :, j : j + hop]
        out[:, j : j + n * hop].reshape(3, n, -1)[:, :, : block.shape[2]] += block
    a, b = out[0] / out[2], out[1] / out[2]
    cut = slice(pad // 2 if keep[0] else 0, len(a) - (pad - pad // 2) if keep[-1] else len(a))
    return a[cut], b[cut]


@_of_signal
def _at_10k(x: np.ndarray, fs: int) -> np.ndarray:
    return audio.resample(np.asarray(x, float), fs, 10_000)


@functools.lru_cache(4)
def _octaves(size: int, fft: int, bands: int, low: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins of third-octave bands at 10 kHz, and the window of a frame in the middle of zeros."""
    f = np.linspace(0, 10_000, fft + 1)[: fft // 2 + 1]
    edge = lambda k: np.abs(f[:, None] - low * 2.0 ** (k / 6)).argmin(axis=0)
    k = np.arange(bands)
    lo, hi = edge(2 * k - 1), edge(2 * k + 1)
    octave = (np.arange(len(f)) >= lo[:, None]) & (np.arange(len(f)) < hi[:, None])
    w = np.zeros(fft)
    w[(fft - size) // 2 : (fft + size) // 2] = np.hanning(size + 2)[1:-1]
    return octave.T.astype(float), w


def stoi(clean: np.ndarray, degraded: np.ndarray, fs: int) -> float | None:
    """Short-time objective intelligibility; None if under 512 samples (at 10 kHz) are not silent."""
    size, fft, bands, low, span = 256, 512, 15, 150, 30
    x, y = (_at_10k(v, fs) for v in (clean, degraded))
    x, y = _without_silence(x, y, size, size // 2)
    if len(x) < fft:
        return None
    octave, w = _octaves(size, fft, bands, low)

    def levels(v: np.ndarray) -> np.ndarray:
        v = np.pad(v, (fft - size) // 2)
        s = np.fft.rfft(np.lib.stride_tricks.sliding_window_view(v, fft)[:: size // 2] * w, axis=1) / w.sum()
        return np.sqrt(np.abs(s) ** 2 @ octave)

    a, b = levels(x), levels(y)
    if len(a) > span:
        a, b = (np.lib.stride_tricks.sliding_window_view(v, span, axis=0).transpose(0, 2, 1) for v in (a, b))
    else:
        a, b = a[None], b[None]
    size_of = lambda v: np.linalg.norm(v, axis=1, keepdims=True)
    b = np.minimum(b * size_of(a) / (size_of(b) + EPS), a * (1 + 10 ** (15 / 20)))
    a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    a, b = a / (size_of(a) + EPS), b / (size_of(b) + EPS)
    return float((a * b).sum() / (bands * len(a)))


def loaded(r: np.ndarray, load: float = 1e-7) -> np.ndarray:
    """Matrices with a share of their trace added to the diagonal."""
    n = r.shape[-1]
    return r + (np.trace(r, axis1=-2, axis2=-1).real * load + 1e-10)[..., None, None] * np.eye(n)


def wiener_weights(ifc: np.ndarray, r: np.ndarray) -> np.ndarray:
    """R^-1 ifc for every bin."""
    return np.linalg.solve(loaded(r), ifc[..., None])[..., 0]


def mvdr_weights(ifc: np.ndarray, r: np.ndarray) -> np.ndarray:
    """R^-1 ifc / (ifc^H R^-1 ifc) for every bin."""
    w = wiener_weights(ifc, r)
    return w / ((ifc.conj() * w).sum(axis=-1, keepdims=True) + 1e-10)


def log_power(x: np.ndarray, size: int = 320, hop: int = 160) -> np.ndarray:
    f = frames(np.asarray(x, float), size, hop)
    return np.log10(np.maximum(np.abs(np.fft.rfft(f * np.hanning(size + 1)[:-1], axis=1)) ** 2, 1e-12))


def mel_filters(sr: int, fft: int, bands: int) -> np.ndarray:
    """Triangles of unit area (bands, bins), centres linear below 1 kHz and logarithmic above."""
    def to_mel(f):
        f = np.asarray(f, float)
        return np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1000) / 1000) / (np.log(6.4) / 27))

    def to_hz(m):
        return np.where(m < 15, m * 200 / 3, 1000 * np.exp((np.maximum(m, 15) - 15) * np.log(6.4) / 27))

    edge = to_hz(np.linspace(to_mel(0), to_mel(sr / 2), bands + 2))
    f = np.linspace(0, sr / 2, fft // 2 + 1)
    up = (f - edge[:-2, None]) / np.diff(edge)[:-1, None]
    down = (edge[2:, None] - f) / np.diff(edge)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edge[2:] - edge[:-2]))[:, None]


def log_mel(x: np.ndarray, sr: int = 16000, kind: str = "mos") -> np.ndarray:
    """'mos': 120 bands of 320/160 frames, (dB re max + 40) / 40; 'asr': 80 bands of 400/160 frames, (max(log10, top - 8) + 4) / 4."""
    size, bands = (320, 120) if kind == "mos" else (400, 80)
    f = frames(np.asarray(x, float), size, 160)
    p = np.abs(np.fft.rfft(f * np.hanning(size + 1)[:-1], axis=1)) ** 2 @ mel_filters(sr, size, bands).T
    p = np.log10(np.maximum(p, 1e-10))
    top = p.max(initial=-10)
    return (10 * (p - top) + 40) / 40 if kind == "mos" else (np.maximum(p, top - 8) + 4) / 4
