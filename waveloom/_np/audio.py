"""Filters, resampling, reverberation and noise for single clips (channel-first arrays or one channel)."""

from __future__ import annotations

import functools
import io
import struct
import wave

import numpy as np


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """(sr, samples channel-first): 16-bit PCM over 32767, or 32-bit floats as they are."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, kind, channels, sr, bits = 12, None, 0, 0, 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            kind, channels, sr, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if kind == 0xFFFE:
                kind = struct.unpack("<H", body[24:26])[0]
        elif name == b"data":
            if (kind, bits) == (1, 16):
                x = np.frombuffer(body[: len(body) // 2 * 2], "<i2").astype(np.float32) / 32767
            elif (kind, bits) == (3, 32):
                x = np.frombuffer(body[: len(body) // 4 * 4], "<f4")
            else:
                raise ValueError(f"WAV format {kind} with {bits} bits is not read")
            return sr, x[: len(x) // channels * channels].reshape(-1, channels).T
        at += 8 + size + size % 2
    raise ValueError("WAV file without data")


def encode_wav(samples: np.ndarray, sr: int) -> bytes:
    """16-bit PCM of channel-first samples, cut towards zero."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(len(samples))
        f.setsampwidth(2)
        f.setframerate(sr)
        f.writeframes(np.clip(np.asarray(samples, float) * 32767, -32768, 32767).astype("<i2").T.tobytes())
    return out.getvalue()


def biquad_coefficients(kind: str, freq: float, q: float, gain_db: float, sr: int) -> tuple[np.ndarray, np.ndarray]:
    """(b, a), normalised to a[0] = 1, of the audio-EQ cookbook's second-order sections."""
    w = 2 * np.pi * freq / sr
    c, alpha, amp = np.cos(w), np.sin(w) / (2 * q), 10 ** (gain_db / 40)
    if kind in ("low_pass", "high_pass"):
        s = 1 if kind == "low_pass" else -1
        b = np.array([(1 - s * c) / 2, s * (1 - s * c), (1 - s * c) / 2])
        a = np.array([1 + alpha, -2 * c, 1 - alpha])
    elif kind == "notch":
        b, a = np.array([1, -2 * c, 1]), np.array([1 + alpha, -2 * c, 1 - alpha])
    elif kind == "peaking":
        b, a = np.array([1 + alpha * amp, -2 * c, 1 - alpha * amp]), np.array([1 + alpha / amp, -2 * c, 1 - alpha / amp])
    elif kind in ("low_shelf", "high_shelf"):
        s, k = (1 if kind == "low_shelf" else -1), 2 * np.sqrt(amp) * alpha
        up, down = amp + 1, amp - 1
        b = amp * np.array([up - s * down * c + k, 2 * s * (down - s * up * c), up - s * down * c - k])
        a = np.array([up + s * down * c + k, -2 * s * (down + s * up * c), up + s * down * c - k])
    else:
        raise ValueError(f"no filter {kind}")
    return b / a[0], a / a[0]


def biquad_filter(x: np.ndarray, b: np.ndarray, a: np.ndarray, block: int = 128) -> np.ndarray:
    """Second-order recursive filter along the last axis, for all leading rows at once (transposed direct form).

    Blocks of samples: what the samples of a block give inside it is one matrix product for all blocks; only the two
    numbers of state at the block edges are carried on one by one.
    """
    b, a = np.asarray(b, float), np.asarray(a, float)
    n = x.shape[-1]
    if not n:
        return np.array(x, float)
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])  # state after a sample of nothing
    push = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])  # what a sample adds to it
    size = min(block, n)
    free = np.empty((size + 1, 2, 2))  # powers of step
    free[0] = np.eye(2)
    for k in range(size):
        free[k + 1] = step @ free[k]
    answer = np.concatenate([[b[0]], free[: size - 1, 0] @ push])  # of one sample
    lag = np.arange(size)[:, None] - np.arange(size)
    inside = np.where(lag >= 0, answer[np.maximum(lag, 0)], 0.0)
    adds = np.stack([free[size - 1 - k] @ push for k in range(size)])  # of each sample to the state at the block's end
    count = -(-n // size)
    padded = np.concatenate([x, np.zeros((*x.shape[:-1], count * size - n))], axis=-1).reshape(*x.shape[:-1], count, size)
    y, given = padded @ inside.T, padded @ adds
    state = np.zeros((*x.shape[:-1], 2))
    for k in range(count):
        y[..., k, :] += state @ free[:size, 0].T
        state = state @ free[size].T + given[..., k, :]
    return y.reshape(*x.shape[:-1], count * size)[..., :n]


def guard(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(initial=0)
    return x / (top + 1e-10) if top - 1 > 1e-10 else x


#: Ranges of the drawn centre frequencies in Hz, by filter: fixed values.
CENTRES = {"low_pass": (4000, 8000), "high_shelf": (1000, 8000), "high_pass": (40, 400), "low_shelf": (40, 1000), "peaking": (40, 4000), "notch": (40, 4000)}


def random_biquads(x: np.ndarray, sr: int, rng: np.random.Generator, most: int = 3) -> np.ndarray:
    """One to `most` random sections in a row, the level as before, then the clip guard."""
    y = x
    for _ in range(rng.integers(1, most + 1)):
        kind = list(CENTRES)[rng.integers(0, len(CENTRES))]
        low, high = CENTRES[kind]
        freq = np.exp(rng.uniform(np.log(low), np.log(high)))
        y = biquad_filter(y, *biquad_coefficients(kind, min(freq, 0.49 * sr), rng.uniform(0.5, 1.5), rng.uniform(-15, 15), sr))
    before, after = np.sqrt(np.mean(x**2)), np.sqrt(np.mean(y**2))
    return guard(y * (before / after) if after > 0 else y)


def random_lfilt(x: np.ndarray, rng: np.random.Generator, edge: float = 3 / 8) -> np.ndarray:
    """A second-order filter with first coefficients 1 and the others drawn from [-edge, edge]."""
    a, b = rng.uniform(-edge, edge, 2), rng.uniform(-edge, edge, 2)
    return biquad_filter(x, np.array([1.0, *b]), np.array([1.0, *a]))


@functools.lru_cache(1024)
def _sinc_taps(cut: float, half: int, frac: float) -> np.ndarray:
    d = np.arange(-half, half + 1) - frac
    k = cut * np.sinc(cut * d) * (0.5 + 0.5 * np.cos(np.pi * np.clip(d / (half + 1), -1, 1)))
    return k / k.sum()


def resample(x: np.ndarray, sr: int, new_sr: int, zeros: int = 16) -> np.ndarray:
    """Windowed-sinc resampling along the last axis to ceil(n * new_sr / sr) samples."""
    if sr == new_sr:
        return np.array(x, float)
    n = x.shape[-1]
    m = -(-n * new_sr // sr)
    cut = min(1.0, new_sr / sr) * 0.95
    half = int(np.ceil(zeros / cut))
    g = np.gcd(sr, new_sr)
    up, down = new_sr // g, sr // g
    padded = np.concatenate([np.zeros((*x.shape[:-1], half)), x, np.zeros((*x.shape[:-1], half + down + 1))], axis=-1)
    out = np.empty((*x.shape[:-1], m))
    for phase in range(min(up, m)):  # output samples whose place between input samples is the same
        at = np.arange(phase, m, up) * down
        base, frac = at // up, (phase * down % up) / up
        k = _sinc_taps(cut, half, frac)
        out[..., phase::up] = np.lib.stride_tricks.sliding_window_view(padded, len(k), axis=-1)[..., base[0] : base[-1] + 1 : down, :] @ k
    return out


def low_pass_resample(x: np.ndarray, freq: int, sr: int) -> np.ndarray:
    """Down to twice the frequency and up again, as long as before."""
    y = resample(resample(x, sr, 2 * freq), 2 * freq, sr)
    n = x.shape[-1]
    return y[..., :n] if y.shape[-1] >= n else np.concatenate([y, np.zeros((*y.shape[:-1], n - y.shape[-1]))], axis=-1)


def coloured_noise(decay: float, n: int, sr: int, rng: np.random.Generator, channels: int = 1) -> np.ndarray:
    """A second of noise whose spectrum falls by linspace(1, sqrt(bins))^decay, at a drawn level, repeated to n samples."""
    x = rng.standard_normal((channels, sr))
    if decay:
        s = np.fft.rfft(x, axis=1)
        x = np.fft.irfft(s / np.linspace(1, np.sqrt(s.shape[1]), s.shape[1]) ** decay, sr, axis=1)
    x = x * rng.uniform(0.01, 0.95) / max(np.abs(x).max(), 1.0)
    return np.tile(x, -(-n // sr))[:, :n]


def convolve(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Full convolution with h by Fourier transforms, cut to the length of x."""
    n = x.shape[-1] + h.shape[-1] - 1
    size = 1 << max(1, n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(h, size), size)[..., : x.shape[-1]]


def trim_rir(h: np.ndarray, db: float = -80.0) -> np.ndarray:
    """Without the end in which the mean channel stays under db of its peak."""
    mono = h.mean(axis=0)
    loud = np.flatnonzero(np.abs(mono) >= np.abs(mono).max() * 10 ** (db / 20))
    return h[:, : loud[-1] + 1] if len(loud) else h


def suppress_late(h: np.ndarray, sr: int, offset: int, rt60: float) -> np.ndarray:
    """Decay from `offset` on as in a room with the given reverberation time."""
    tau = -rt60 / np.log10(10 ** (-60 / 20))
    decay = np.ones(h.shape[1])
    late = np.arange(max(0, h.shape[1] - offset))
    decay[offset:] = 10 ** (-late / sr / tau)
    return h * decay


def unit_energy(h: np.ndarray) -> np.ndarray:
    e = np.sqrt((h**2).sum())
    return h / e if e > 0 else h


def reverb(speech: np.ndarray, rir: np.ndarray, sr: int, drr: float = 0.3, rt60: float = 0.5, offset_ms: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """(target, reverberant): reverberant speech for the mixture, and drr * dry + (1 - drr) * little reverberant as the target,
    at the level of the dry speech."""
    peak = int(np.abs(rir.mean(axis=0)).argmax())
    h = unit_energy(trim_rir(rir))
    wet = convolve(speech, h)
    little = convolve(speech, unit_energy(suppress_late(h, sr, peak + offset_ms * sr // 1000, rt60)))
    target = drr * speech + (1 - drr) * little
    level = lambda v: np.sqrt(np.mean(v**2))
    return target * level(speech) / (level(target) + 1e-10), wet


def clip_level(x: np.ndarray, target: float, steps: int = 60) -> float | None:
    """The clipping edge (0.01 to 0.99 of the peak) at which 20 * log10 of the ratio of energies is `target`, by bisection."""
    top = np.abs(x).max(initial=0)

    def sdr(c: float) -> float:
        lost = x - np.clip(x, -c, c)
        return 20 * np.log10(np.mean(x**2) / (np.mean(lost**2) + 1e-10))

    low, high = 0.01 * top, 0.99 * top
    if not top or not sdr(low) <= target <= sdr(high):
        return None
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if sdr(mid) < target else (low, mid)
    return (low + high) / 2
