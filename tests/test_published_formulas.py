"""Quality measures, filters and resampling against plain loops written from the published formulas."""

import math

import numpy as np
import pytest

from waveloom._np import audio, quality, spectra

RNG = np.random.default_rng(11)
TOL = {"rel": 1e-4, "abs": 1e-4}
FS = 16000


def voice(n, seed=0):
    r = np.random.default_rng(seed)
    t = np.arange(n) / FS
    x = sum(np.sin(2 * np.pi * f * t + p) / k for k, (f, p) in enumerate(((180, 0), (420, 1), (910, 2), (2300, 3)), 1))
    return x * (0.2 + np.sin(2 * np.pi * 2.7 * t) ** 2) + 0.02 * r.standard_normal(n)


PAIRS = [(x, x + g * np.random.default_rng(s).standard_normal(len(x))) for s, g in ((1, 0.05), (2, 0.4), (3, 2.0)) for x in (voice(9000, s),)]


def windowed(x, size, hop, count):
    w = [0.5 * (1 - math.cos(2 * math.pi * (i + 1) / (size + 1))) for i in range(size)]
    for k in range(count):
        yield np.array([x[k * hop + i] * w[i] for i in range(size)])


def bands(half):
    """Critical bands of the published table: centre and bandwidth in Hz, then the filter's value at each bin."""
    centre, out = 50.0, []
    for width in quality.BANDWIDTHS:
        f0, bw = math.floor(centre / (FS / 2) * half), width / (FS / 2) * half
        g = [math.exp(-11 * ((j - f0) / bw) ** 2 + math.log(quality.BANDWIDTHS[0]) - math.log(width)) for j in range(half)]
        out.append(np.array([v if v > math.exp(-30 / (2 * 2.303)) else 0.0 for v in g]))
        centre += width
    return out


def spectrum_pairs(clean, other):
    size, hop, fft = 480, 120, 1024
    count = int(len(clean) / hop - size / hop)
    for a, b in zip(windowed(clean + quality.EPS, size, hop, count), windowed(other + quality.EPS, size, hop, count)):
        yield tuple(np.abs(np.fft.fft(np.pad(v, (0, fft - size))))[: fft // 2] for v in (a, b))


@pytest.mark.parametrize("clean, other", PAIRS)
def test_frequency_weighted_segmental_snr(clean, other):
    filters, found = bands(512), []
    for a, b in spectrum_pairs(clean, other):
        top = bottom = 0.0
        for g in filters:
            x, y = (g * a).sum() / a.sum(), (g * b).sum() / b.sum()
            w = x**0.2
            top += w * 10 * math.log10(x**2 / max((x - y) ** 2, quality.EPS))
            bottom += w
        found.append(min(max(top / bottom, -10), 35))
    assert quality.fw_segmental_snr(clean, other, FS) == pytest.approx(np.mean(found), **TOL)


def levinson(r):
    """[1, -a] by the recursion over orders."""
    a, e = [1.0], r[0]
    for i in range(1, len(r)):
        k = -sum(a[j] * r[i - j] for j in range(i)) / e
        a = [*a, 0.0]
        a = [a[j] + k * a[i - j] for j in range(i + 1)]
        e *= 1 - k * k
    return a


@pytest.mark.parametrize("clean, other", PAIRS)
def test_log_likelihood_ratio(clean, other):
    size, hop, order, found = 480, 120, 16, []
    count = (len(clean) - (size - hop)) // hop - 1
    for x, y in zip(windowed(clean, size, hop, count), windowed(other, size, hop, count)):
        rx, ry = ([sum(v[i] * v[i + k] for i in range(size - k)) for k in range(order + 1)] for v in (x, y))
        ax, ay = levinson(rx), levinson(ry)
        form = lambda a: sum(a[i] * a[j] * rx[abs(i - j)] for i in range(order + 1) for j in range(order + 1))
        found.append(math.log(form(ay) / form(ax)))
    found = sorted(found)[: round(0.95 * len(found))]
    assert quality.llr(clean, other, FS) == pytest.approx(np.mean(found), rel=1e-3, abs=1e-4)


def slopes(e):
    """Slopes between neighbouring bands, and the weights of the published spectral-slope measure."""
    s = [e[k + 1] - e[k] for k in range(24)]
    weights = []
    for k in range(24):
        n = k
        if s[k] > 0:
            while n < 24 and s[n] > 0:
                n += 1
            peak = e[n - 1]
        else:
            while n >= 0 and s[n] <= 0:
                n -= 1
            peak = e[n + 1]
        weights.append(20 / (20 + max(e) - e[k]) * 1 / (1 + peak - e[k]))
    return s, weights


@pytest.mark.parametrize("clean, other", PAIRS)
def test_weighted_spectral_slope(clean, other):
    filters, found = bands(512), []
    for a, b in spectrum_pairs(clean, other):
        (sa, wa), (sb, wb) = (slopes([10 * math.log10(max((g * v**2).sum(), 1e-10)) for g in filters]) for v in (a, b))
        w = [(p + q) / 2 for p, q in zip(wa, wb)]
        found.append(sum(v * (p - q) ** 2 for v, p, q in zip(w, sa, sb)) / sum(w))
    found = sorted(found)[: round(0.95 * len(found))]
    assert quality.wss(clean, other, FS) == pytest.approx(np.mean(found), **TOL)


@pytest.mark.parametrize("seconds", [0.3, 1.2])
@pytest.mark.parametrize("level", [0.1, 1.0])
def test_short_time_intelligibility(seconds, level):
    """At 10 kHz, where nothing is resampled and no frame is silent: third-octave envelopes of 30 frames, correlated."""
    n = int(seconds * 10_000) // 128 * 128 + 128
    x = voice(n) + 0.3 * RNG.standard_normal(n)
    y = x + level * RNG.standard_normal(n)
    a, b = quality._without_silence(x, y, 256, 128)
    assert np.allclose(a[300:-300], x[300 : len(a) - 300], atol=1e-9)
    w = [0.5 - 0.5 * math.cos(2 * math.pi * (i + 1) / 257) for i in range(256)]
    freqs = [10_000 * k / 512 for k in range(257)]
    near = lambda f: min(range(257), key=lambda k: abs(freqs[k] - f))
    edges = [(near(150 * 2 ** ((2 * k - 1) / 6)), near(150 * 2 ** ((2 * k + 1) / 6))) for k in range(15)]
    env = []
    for v in (a, b):
        v = np.concatenate([np.zeros(128), v, np.zeros(128)])
        rows = []
        for k in range((len(v) - 512) // 128 + 1):
            s = np.fft.fft([v[k * 128 + 128 + i] * w[i] for i in range(256)], 512)[:257]
            rows.append([math.sqrt(sum(abs(z) ** 2 for z in s[lo:hi])) for lo, hi in edges])
        env.append(np.array(rows))
    m = len(env[0])
    total, count = 0.0, 0
    for end in range(30, m + 1) if m > 30 else [m]:
        for j in range(15):
            p, q = (e[max(0, end - 30) : end, j] for e in env)
            q = q * np.linalg.norm(p) / np.linalg.norm(q)
            q = np.minimum(q, p * (1 + 10 ** (15 / 20)))
            p, q = p - p.mean(), q - q.mean()
            total += (p @ q) / (np.linalg.norm(p) * np.linalg.norm(q))
            count += 1
    assert quality.stoi(x, y, 10_000) == pytest.approx(total / count, **TOL)


@pytest.mark.parametrize("n", [1, 5, 128, 129, 1000])
@pytest.mark.parametrize("kind", list(audio.CENTRES))
def test_second_order_sections(n, kind):
    """y[t] = sum b x - sum a y, sample by sample."""
    x = RNG.standard_normal(n)
    b, a = audio.biquad_coefficients(kind, 900, 0.8, 5.0, FS)
    y = []
    for t in range(n):
        at = lambda v, k: v[t - k] if t >= k else 0.0
        y.append(b[0] * x[t] + b[1] * at(x, 1) + b[2] * at(x, 2) - (a[1] * at(y, 1) + a[2] * at(y, 2)))
    assert np.allclose(audio.biquad_filter(x, b, a), y, rtol=1e-7, atol=1e-9)
    both = audio.biquad_filter(np.stack([x, 2 * x]), b, a)
    assert np.allclose(both, np.stack([y, 2 * np.array(y)]), rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize("sr, new", [(8000, 12000), (8000, 4000), (16000, 10000), (8000, 8500)])
def test_resampling_by_direct_sums(sr, new):
    """Each output sample as a sum over the input around its place, with a windowed sinc of unit sum."""
    x = RNG.standard_normal(150)
    m = -(-150 * new // sr)
    cut = min(1.0, new / sr) * 0.95
    half = math.ceil(16 / cut)
    want = []
    for i in range(m):
        place = i * sr / new
        whole = math.floor(place + 1e-9)
        k = [cut * np.sinc(cut * (j - (place - whole))) * (0.5 + 0.5 * math.cos(math.pi * min(1, max(-1, (j - (place - whole)) / (half + 1))))) for j in range(-half, half + 1)]
        want.append(sum(v * (x[whole + j] if 0 <= whole + j < 150 else 0.0) for v, j in zip(k, range(-half, half + 1))) / sum(k))
    assert np.allclose(audio.resample(x, sr, new), want, atol=1e-9)


def test_reverberation_by_direct_sums():
    x, h = RNG.standard_normal((1, 300)), RNG.standard_normal((1, 90)) * np.exp(-np.arange(90) / 15)
    target, wet = audio.reverb(x, h, 8000, 0.3, 0.5, 2)
    mono = h[0]
    last = max(i for i in range(90) if abs(mono[i]) >= abs(mono).max() * 10 ** (-80 / 20))
    trimmed = mono[: last + 1]
    peak = int(np.abs(mono).argmax())
    late = [v * (10 ** (-(i - peak - 16) / 8000 / (-0.5 / math.log10(10 ** (-60 / 20)))) if i >= peak + 16 else 1.0) for i, v in enumerate(trimmed)]
    unit = lambda v: np.array(v) / math.sqrt(sum(w * w for w in v))
    conv = lambda k: np.array([sum(x[0, t - i] * k[i] for i in range(min(t + 1, len(k)))) for t in range(300)])
    assert np.allclose(wet[0], conv(unit(trimmed)), atol=1e-9)
    want = 0.3 * x[0] + 0.7 * conv(unit(late))
    assert np.allclose(target[0], want * np.sqrt((x**2).mean()) / np.sqrt((want**2).mean()), atol=1e-8)


@pytest.mark.parametrize("decay", [-1.0, 0.5, 2.0])
def test_coloured_noise_has_its_spectrum(decay):
    one, two = np.random.default_rng(4), np.random.default_rng(4)
    got = audio.coloured_noise(decay, 700, 500, one)[0]
    white = two.standard_normal((1, 500))[0]
    s = [z / (1 + (math.sqrt(251) - 1) * k / 250) ** decay for k, z in enumerate(np.fft.rfft(white))]
    y = np.array([(s[0] + sum(2 * (z * np.exp(2j * np.pi * k * t / 500)).real for k, z in enumerate(s[1:-1], 1)) + s[-1] * (-1) ** t).real / 500 for t in range(500)])
    y *= two.uniform(0.01, 0.95) / max(abs(y).max(), 1.0)
    assert np.allclose(got, np.concatenate([y, y[:200]]), atol=1e-9)


def test_multiframe_filters_bin_by_bin():
    a = RNG.standard_normal((5, 3, 3)) + 1j * RNG.standard_normal((5, 3, 3))
    r = a @ a.conj().transpose(0, 2, 1)
    v = RNG.standard_normal((5, 3)) + 1j * RNG.standard_normal((5, 3))
    for f in range(5):
        m = r[f] + (np.trace(r[f]).real * 1e-7 + 1e-10) * np.eye(3)
        w = np.linalg.inv(m) @ v[f]
        assert np.allclose(quality.wiener_weights(v, r)[f], w)
        assert np.allclose(quality.mvdr_weights(v, r)[f], w / (v[f].conj() @ w + 1e-10))


@pytest.mark.parametrize("kind, size, count", [("power", 320, 161), ("mos", 320, 120), ("asr", 400, 80)])
def test_log_spectra_frame_by_frame(kind, size, count):
    x = voice(2000)
    w = [0.5 - 0.5 * math.cos(2 * math.pi * i / size) for i in range(size)]
    power = [[abs(sum(x[k * 160 + i] * w[i] * np.exp(-2j * np.pi * i * f / size) for i in range(size))) ** 2 for f in range(size // 2 + 1)] for k in range(2)]
    if kind == "power":
        want = np.log10(np.maximum(power, 1e-12))
        got = quality.log_power(x)
    else:
        mel = lambda f: f * 3 / 200 if f < 1000 else 15 + math.log(f / 1000) * 27 / math.log(6.4)
        hz = lambda m: m * 200 / 3 if m < 15 else 1000 * 6.4 ** ((m - 15) / 27)
        edge = [hz(mel(8000) * k / (count + 1)) for k in range(count + 2)]
        rows = []
        for p in power:
            row = []
            for b in range(count):
                lo, mid, hi = edge[b : b + 3]
                row.append(sum(v * max(0.0, min((f * 16000 / size - lo) / (mid - lo), (hi - f * 16000 / size) / (hi - mid))) * 2 / (hi - lo) for f, v in enumerate(p)))
            rows.append(row)
        levels = np.log10(np.maximum(rows, 1e-10))
        got = quality.log_mel(x, FS, kind)
        # both maps are relative to the loudest band of the clip, which the first two frames need not hold
        if kind == "mos":
            assert np.allclose(10 * (levels - levels[0, 0]) / 40, got[:2] - got[0, 0], atol=1e-6) and got.max() == pytest.approx(1.0)
            return
        want = levels / 4 + 1
        floor = got.max() - 2
        want = np.maximum(want, floor)
    assert got.shape[1] == count and np.allclose(got[:2], want, atol=1e-6)


def test_running_means_by_loop():
    x, start = RNG.standard_normal((50, 4)), np.linspace(-60, -90, 4)
    s, want = start, []
    for row in x:
        s = [0.1 * v + 0.9 * w for v, w in zip(row, s)]
        want.append(s)
    assert np.allclose(spectra.ema(x, start, 0.9), want)
