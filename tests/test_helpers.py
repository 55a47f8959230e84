"""The numpy helpers and the properties that signals keep."""

import numpy as np
import pytest

from waveloom._np import audio, quality, spectra

RNG = np.random.default_rng(3)


def test_band_widths_and_alpha():
    assert spectra.erb_widths(48000, 960, 32, 2) == [2] * 13 + [5, 5, 7, 7, 8, 10, 12, 13, 15, 18, 20, 24, 28, 31, 37, 42, 50, 56, 67]
    w = spectra.erb_widths(24000, 192, 24, 1)
    assert w == [1] * 12 + [2, 3, 3, 4, 5, 5, 7, 8, 9, 10, 13, 16] and sum(w) == 97
    assert spectra.norm_alpha(48000, 480, 1) == 0.99
    assert spectra.norm_alpha(48000, 1, 100) < 1


@pytest.mark.parametrize("fft,hop", [(960, 480), (16, 8)])
def test_stft_round_trip(fft, hop):
    x = RNG.uniform(-1, 1, hop * 20)
    y = spectra.istft(spectra.stft(x, fft, hop), fft, hop)
    assert np.allclose(y[fft - hop :], x[: len(x) - (fft - hop)], atol=1e-9)


def test_wav_round_trip():
    x = np.stack([np.sin(np.arange(500) / 9), np.linspace(-1, 1, 500)])
    sr, y = audio.decode_wav(audio.encode_wav(x, 16000))
    assert sr == 16000 and y.shape == x.shape and np.abs(x - y).max() < 1 / 32000
    with pytest.raises(ValueError):
        audio.decode_wav(b"RIFFxxxxWAVE")


def test_resampling_keeps_tones_and_lengths():
    t = np.arange(8000)
    x = np.sin(2 * np.pi * 440 * t / 16000)
    y = audio.resample(x, 16000, 10000)
    assert len(y) == 5000
    assert np.abs(np.fft.rfft(y)).argmax() == 220
    z = audio.low_pass_resample(np.sin(2 * np.pi * 5000 * t / 16000), 2000, 16000)
    assert len(z) == len(t) and np.sqrt(np.mean(z**2)) < 0.02


def test_filters():
    x = RNG.standard_normal(4000) * 0.1
    for kind in audio.CENTRES:
        b, a = audio.biquad_coefficients(kind, 1000, 0.8, 6.0, 16000)
        assert a[0] == 1 and np.isfinite(audio.biquad_filter(x, b, a)).all()
    n = np.arange(8000)
    b, a = audio.biquad_coefficients("notch", 1000, 1.0, 0, 16000)
    y = audio.biquad_filter(np.sin(2 * np.pi * 1000 * n / 16000), b, a)
    assert np.abs(y[4000:]).max() < 1e-3
    y = audio.random_biquads(x, 16000, np.random.default_rng(1))
    assert abs(np.sqrt(np.mean(y**2)) / np.sqrt(np.mean(x**2)) - 1) < 1e-6
    assert np.isfinite(audio.random_lfilt(x, np.random.default_rng(1))).all()


def test_clipping_meets_target():
    x = RNG.standard_normal(20000)
    c = audio.clip_level(x, 40.0)
    lost = x - np.clip(x, -c, c)
    assert abs(20 * np.log10(np.mean(x**2) / np.mean(lost**2)) - 40) < 0.05
    assert audio.clip_level(np.zeros(10), 40.0) is None


def test_reverb_and_noise():
    x = RNG.standard_normal((1, 4000))
    h = np.zeros((1, 500))
    h[0, 0], h[0, 100] = 1, 0.5
    target, wet = audio.reverb(x, h, 16000)
    assert target.shape == wet.shape == x.shape
    assert abs(np.sqrt(np.mean(target**2)) - np.sqrt(np.mean(x**2))) < 1e-6
    assert np.allclose(audio.convolve(x, h), np.convolve(x[0], h[0])[:4000])
    pink = audio.coloured_noise(1.0, 3000, 1000, np.random.default_rng(2))
    assert pink.shape == (1, 3000) and np.abs(pink).max() < 1 and np.array_equal(pink[:, :1000], pink[:, 1000:2000])
    s = np.abs(np.fft.rfft(pink[0, :1000]))
    assert s[1:100].mean() > 2 * s[400:].mean()


def test_quality_of_equal_and_degraded_signals():
    t = np.arange(16000) / 16000
    x = np.sin(2 * np.pi * 300 * t) * (0.3 + 0.7 * np.sin(2 * np.pi * 3 * t) ** 2) + 0.05 * RNG.standard_normal(16000)
    noisy = x + 0.3 * RNG.standard_normal(16000)
    worse = x + 1.5 * RNG.standard_normal(16000)
    assert quality.stoi(x, x, 16000) > 0.999
    assert 1 > quality.stoi(x, noisy, 16000) > quality.stoi(x, worse, 16000)
    assert quality.stoi(np.zeros(100), np.zeros(100), 16000) is None
    assert quality.llr(x, x, 16000) < 1e-6 < quality.llr(x, noisy, 16000) < quality.llr(x, worse, 16000)
    assert quality.wss(x, x, 16000) < 1e-6 < quality.wss(x, noisy, 16000)
    assert quality.fw_segmental_snr(x, x, 16000) == 35
    assert quality.fw_segmental_snr(x, noisy, 16000) > quality.fw_segmental_snr(x, worse, 16000)


def test_local_peaks_by_loop():
    e = RNG.standard_normal((20, 25))
    s = np.diff(e, axis=1)
    got = quality._local_peaks(s, e)
    for f in range(20):
        for k in range(24):
            n = k
            if s[f, k] > 0:
                while n < 24 and s[f, n] > 0:
                    n += 1
                want = e[f, n - 1]
            else:
                while n >= 0 and s[f, n] <= 0:
                    n -= 1
                want = e[f, n + 1]
            assert got[f, k] == want


def test_multiframe_weights():
    a = RNG.standard_normal((7, 4, 4)) + 1j * RNG.standard_normal((7, 4, 4))
    r = a @ a.conj().transpose(0, 2, 1)
    v = RNG.standard_normal((7, 4)) + 1j * RNG.standard_normal((7, 4))
    w = quality.mvdr_weights(v, r)
    assert np.allclose((v.conj() * w).sum(axis=1), 1, atol=1e-5)  # no distortion in the wanted direction


def test_mel_and_levels():
    x = np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000)
    assert quality.log_power(x).shape[1] == 161
    assert quality.log_mel(x, kind="mos").max() == pytest.approx(1.0)
    assert quality.log_mel(x, kind="asr").shape[1] == 80


def test_air_absorption():
    a = spectra.air_attenuation("20C_50-70%", 10, 481, 48000)
    assert a[0] == pytest.approx(np.exp(-0.001)) and np.all(np.diff(a) <= 1e-12) and len(a) == 481
