"""Signal parameters, fixed weight tables, and the per-recording numpy helpers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import STD_FLOOR


@dataclass(frozen=True)
class SignalParams:
    """Every length and limit of the signal features. Defaults are the production values.

    MFCC, zero crossings and the harmonic split use 2048-sample frames, everything else 1024.
    """

    sample_rate: int = 16000
    n_fft: int = 1024
    hop: int = 512
    n_mels: int = 128
    fmin: float = 20.0
    n_mfcc: int = 20
    mfcc_fft: int = 2048
    mfcc_mels: int = 128
    zcr_frame: int = 2048
    contrast_bands: int = 6
    contrast_fmin: float = 200.0
    hpss_fft: int = 2048
    hpss_kernel: int = 31


# Fixed values of the level and shape measures.
AMIN = 1e-10  # smallest power before a logarithm
TOP_DB = 80.0  # dynamic range kept below the loudest value
ROLLOFF_SHARE = 0.85
CONTRAST_QUANTILE = 0.02
ZERO_LEVEL = 1e-10  # samples at or below count as zero in sign tests
DELTA_WIDTH = 9

# Local linear slope and local quadratic second derivative over nine frames.
SLOPE_WEIGHTS = [k / 60.0 for k in range(-4, 5)]
CURVATURE_WEIGHTS = [w / 462.0 for w in (28, 7, -8, -17, -20, -17, -8, 7, 28)]

# Fixed values of the mel scale: linear below 1 kHz, logarithmic above.
MEL_LINEAR_STEP = 200.0 / 3.0
MEL_BREAK_HZ = 1000.0
MEL_BREAK = MEL_BREAK_HZ / MEL_LINEAR_STEP
MEL_LOG_STEP = np.log(6.4) / 27.0


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(n) / n)


def _hz_to_mel(hz: float) -> float:
    if hz < MEL_BREAK_HZ:
        return hz / MEL_LINEAR_STEP
    return MEL_BREAK + np.log(hz / MEL_BREAK_HZ) / MEL_LOG_STEP


def _mel_to_hz(mel: np.ndarray) -> np.ndarray:
    above = MEL_BREAK_HZ * np.exp(MEL_LOG_STEP * (mel - MEL_BREAK))
    return np.where(mel < MEL_BREAK, mel * MEL_LINEAR_STEP, above)


def mel_weights(sample_rate: int, n_fft: int, n_mels: int, fmin: float) -> np.ndarray:
    """(n_mels, bins) triangular filters with unit area."""
    bins = np.arange(n_fft // 2 + 1) * sample_rate / n_fft
    edges = _mel_to_hz(np.linspace(_hz_to_mel(fmin), _hz_to_mel(sample_rate / 2), n_mels + 2))
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    rising, falling = (bins - low) / (mid - low), (high - bins) / (high - mid)
    return np.maximum(0.0, np.minimum(rising, falling)) * 2.0 / (high - low)


def dct_weights(n_out: int, n_in: int) -> np.ndarray:
    """(n_out, n_in) orthonormal DCT-II rows."""
    k, i = np.arange(n_out)[:, None], np.arange(n_in)[None, :]
    rows = np.cos(np.pi * k * (2 * i + 1) / (2 * n_in)) * np.sqrt(2.0 / n_in)
    rows[0] /= np.sqrt(2.0)
    return rows


def contrast_slices(sample_rate: int, n_fft: int, n_bands: int, fmin: float) -> list[tuple[int, int, int]]:
    """Per octave band: first bin, number of bins compared, number of bins averaged per end.

    Neighbouring bands share a bin below; the top band takes all remaining bins; every band
    but the top one leaves out its highest bin.
    """
    n_bins = n_fft // 2 + 1
    freqs = np.arange(n_bins) * sample_rate / n_fft
    edges = [0.0] + [fmin * 2.0**k for k in range(n_bands + 1)]
    if any(e >= sample_rate / 2 for e in edges[:-1]):
        raise ValueError("a contrast band lies above half the sample rate")
    slices = []
    for band, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        inside = np.flatnonzero((freqs >= lo) & (freqs <= hi))
        if inside.size == 0:
            raise ValueError(f"contrast band {band} holds no frequency bin")
        start = inside[0] - (1 if band > 0 else 0)
        stop = n_bins if band == n_bands else inside[-1] + 1
        ends = max(1, int(np.rint(CONTRAST_QUANTILE * (stop - start))))
        compared = stop - start - (0 if band == n_bands else 1)
        slices.append((int(start), int(compared), ends))
    return slices


# --- kernels: one recording in, one row per frame out ---


def framed(x: np.ndarray, length: int, hop: int) -> np.ndarray:
    """(frames, length) view of ``x``; no frame if ``x`` is shorter."""
    if len(x) < length:
        return np.empty((0, length))
    return np.lib.stride_tricks.sliding_window_view(x, length)[::hop]


def power(x: np.ndarray, window: np.ndarray, hop: int) -> np.ndarray:
    """(frames, bins) power spectrum of centred, zero-padded frames."""
    n = len(window)
    if len(x) == 0:
        return np.empty((0, n // 2 + 1))
    return frame_power(framed(np.pad(x.astype(np.float64), n // 2), n, hop), window)


def frame_power(frames: np.ndarray, window: np.ndarray) -> np.ndarray:
    """(frames, bins) power spectrum of ready frames."""
    spectrum = np.fft.rfft(frames * window, axis=1)
    return spectrum.real**2 + spectrum.imag**2


def cepstra(bands: np.ndarray, dct: np.ndarray) -> np.ndarray:
    """DCT of band levels in dB, floored below the recording's loudest band."""
    level = 10.0 * np.log10(np.maximum(AMIN, bands))
    low = level.max() - TOP_DB if level.size else 0.0
    return np.maximum(level, low) @ dct.T


def deltas(rows: np.ndarray, weights: list[float]) -> np.ndarray:
    """Weighted sum over nine neighbouring frames; no row with fewer than nine frames.

    The fit is one polynomial for the four frames at either end, and its highest derivative
    is constant, so the ends repeat the first and last full window.
    """
    inner = len(rows) - DELTA_WIDTH + 1
    if inner < 1:
        return rows[:0]
    fitted = sum(w * rows[k : k + inner] for k, w in enumerate(weights))
    return np.pad(fitted, ((DELTA_WIDTH // 2, DELTA_WIDTH // 2), (0, 0)), mode="edge")


def spectral_shape(power_rows: np.ndarray, step: float) -> list[np.ndarray]:
    """Centroid, bandwidth, rolloff and flatness of every frame; 0 Hz for empty frames."""
    mag = np.sqrt(power_rows)
    freqs = np.arange(mag.shape[1]) * step
    running = np.cumsum(mag, axis=1)
    mass = running[:, -1:]
    share = np.divide(mag, mass, out=np.zeros_like(mag), where=mass > 0)
    center = share @ freqs
    spread = np.sqrt((share * (freqs - center[:, None]) ** 2).sum(axis=1))
    rolloff = (running < ROLLOFF_SHARE * mass).sum(axis=1) * step
    floored = np.maximum(AMIN, power_rows)
    flat = np.exp(np.log(floored).mean(axis=1)) / floored.mean(axis=1)
    return [center, spread, rolloff, flat]


def frame_levels(x: np.ndarray, n_frames: int, params: SignalParams) -> list[np.ndarray]:
    """Zero-crossing rate, RMS and short-time energy; energy is NaN past the uncentred frames."""
    p = params
    x = x.astype(np.float64)
    z = p.zcr_frame
    negative = np.pad(x < -ZERO_LEVEL, z // 2, mode="edge") if len(x) else np.empty(0, bool)
    changes = np.concatenate([[0], np.cumsum(negative[1:] != negative[:-1])])
    first = np.arange(n_frames) * p.hop
    crossings = (changes[first + z - 1] - changes[first]) / z
    centred = framed(np.pad(x, p.n_fft // 2), p.n_fft, p.hop)[:n_frames]
    plain = framed(x, p.n_fft, p.hop)
    energy = np.full(n_frames, np.nan)
    energy[: len(plain)] = np.einsum("ij,ij->i", plain, plain)
    return [crossings, np.sqrt(np.einsum("ij,ij->i", centred, centred) / p.n_fft), energy]


def band_extremes(power_rows: np.ndarray, slices: list[tuple[int, int, int]]) -> np.ndarray:
    """(2, frames, bands): mean of the strongest and of the weakest bins of each band."""
    mag = np.sqrt(power_rows)
    ranked = [(np.sort(mag[:, start : start + size], axis=1), ends) for start, size, ends in slices]
    strong = [r[:, -ends:].mean(axis=1) for r, ends in ranked]
    weak = [r[:, :ends].mean(axis=1) for r, ends in ranked]
    return np.stack([np.column_stack(strong), np.column_stack(weak)])


def resample(samples: Column, rate: Column, target: int) -> Column:
    """Windowed-sinc polyphase resampling of one recording per row."""

    @F.pandas_udf("array<double>")
    def run(rows: pd.Series, rates: pd.Series) -> pd.Series:
        out = [_resample(np.asarray(x, dtype=np.float64), int(r), target) for x, r in zip(rows, rates)]
        return pd.Series(out, dtype=object)

    return run(samples, rate)


@lru_cache(maxsize=16)
def _sinc_taps(up: int, down: int, zeros: int = 32, beta: float = 12.0) -> np.ndarray:
    """(up, taps) low-pass weights, one row per sub-sample position."""
    cutoff = min(1.0, up / down) * 0.96
    half = int(np.ceil(zeros / cutoff))
    distance = np.arange(2 * half)[None, :] - half - np.arange(up)[:, None] / up
    kaiser = np.i0(beta * np.sqrt(np.maximum(0.0, 1 - (distance / half) ** 2))) / np.i0(beta)
    return cutoff * np.sinc(cutoff * distance) * kaiser


def _resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    if rate == target or x.size == 0:
        return x
    return resampled(x, 0, rate, target, 0, int(np.ceil(x.size * target / rate)))


def resampling(rate: int, target: int) -> tuple[int, int, np.ndarray]:
    """(up, down, weights per sub-sample position); output m sits at input position m * down / up."""
    up, down = target // gcd(rate, target), rate // gcd(rate, target)
    return up, down, _sinc_taps(up, down)


def resampled(x: np.ndarray, first: int, rate: int, target: int, low: int, high: int, block: int = 4096) -> np.ndarray:
    """Outputs ``low`` to ``high - 1`` of a recording of which ``x`` holds the samples from ``first`` on.

    Samples that are not there count as zero: those before and after the recording.
    """
    up, down, taps = resampling(rate, target)
    half = taps.shape[1] // 2
    out = np.empty(max(0, high - low))
    start, end = low * down // up - half, (high - 1) * down // up + half + 1 if high > low else 0
    near = np.zeros(max(0, end - start))
    a, b = max(start, first), min(end, first + len(x))
    if b > a:
        near[a - start : b - start] = x[a - first : b - first]
    windows = np.lib.stride_tricks.sliding_window_view(near, 2 * half) if len(out) else None
    for at in range(low, high, block):
        whole, phase = np.divmod(np.arange(at, min(at + block, high)) * down, up)
        out[at - low : at - low + block] = np.einsum("ij,ij->i", windows[whole - half - start], taps[phase])
    return out


def _median_filter(s: np.ndarray, size: int, axis: int, block: int = 2) -> np.ndarray:
    """Running median with mirrored ends, a few frames at a time so windows stay in cache."""
    half = size // 2
    pad = [(half, half) if a == axis else (0, 0) for a in range(2)]
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(s, pad, mode="symmetric"), size, axis=axis)
    out = np.empty_like(s)
    for i in range(0, len(s), block):
        out[i : i + block] = np.partition(windows[i : i + block].copy(), half, axis=-1)[..., half]
    return out


def split_energies(x: np.ndarray, n_fft: int, hop: int, kernel: int) -> tuple[float, float]:
    """Mean square of the harmonic and of the percussive part of a signal.

    The magnitude is median filtered along time (harmonic) and along frequency (percussive),
    split by squared soft masks, and both parts are inverted to signals.
    """
    if x.size == 0:
        return (np.nan, np.nan)
    frames = framed(np.pad(x, n_fft // 2), n_fft, hop)
    kept = split_signals(frames, n_fft, hop, kernel)[:, n_fft // 2 : n_fft // 2 + x.size]
    energy = (kept**2).sum(axis=1) / x.size
    return float(energy[0]), float(energy[1])


def split_signals(frames: np.ndarray, n_fft: int, hop: int, kernel: int) -> np.ndarray:
    """(2, samples): harmonic and percussive part of neighbouring frames, from the first one's first sample on."""
    window = hann(n_fft)
    spectrum = np.fft.rfft(frames * window, axis=1)
    magnitude = np.abs(spectrum)
    harm = _median_filter(magnitude, kernel, axis=0)
    perc = _median_filter(magnitude, kernel, axis=1)
    larger = np.maximum(harm, perc)
    empty = larger < np.finfo(np.float64).tiny
    larger[empty] = 1.0
    h2, p2 = (harm / larger) ** 2, (perc / larger) ** 2
    share = np.where(empty, 0.5, h2 / np.where(empty, 1.0, h2 + p2))
    weight = np.zeros(hop * (len(spectrum) - 1) + n_fft)
    signals = np.zeros((2, weight.size))
    parts = np.stack([share * spectrum, (1.0 - share) * spectrum])
    inverse = np.fft.irfft(parts, n=n_fft, axis=2) * window
    for t in range(len(spectrum)):
        at = slice(t * hop, t * hop + n_fft)
        weight[at] += window**2
        signals[:, at] += inverse[:, t]
    covered = weight > np.finfo(np.float64).tiny
    signals[:, covered] /= weight[covered]
    return signals


# --- kernel on (rows, dimensions) matrices ---


def vector_drift(
    v: np.ndarray, mean: np.ndarray, std: np.ndarray, norm_floor: float, unit_fallback: bool
) -> list[np.ndarray]:
    """Raw Euclidean, Manhattan, cosine and their z-score counterparts, per row."""
    constant = std == 0 if unit_fallback else std < STD_FLOOR
    gap = v - mean
    z = gap / np.where(constant, 1.0, std)
    if not unit_fallback:
        z[constant] = 0.0

    def length(x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.einsum("ij,ij->i", x, x))

    def ratio(top: np.ndarray, bottom: np.ndarray, valid: np.ndarray) -> np.ndarray:
        return np.divide(top, bottom, out=np.zeros_like(top), where=valid)

    nv, nm, nz = length(v), length(mean), length(z)
    valid = ~((nv < norm_floor) | (nm < norm_floor) | (nv == 0) | (nm == 0))
    return [
        length(gap),
        np.abs(gap).sum(axis=1),
        ratio(np.einsum("ij,ij->i", v, mean), nv * nm, valid),
        nz,
        np.abs(z).sum(axis=1),
        ratio(z.sum(axis=1), nz * np.sqrt(z.shape[1]), nz != 0),
    ]
