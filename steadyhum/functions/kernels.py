"""Arrow-batched kernels: frame spectra, which Spark cannot express, and vector drift, where
array expressions evaluated element by element cost fifty times a batched one.

A recording goes to Python once, as a slice of an Arrow buffer, and comes back as one small
row per frame. Each kernel is a few numpy calls on one recording; partitioning, exploding,
levels, deltas and pooling stay with Spark.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import signal as S
from .signal import SignalParams


def stack(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(np.float64, copy=False)


def signals(column: pa.Array) -> list[np.ndarray]:
    """The samples of every row as views of the batch's buffer; null rows are empty."""
    values = column.values.to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    empty = values[:0]
    return [values[a:b] if ok else empty for a, b, ok in zip(offsets[:-1], offsets[1:], valid)]


def _lists(counts: list[int], values: pa.Array) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def frame_lists(matrices: list[np.ndarray]) -> pa.ListArray:
    """(frames, width) matrices as ``array<array<double>>``."""
    width = matrices[0].shape[1] if matrices else 0
    flat = np.concatenate([m.ravel() for m in matrices]) if matrices else np.empty(0)
    rows = sum(len(m) for m in matrices)
    return _lists([len(m) for m in matrices], _lists([width] * rows, pa.array(flat, pa.float64())))


def spectrogram(samples: Column, window: np.ndarray, hop: int, bands: np.ndarray | None = None) -> Column:
    """``array<array<double>>`` per recording: power of every centred frame, or of its ``bands``."""

    @F.arrow_udf("array<array<double>>")
    def run(column: pa.Array) -> pa.Array:
        powers = [S.power(x, window, hop) for x in signals(column)]
        return frame_lists(powers if bands is None else [p @ bands.T for p in powers])

    return run(samples)


MFCC_FAMILIES = ("mfcc", "mfcc_delta", "mfcc_delta2")


def cepstrum(samples: Column, params: SignalParams) -> Column:
    """Struct of three ``array<array<double>>``: MFCC of every centred frame and its deltas."""
    p = params
    window, bands = S.hann(p.mfcc_fft), S.mel_weights(p.sample_rate, p.mfcc_fft, p.mfcc_mels, 0.0)
    dct = S.dct_weights(p.n_mfcc, p.mfcc_mels)

    @F.arrow_udf("struct<" + ", ".join(f"{f}: array<array<double>>" for f in MFCC_FAMILIES) + ">")
    def run(column: pa.Array) -> pa.Array:
        plain = [S.cepstra(S.power(x, window, p.hop) @ bands.T, dct) for x in signals(column)]
        families = [plain, *[[S.deltas(c, w) for c in plain] for w in (S.SLOPE_WEIGHTS, S.CURVATURE_WEIGHTS)]]
        return pa.StructArray.from_arrays([frame_lists(f) for f in families], names=list(MFCC_FAMILIES))

    return run(samples)


MEASURES = ("spectral_centroid", "spectral_bandwidth", "spectral_rolloff", "spectral_flatness", "zcr", "rms", "ste")
MEASURE_TYPE = (
    "array<struct<" + ", ".join(f"{m}: double" for m in MEASURES) + ", peaks: array<double>, valleys: array<double>>>"
)


def frame_measures(samples: Column, params: SignalParams) -> Column:
    """One struct per centred frame: spectral shape, level, crossings, band extremes.

    ``ste`` belongs to uncentred frames, of which there are fewer; the rest are null.
    """
    p = params
    window = S.hann(p.n_fft)
    slices = S.contrast_slices(p.sample_rate, p.n_fft, p.contrast_bands, p.contrast_fmin)

    @F.arrow_udf(MEASURE_TYPE)
    def run(column: pa.Array) -> pa.Array:
        counts, scalars, extremes = [], [], []
        for x in signals(column):
            power = S.power(x, window, p.hop)
            shape = S.spectral_shape(power, p.sample_rate / p.n_fft)
            levels = S.frame_levels(x, len(power), p)
            counts.append(len(power))
            scalars.append(np.column_stack([*shape, *levels]))
            extremes.append(S.band_extremes(power, slices))
        table = np.concatenate(scalars) if scalars else np.empty((0, len(MEASURES)))
        sides = np.concatenate(extremes, axis=1) if extremes else np.empty((2, 0, len(slices)))
        columns = [pa.array(table[:, i], mask=np.isnan(table[:, i])) for i in range(len(MEASURES))]
        lists = [_lists([len(slices)] * len(table), pa.array(np.ascontiguousarray(side).ravel())) for side in sides]
        return _lists(counts, pa.StructArray.from_arrays([*columns, *lists], names=[*MEASURES, "peaks", "valleys"]))

    return run(samples)


def harmonic_energies(samples: Column, params: SignalParams) -> Column:
    """struct<harmonic_energy, percussive_energy> of every recording."""
    n_fft, hop, kernel = params.hpss_fft, params.hop, params.hpss_kernel

    @F.arrow_udf("struct<harmonic_energy: double, percussive_energy: double>")
    def run(column: pa.Array) -> pa.Array:
        parts = [S.split_energies(x.astype(np.float64), n_fft, hop, kernel) for x in signals(column)]
        sides = np.array(parts, dtype=np.float64).reshape(-1, 2).T
        return pa.StructArray.from_arrays([pa.array(s) for s in sides], names=["harmonic_energy", "percussive_energy"])

    return run(samples)


DRIFT_METRICS = (
    "euclidean_distance",
    "manhattan_distance",
    "cosine_similarity",
    "norm_euclidean_distance",
    "norm_manhattan_distance",
    "norm_cosine_similarity",
)


def drift_metrics(
    vector: Column, mean: Column, std: Column, norm_floor: float = 0.0, unit_fallback: bool = False
) -> Column:
    """Struct of the six drift metrics of a vector against its profile's mean and std.

    All three arrays of a row have one length. Dimensions with a std below the floor count
    as undeviating, or, with ``unit_fallback``, those with a zero std are divided by one.
    """

    @F.arrow_udf("struct<" + ", ".join(f"{m}: double" for m in DRIFT_METRICS) + ">")
    def run(v: pa.Array, mu: pa.Array, sd: pa.Array) -> pa.Array:
        lengths = np.diff(v.offsets.to_numpy())
        out = np.empty((len(DRIFT_METRICS), len(v)))
        for d in np.unique(lengths):
            rows = np.flatnonzero(lengths == d)
            picked = (v, mu, sd) if len(rows) == len(v) else [c.take(pa.array(rows)) for c in (v, mu, sd)]
            out[:, rows] = S.vector_drift(*[_matrix(c, d) for c in picked], norm_floor, unit_fallback)
        return pa.StructArray.from_arrays([pa.array(o) for o in out], names=list(DRIFT_METRICS))

    return run(vector, mean, std)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
