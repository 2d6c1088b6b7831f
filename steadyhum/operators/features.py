"""Signal features per recording, in one narrow pass.

A recording is one row and stays one: Arrow kernels turn its samples into one small row per
frame, kept as nested arrays, and array expressions derive dB levels and pooled statistics
from them. Nothing is exploded or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signal as S
from ..functions.kernels import MFCC_FAMILIES, cepstrum, frame_measures, harmonic_energies
from ..functions.signal import SignalParams
from ..functions.vectors import let, scaled_down
from .preprocess import decibel

SPECTRAL_SCALARS = ("spectral_centroid", "spectral_bandwidth", "spectral_rolloff", "spectral_flatness", "zcr")
TEMPORAL = ("rms_mean", "rms_std", "rms_max", "ste_mean", "ste_std", "dynamic_range_db")
HARMONIC = ("harmonic_energy", "percussive_energy", "harmonic_ratio")


def feature_names(params: SignalParams) -> list[str]:
    """Names in vector order: MFCC families, spectral, temporal, harmonic."""
    names = []
    for family in MFCC_FAMILIES:
        for stat in ("mean", "std"):
            names += [f"{family}_{i}_{stat}" for i in range(params.n_mfcc)]
    bands = [f"spectral_contrast_band{b}" for b in range(params.contrast_bands + 1)]
    names += [f"{s}_{stat}" for s in (*SPECTRAL_SCALARS, *bands) for stat in ("mean", "std")]
    return [*names, *TEMPORAL, *HARMONIC]


def cepstral_frames(waves: DataFrame, keys: list[str], params: SignalParams) -> DataFrame:
    """(keys, mfcc, mfcc_delta, mfcc_delta2): one row per recording, one element per frame."""
    families = cepstrum(F.col("samples"), params)
    return waves.select(*keys, families.alias("_c")).select(*keys, "_c.*")


def _floored(values: Column, top_db: Column) -> Column:
    """dB of every value, not lower than ``TOP_DB`` below the recording's top."""
    return F.transform(values, lambda v: F.greatest(decibel(v), top_db - S.TOP_DB))


def measured(waves: DataFrame, keys: list[str], params: SignalParams) -> DataFrame:
    """(keys, mfcc families, measures, split): all frame rows of a recording as nested arrays.

    One Arrow pass over the samples; the recording stays one row.
    """
    x = F.col("samples")
    kernels = waves.select(
        *keys,
        cepstrum(x, params).alias("_c"),
        frame_measures(x, params).alias("measures"),
        harmonic_energies(x, params).alias("split"),
    )
    return kernels.select(*keys, "_c.*", "measures", "split")


def contrast_rows(measures: str) -> Column:
    """Peak minus valley in dB per frame and band, both floored below the recording's top."""

    def top(side: str) -> Column:
        return decibel(F.array_max(F.transform(f"{measures}.{side}", lambda f: F.array_max(f))))

    def rows(tops: Column) -> Column:
        return F.zip_with(
            f"{measures}.peaks",
            f"{measures}.valleys",
            lambda p, v: F.zip_with(_floored(p, tops["p"]), _floored(v, tops["v"]), lambda a, b: a - b),
        )

    return let(F.struct(top("peaks").alias("p"), top("valleys").alias("v")), rows)


def mean_std(rows: Column, width: int) -> Column:
    """struct<mean, std> over the frames of ``array<array<double>>``, null without frames; std is of the population."""
    zero = F.array_repeat(F.lit(0.0), F.lit(width))
    n = F.size(rows).cast("double")

    def summed(of: Callable[[Column], Column]) -> Column:
        return F.aggregate(rows, zero, lambda acc, row: F.zip_with(acc, of(row), lambda a, b: a + b))

    def spread(mean: Column) -> Column:
        squares = summed(lambda row: F.zip_with(row, mean, lambda x, m: (x - m) * (x - m)))
        deviations = F.zip_with(squares, F.array_repeat(n, width), lambda s, k: F.sqrt(s / k))
        return F.struct(mean.alias("mean"), deviations.alias("std"))

    return F.when(F.size(rows) > 0, let(scaled_down(summed(lambda row: row), n), spread))


def pooled(recordings: DataFrame, keys: list[str], params: SignalParams) -> DataFrame:
    """Every feature as a named column, in vector order, from the nested arrays of ``measured``."""
    p = params
    bands = [f"spectral_contrast_band{b}" for b in range(p.contrast_bands + 1)]
    scalars = [*SPECTRAL_SCALARS, "rms"]
    rows = {
        "_shape": F.transform("measures", lambda f: F.array(*[f[m] for m in scalars])),
        "_bands": contrast_rows("measures"),
        "_ste": F.transform(F.filter("measures.ste", lambda e: e.isNotNull()), lambda e: F.array(e)),
    }
    widths = dict.fromkeys(MFCC_FAMILIES, p.n_mfcc) | {"_shape": len(scalars), "_bands": len(bands), "_ste": 1}
    loud, soft = F.array_max("measures.rms"), F.array_min("measures.rms")
    statistics = recordings.withColumns(rows).select(
        *keys,
        "split.*",
        F.size("mfcc").alias("n_frames"),
        *[mean_std(F.col(c), width).alias(c) for c, width in widths.items()],
        loud.alias("rms_max"),
        F.least(F.lit(S.TOP_DB), decibel(loud * loud) - decibel(soft * soft)).alias("dynamic_range_db"),
    )
    places = {f"{f}_{i}": (f, i) for f in MFCC_FAMILIES for i in range(p.n_mfcc)}
    places |= {name: ("_shape", i) for i, name in enumerate(scalars)}
    places |= {name: ("_bands", i) for i, name in enumerate(bands)} | {"ste": ("_ste", 0)}
    both = F.col("harmonic_energy") + F.col("percussive_energy")
    columns = {f"{n}_{s}": F.get(F.col(f"{c}.{s}"), F.lit(i)) for n, (c, i) in places.items() for s in ("mean", "std")}
    columns |= {n: F.col(n) for n in ("rms_max", "dynamic_range_db", "harmonic_energy", "percussive_energy")}
    columns["harmonic_ratio"] = F.when(both > S.AMIN, F.col("harmonic_energy") / both).otherwise(0.0)
    return statistics.select(*keys, "n_frames", *[columns[n].alias(n) for n in feature_names(p)])


def too_short(waves: DataFrame, params: SignalParams) -> DataFrame:
    """Recordings without enough frames for the delta features, or shorter than one frame."""
    n_frames = F.floor(F.size("samples") / params.hop) + 1
    size = F.size("samples")
    reason = F.when(size < params.n_fft, "shorter than one frame").when(
        n_frames < S.DELTA_WIDTH, "too few frames for deltas"
    )
    return waves.select("*", n_frames.alias("n_frames"), reason.alias("violation")).drop("samples").where(
        F.col("violation").isNotNull()
    )


def long_enough(waves: DataFrame, params: SignalParams) -> DataFrame:
    size = F.size("samples")
    return waves.where((size >= params.n_fft) & (F.floor(size / params.hop) + 1 >= S.DELTA_WIDTH))


def extract(
    waves: DataFrame, keys: list[str], params: SignalParams | None = None, complete: bool = True
) -> DataFrame:
    """All features as named columns, in vector order, one row per recording, without a shuffle.

    Recordings in ``too_short`` give no row. Without ``complete`` every recording with a sample
    gives one, with nulls where a family needs more: nine frames for the deltas, one uncentred
    frame for the short-time energy.
    """
    p = params or SignalParams()
    fit = long_enough(waves, p) if complete else waves.where(F.size("samples") > 0)
    return pooled(measured(fit, keys, p), keys, p).drop("n_frames")


def feature_vector(features: DataFrame, names: list[str]) -> DataFrame:
    """Replace the named columns by ``feature_names`` and ``feature_vector`` (float)."""
    if not names:
        raise ValueError("no features to build a vector from")
    rest = [c for c in features.columns if c not in set(names)]
    return features.select(
        *rest,
        F.lit(names).alias("feature_names"),
        F.array(*[F.col(n) for n in names]).cast("array<float>").alias("feature_vector"),
    )
