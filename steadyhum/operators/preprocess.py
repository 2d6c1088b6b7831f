"""Signal preprocessing. A recording is one row of the waves table:
``(key columns, sample_rate, samples array<double>)``. Its size is bounded by one file, and
everything up to the spectrogram happens inside that row, without a shuffle.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import spectrogram
from ..functions.signal import AMIN, TOP_DB, SignalParams, hann, mel_weights, resample
from ..functions.vectors import let, scaled_down

# Recordings quieter than this are left alone; the encoder's sample rate.
SILENCE_PEAK = 1e-9
TARGET_RATE = 16000


def downmix(channels: Column) -> Column:
    """Mean over ``array<array<double>>`` channels of equal length."""
    added = F.aggregate(
        F.slice(channels, F.lit(2), F.greatest(F.size(channels) - 1, F.lit(0))),
        F.get(channels, F.lit(0)),
        lambda acc, ch: F.zip_with(acc, ch, lambda x, y: x + y),
    )
    return scaled_down(added, F.size(channels).cast("double"))


def resample_waves(waves: DataFrame, target: int = TARGET_RATE) -> DataFrame:
    """Bring every recording to ``target`` Hz; rows already there never leave the JVM."""
    right = waves.where(F.col("sample_rate") == target)
    wrong = waves.where(F.col("sample_rate") != target)
    moved = wrong.withColumns(
        {
            "samples": resample(F.col("samples"), F.col("sample_rate"), target).cast(waves.schema["samples"].dataType),
            "sample_rate": F.lit(target),
        }
    )
    return right.unionByName(moved)


def peak(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda acc, x: F.greatest(acc, F.abs(x).cast("double")))


def normalize(waves: DataFrame) -> DataFrame:
    """Divide by the largest absolute sample, unless the recording is silent."""
    samples = F.col("samples").cast("array<double>")
    divisor = let(peak(F.col("samples")), lambda p: F.when(p < SILENCE_PEAK, 1.0).otherwise(p))
    return waves.withColumn("samples", scaled_down(samples, divisor))


def silent_recordings(waves: DataFrame) -> DataFrame:
    """Recordings whose peak is below the silence level."""
    peaked = waves.withColumn("peak", peak(F.col("samples"))).drop("samples")
    return peaked.where(F.col("peak") < SILENCE_PEAK)


def waveform_violations(waves: DataFrame, rate: int = TARGET_RATE) -> DataFrame:
    """Recordings the embedding model cannot take: not mono, not float, wrong rate."""
    kind = waves.schema["samples"].dataType.elementType.simpleString()
    reason = F.array_compact(
        F.array(
            F.when(F.col("channels") != 1, "not mono"),
            F.lit(None if kind == "float" else f"samples are {kind}").cast("string"),
            F.when(F.col("sample_rate") != rate, F.concat(F.lit("rate is "), F.col("sample_rate").cast("string"))),
        )
    )
    return waves.drop("samples").select("*", F.explode(reason).alias("violation"))


def padded(samples: Column, length: int, edge: bool = False) -> Column:
    """Half a frame on both sides: zeros, or the first and last sample."""
    half = F.lit(length // 2)
    before = F.get(samples, F.lit(0)) if edge else F.lit(0.0)
    after = F.element_at(samples, -1) if edge else F.lit(0.0)
    return F.concat(F.array_repeat(before, half), samples, F.array_repeat(after, half))


def frame_count(samples: Column, length: int, hop: int, centred: bool = True) -> Column:
    """Number of frames; 0 when there is not enough signal for one."""
    size = F.size(samples) + (2 * (length // 2) if centred else 0)
    enough = (F.size(samples) > 0) & (size >= length)
    return F.when(enough, F.floor((size - length) / hop).cast("int") + 1).otherwise(0)


def frames(waves: DataFrame, length: int, hop: int, centred: bool = True, edge: bool = False) -> DataFrame:
    """(keys, frame, x): fixed-length frames, no shuffle; too short recordings give none.

    The frames are cut before they are exploded: exploding frame numbers first would copy the
    whole recording into every frame's row.
    """
    samples = F.col("samples").cast("array<double>")
    count = frame_count(samples, length, hop, centred)

    def cut(whole: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.slice(whole, k * hop + 1, F.lit(length)))

    rows = F.when(count > 0, let(padded(samples, length, edge) if centred else samples, cut))
    return waves.select(*[c for c in waves.columns if c != "samples"], F.posexplode(rows).alias("frame", "x"))


def power_frames(waves: DataFrame, n_fft: int, hop: int) -> DataFrame:
    """(keys, frame, power): Hann-windowed power spectrum of centred frames."""
    kept = [c for c in waves.columns if c != "samples"]
    powered = waves.select(*kept, spectrogram(F.col("samples"), hann(n_fft), hop).alias("_p"))
    return powered.select(*kept, F.posexplode("_p").alias("frame", "power"))


def mel_weights_of(params: SignalParams) -> np.ndarray:
    return mel_weights(params.sample_rate, params.n_fft, params.n_mels, params.fmin)


def mel_spectrogram(waves: DataFrame, params: SignalParams) -> DataFrame:
    """(keys, mel): band power of every frame, one row per recording."""
    kept = [c for c in waves.columns if c != "samples"]
    bands = spectrogram(F.col("samples"), hann(params.n_fft), params.hop, mel_weights_of(params))
    return waves.select(*kept, bands.alias("mel"))


def decibel(x: Column) -> Column:
    return 10.0 * F.log10(F.greatest(F.lit(AMIN), x))


def decibel_to_peak(spectrum: Column) -> Column:
    """Power to dB relative to the recording's maximum, floored ``TOP_DB`` below it.

    The spectrogram is one nested array, so its maximum is known without regrouping frames.
    """
    peak_db = decibel(F.array_max(F.transform(spectrum, lambda f: F.array_max(f))))

    def level(top: Column) -> Column:
        return F.transform(
            spectrum, lambda f: F.transform(f, lambda p: F.greatest(decibel(p) - top, F.lit(-TOP_DB)))
        )

    return let(peak_db, level)


def log_mel(waves: DataFrame, params: SignalParams) -> DataFrame:
    """(keys, frame, mel): log-mel spectrogram relative to each recording's maximum."""
    melled = mel_spectrogram(waves, params)
    kept = [c for c in melled.columns if c != "mel"]
    return melled.select(*kept, F.posexplode(decibel_to_peak(F.col("mel"))).alias("frame", "mel"))


def prepare_waves(decoded: DataFrame, target: int = TARGET_RATE) -> DataFrame:
    """Decoded recordings without errors, at the target rate, peak normalised."""
    return normalize(resample_waves(decoded.where(F.col("error").isNull()).drop("error"), target))
