"""Recordings of any length, as rows of consecutive chunks.

A chunk is ``(key columns, start, samples)``: ``start`` counts the recording's samples before it, and
chunks may have any length. Frames, spectra and deltas need their neighbourhood, so chunks are dealt
anew to cells of a fixed size, and every cell also gets the halo it needs: the last samples before it
and the first ones after it. That is one shuffle of the samples for any chunk length; a recording
of a day is spread over as many tasks as it has cells, and no task holds more than a few cells.

A frame belongs to the cell its first sample (centre, if centred) lies in, so every frame is made once, and with its halo
equals the frame cut from the whole recording. What depends on the whole recording, the loudest
band that floors the levels, is one small row per recording, joined back by its checked size.

Results are one row per frame. A recording's chunks must not overlap or leave gaps; ``chunk_violations``
lists those that do, and ``sound_chunks`` leaves their recordings out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import signal as S
from ..functions.kernels import frame_lists, signals
from ..functions.scale import bounded_join, materialize
from ..functions.signal import SignalParams
from ..functions.vectors import scaled_down
from .preprocess import SILENCE_PEAK, decibel, mel_weights_of, peak

CELL_FRAMES = 512
BORDER = S.DELTA_WIDTH - 1  # frames on each side that the deltas at a recording's ends look at


def cut_chunks(waves: DataFrame, keys: list[str], size: int) -> DataFrame:
    """(keys, start, samples) of whole recordings, in chunks of ``size`` samples."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("samples") - 1, F.lit(0)), F.lit(size))
    pieces = F.transform(
        starts, lambda a: F.struct(a.cast("long").alias("start"), F.slice("samples", a + 1, size).alias("samples"))
    )
    kept = F.when(F.size("samples") > 0, pieces)
    return waves.select(*keys, F.explode(kept).alias("_c")).select(*keys, "_c.*")


def chunk_violations(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, violation): chunks that do not continue where another one of their recording ends.

    Only keys and positions are shuffled.
    """
    spans = chunks.select(*keys, "start", F.size("samples").alias("_n"))
    ends = spans.where("_n > 0").select(*[F.col(k).alias(f"_{k}") for k in keys], (F.col("start") + F.col("_n")).alias("_end"))
    same = F.col("start") == F.col("_end")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    loose = (
        spans.where("start <> 0 AND _n > 0")
        .join(ends, same, "left_anti")
        .select(*keys, "start", F.lit("gap or overlap before the chunk").alias("violation"))
    )
    twice = spans.where("_n > 0").groupBy(*keys, "start").count().where("count > 1")
    return loose.unionByName(twice.select(*keys, "start", F.lit("start is not unique").alias("violation")))


def sound_chunks(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """The chunks of recordings without a violation."""
    broken = chunk_violations(chunks, keys).select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return chunks.join(broken, same, "left_anti")


def cells(chunks: DataFrame, keys: list[str], size: int, before: int, after: int) -> DataFrame:
    """(keys, cell, first, x): the samples of [cell * size - before, (cell + 1) * size + after), from sample ``first`` on.

    A cell that has only a halo still gets a row: a frame may be centred just behind the last sample.
    """
    a = F.col("start")
    b = a + F.size("samples")
    low = F.greatest(F.lit(0), F.floor((a - after) / size))
    high = F.floor((b + (before - 1)) / size)

    def piece(cell: Column) -> Column:
        at = F.greatest(a, cell * size - before)
        upto = F.least(b, (cell + 1) * size + after)
        return F.struct(
            cell.alias("cell"),
            F.struct(
                at.alias("first"), F.slice("samples", (at - a + 1).cast("int"), F.greatest(upto - at, F.lit(0)).cast("int")).alias("x")
            ).alias("piece"),
        )

    held = chunks.where(F.size("samples") > 0).withColumn("samples", F.col("samples").cast("array<double>"))
    dealt = held.select(*keys, F.inline(F.transform(F.sequence(low, high), piece)))
    whole = dealt.where(F.size("piece.x") > 0).groupBy(*keys, "cell").agg(F.sort_array(F.collect_list("piece")).alias("_p"))
    return whole.select(*keys, "cell", F.get("_p", F.lit(0))["first"].alias("first"), F.flatten("_p.x").alias("x"))


def cell_frames(x: np.ndarray, first: int, low: int, high: int, length: int, hop: int, centred: bool) -> np.ndarray:
    """Frames ``low`` to ``high - 1`` of a recording, those it has, from its samples ``x`` at ``first``.

    ``x`` reaches far enough for all of them, or ends with the recording; missing samples are zeros.
    """
    end = first + len(x)
    if not centred:
        high = min(high, (end - length) // hop + 1 if end >= length else 0)
    else:
        high = min(high, end // hop + 1)
    low = max(0, low)
    if high <= low:
        return np.empty((0, length))
    start = low * hop - (length // 2 if centred else 0)
    whole = np.zeros((high - low - 1) * hop + length)
    a, b = max(start, first), min(start + len(whole), end)
    if b > a:
        whole[a - start : b - start] = x[a - first : b - first]
    return S.framed(whole, length, hop)


def framed_rows(dealt: DataFrame, keys: list[str], name: str, kernel, width: str = "double") -> DataFrame:
    """(keys, frame, ``name``): rows that ``kernel(x, first, cell)`` gives as (first frame, matrix), one per frame."""

    @F.arrow_udf(f"struct<low: long, rows: array<array<{width}>>>")
    def run(x: pa.Array, first: pa.Array, cell: pa.Array) -> pa.Array:
        made = [kernel(*row) for row in zip(signals(x), first.to_pylist(), cell.to_pylist(), strict=True)]
        lows = pa.array([low for low, _ in made], pa.int64())
        return pa.StructArray.from_arrays([lows, frame_lists([rows for _, rows in made])], names=["low", "rows"])

    made = dealt.select(*keys, run("x", "first", "cell").alias("_f"))
    rows = made.select(*keys, "_f.low", F.posexplode("_f.rows").alias("_i", name))
    return rows.select(*keys, (F.col("low") + F.col("_i")).alias("frame"), name)


def frames(
    chunks: DataFrame, keys: list[str], length: int, hop: int, centred: bool = True, cell_frames_n: int = CELL_FRAMES
) -> DataFrame:
    """(keys, frame, x): fixed-length frames of recordings in chunks."""
    n = cell_frames_n
    half = length // 2 if centred else 0
    dealt = cells(chunks, keys, n * hop, max(1, half), length)

    def kernel(x: np.ndarray, first: int, cell: int) -> tuple[int, np.ndarray]:
        return cell * n, cell_frames(x, first, cell * n, (cell + 1) * n, length, hop, centred)

    return framed_rows(dealt, keys, "x", kernel)


def power_frames(
    chunks: DataFrame, keys: list[str], n_fft: int, hop: int, bands: np.ndarray | None = None, cell_frames_n: int = CELL_FRAMES
) -> DataFrame:
    """(keys, frame, power): Hann-windowed power spectrum of centred frames, or its ``bands``."""
    n, window = cell_frames_n, S.hann(n_fft)
    dealt = cells(chunks, keys, n * hop, max(1, n_fft // 2), n_fft)

    def kernel(x: np.ndarray, first: int, cell: int) -> tuple[int, np.ndarray]:
        power = S.frame_power(cell_frames(x, first, cell * n, (cell + 1) * n, n_fft, hop, True), window)
        return cell * n, power if bands is None else power @ bands.T

    return framed_rows(dealt, keys, "power", kernel)


def resample(
    chunks: DataFrame, keys: list[str], rate: int, target: int, cell_samples: int = CELL_FRAMES * 512
) -> DataFrame:
    """(keys, start, samples) at ``target`` Hz of recordings at ``rate`` Hz, in chunks that follow the cells.

    The filter of an output reaches into the neighbouring cells, which the halo holds.
    """
    if rate == target:
        return chunks.select(*keys, "start", F.col("samples").cast("array<double>").alias("samples"))
    up, down, taps = S.resampling(rate, target)
    half = taps.shape[1] // 2
    dealt = cells(chunks, keys, cell_samples, half + 1, half + 2)

    @F.arrow_udf("struct<start: long, samples: array<double>>")
    def run(x: pa.Array, first: pa.Array, cell: pa.Array) -> pa.Array:
        lows, out = [], []
        for own, a, c in zip(signals(x), first.to_pylist(), cell.to_pylist(), strict=True):
            low, high = -(-c * cell_samples * up // down), -(-(c + 1) * cell_samples * up // down)
            high = min(high, -(-(a + len(own)) * up // down))  # the recording ends here, or after the halo
            lows.append(low)
            out.append(S.resampled(own, a, rate, target, low, high))
        offsets = pa.array(np.cumsum([0, *map(len, out)]).astype(np.int32))
        values = pa.array(np.concatenate(out) if out else np.empty(0))
        return pa.StructArray.from_arrays([pa.array(lows, pa.int64()), pa.ListArray.from_arrays(offsets, values)], names=["start", "samples"])

    made = dealt.select(*keys, run("x", "first", "cell").alias("_r")).select(*keys, "_r.*")
    return made.where(F.size("samples") > 0)


def harmonic_energies(
    chunks: DataFrame, keys: list[str], n_fft: int, hop: int, kernel: int, cell_frames_n: int = CELL_FRAMES
) -> DataFrame:
    """(keys, harmonic_energy, percussive_energy): mean squares of the two parts of recordings in chunks.

    A cell splits the frames that its samples lie in. The median along time looks at half a kernel of
    frames on either side, and mirrors only at the recording's own ends. Sums meet per recording.
    """
    n, reach = cell_frames_n, kernel // 2 + n_fft // hop + 1  # in frames
    samples = (reach + 1) * hop + n_fft
    dealt = cells(chunks, keys, n * hop, samples, samples)

    @F.arrow_udf("struct<n: long, harmonic: double, percussive: double>")
    def run(x: pa.Array, first: pa.Array, cell: pa.Array) -> pa.Array:
        rows = []
        for own, a, c in zip(signals(x), first.to_pylist(), cell.to_pylist(), strict=True):
            low, high = c * n * hop, min((c + 1) * n * hop, a + len(own))
            if high <= low:
                rows.append((0, 0.0, 0.0))
                continue
            begin = max(0, c * n - reach)
            frames = cell_frames(own, a, begin, (c + 1) * n + reach, n_fft, hop, True)
            origin = begin * hop - n_fft // 2  # sample of the split signals' first value
            kept = S.split_signals(frames, n_fft, hop, kernel)[:, low - origin : high - origin]
            rows.append((high - low, *(float(e) for e in (kept**2).sum(axis=1))))
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        return pa.StructArray.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.float64(), pa.float64()), strict=True)],
            names=["n", "harmonic", "percussive"],
        )

    sums = dealt.select(*keys, run("x", "first", "cell").alias("_e")).select(*keys, "_e.*").groupBy(*keys)
    whole = sums.agg(F.sum("n").alias("n"), F.sum("harmonic").alias("h"), F.sum("percussive").alias("p")).where("n > 0")
    return whole.select(
        *keys, (F.col("h") / F.col("n")).alias("harmonic_energy"), (F.col("p") / F.col("n")).alias("percussive_energy")
    )


def with_top(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """``rows`` with the largest ``value`` of their recording as ``name``; null keys have one of their own."""
    held = materialize(rows.withColumn("_key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})), name.strip("_"))
    tops = materialize(held.groupBy("_key").agg(F.max(value).alias(name)), f"{name.strip('_')}_tops")
    joined = bounded_join(held, tops, ["_key"], [F.col(c) for c in rows.columns[len(keys) : len(keys) + 1]], F.octet_length("_key") + 8)
    return joined.drop("_key")


def normalize(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, samples): samples divided by the recording's largest absolute one, unless it is silent."""
    peaked = with_top(chunks.select(*keys, "start", "samples"), keys, peak(F.col("samples")), "_peak")
    divisor = F.when(F.col("_peak") < SILENCE_PEAK, 1.0).otherwise(F.col("_peak"))
    return peaked.select(*keys, "start", scaled_down(F.col("samples").cast("array<double>"), divisor).alias("samples"))


def log_mel(chunks: DataFrame, keys: list[str], params: SignalParams, cell_frames_n: int = CELL_FRAMES) -> DataFrame:
    """(keys, frame, mel): band power in dB relative to the recording's loudest band."""
    melled = power_frames(chunks, keys, params.n_fft, params.hop, mel_weights_of(params), cell_frames_n)
    topped = with_top(melled, keys, F.array_max("power"), "_top")
    levels = F.transform("power", lambda p: F.greatest(decibel(p) - decibel(F.col("_top")), F.lit(-S.TOP_DB)))
    return topped.select(*keys, "frame", levels.alias("mel"))


def cepstral_frames(
    chunks: DataFrame, keys: list[str], params: SignalParams, cell_frames_n: int = CELL_FRAMES
) -> DataFrame:
    """(keys, frame, mfcc, mfcc_delta, mfcc_delta2) of every centred frame; deltas are null in recordings of under nine frames.

    A cell also makes the band levels of the eight frames on either side, so that deltas at its borders, and
    those that repeat the first or last full window of the recording, see what they need.
    """
    p, n = params, cell_frames_n
    window, bands = S.hann(p.mfcc_fft), S.mel_weights(p.sample_rate, p.mfcc_fft, p.mfcc_mels, 0.0)
    reach = (BORDER + 1) * p.hop + p.mfcc_fft
    dealt = cells(chunks, keys, n * p.hop, reach, reach)

    @F.arrow_udf("struct<low: long, ended: boolean, levels: array<array<double>>>")
    def levelled(x: pa.Array, first: pa.Array, cell: pa.Array) -> pa.Array:
        lows, ended, levels = [], [], []
        for own, a, c in zip(signals(x), first.to_pylist(), cell.to_pylist(), strict=True):
            low, high = max(0, c * n - BORDER), (c + 1) * n + BORDER
            power = S.frame_power(cell_frames(own, a, low, high, p.mfcc_fft, p.hop, True), window)
            lows.append(low)
            ended.append(len(power) < high - low)  # so its last frame is the recording's last
            levels.append(10.0 * np.log10(np.maximum(S.AMIN, power @ bands.T)))
        return pa.StructArray.from_arrays(
            [pa.array(lows, pa.int64()), pa.array(ended, pa.bool_()), frame_lists(levels)], names=["low", "ended", "levels"]
        )

    made = dealt.select(*keys, "cell", levelled("x", "first", "cell").alias("_l")).select(*keys, "cell", "_l.*")
    topped = with_top(made, keys, F.array_max(F.transform("levels", lambda r: F.array_max(r))), "_top")
    dct = S.dct_weights(p.n_mfcc, p.mfcc_mels)
    families = ("mfcc", "mfcc_delta", "mfcc_delta2")

    @F.arrow_udf("array<struct<" + ", ".join(f"{f}: array<double>" for f in families) + ">>")
    def cepstrum(levels: pa.Array, low: pa.Array, ended: pa.Array, cell: pa.Array, top: pa.Array) -> pa.Array:
        counts, columns = [], {f: [] for f in families}
        meta = zip(low.to_pylist(), ended.to_pylist(), cell.to_pylist(), top.to_pylist(), strict=True)
        for i, (a, last, c, loudest) in enumerate(meta):
            rows = levels[i].values
            table = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, p.mfcc_mels)
            plain = np.maximum(table, (loudest if loudest is not None else 0.0) - S.TOP_DB) @ dct.T
            own = slice(c * n - a, (c + 1) * n - a)
            counts.append(len(plain[own]))
            columns["mfcc"].append(plain[own])
            for family, weights in zip(families[1:], (S.SLOPE_WEIGHTS, S.CURVATURE_WEIGHTS), strict=True):
                columns[family].append(edge_deltas(plain, weights, a == 0, last)[own])
        lists = [nullable_rows(columns[f], p.n_mfcc) for f in families]
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(lists, names=list(families)))

    done = topped.select(*keys, "cell", cepstrum("levels", "low", "ended", "cell", "_top").alias("_c"))
    rows = done.select(*keys, "cell", F.posexplode("_c").alias("_i", "_r"))
    return rows.select(*keys, (F.col("cell") * n + F.col("_i")).alias("frame"), *[f"_r.{f}" for f in families])


def edge_deltas(rows: np.ndarray, weights: list[float], at_start: bool, at_end: bool) -> np.ndarray:
    """Deltas of a stretch of frames; NaN where the window leaves it, except at the recording's own ends."""
    out = np.full_like(rows, np.nan)
    half, inner = S.DELTA_WIDTH // 2, len(rows) - S.DELTA_WIDTH + 1
    if inner < 1:
        return out
    fitted = sum(w * rows[k : k + inner] for k, w in enumerate(weights))
    out[half : half + inner] = fitted
    if at_start:
        out[:half] = fitted[0]
    if at_end:
        out[half + inner :] = fitted[-1]
    return out


def nullable_rows(matrices: list[np.ndarray], width: int) -> pa.Array:
    """Rows of all matrices as lists; a row of NaN is null."""
    flat = np.concatenate(matrices) if matrices else np.empty((0, width))
    offsets = pa.array(np.arange(0, flat.size + 1, width, dtype=np.int32))
    gone = pa.array(np.isnan(flat).any(axis=1))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(flat).ravel()), mask=gone)


def cepstral_statistics(cepstra: DataFrame, keys: list[str], params: SignalParams) -> DataFrame:
    """Mean and population deviation of every coefficient of every family, per recording with deltas.

    Partial sums meet per recording, so a recording of any length is a few rows per task.
    """
    families = ("mfcc", "mfcc_delta", "mfcc_delta2")
    each = {
        f"{f}_{i}_{s}": stat(F.get(f, F.lit(i)))
        for f in families
        for s, stat in (("mean", F.avg), ("std", F.stddev_pop))
        for i in range(params.n_mfcc)
    }
    complete = cepstra.where(F.col("mfcc_delta").isNotNull())
    return complete.groupBy(*keys).agg(*[c.alias(name) for name, c in each.items()])
