"""Recordings in chunks against the same recordings as one row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadyhum.functions import signal as S
from steadyhum.functions.signal import SignalParams
from steadyhum.operators import chunked as C
from steadyhum.operators import preprocess as P
from steadyhum.operators.features import cepstral_frames

PARAMS = SignalParams(n_fft=32, hop=16, n_mels=8, n_mfcc=5, mfcc_fft=64, mfcc_mels=8)
LENGTHS = [0, 1, 15, 16, 17, 31, 32, 33, 127, 128, 129, 143, 144, 160, 161, 500, 800, 801]


@pytest.fixture(scope="module")
def waves(spark):
    r = np.random.default_rng(0)
    rows = [(f"r{n}", n, (r.normal(size=n) * 10.0 ** (n % 3 - 1)).tolist()) for n in LENGTHS]
    rows += [("silent", 300, [0.0] * 300), (None, 200, r.normal(size=200).tolist())]
    return spark.createDataFrame(rows, "name string, n int, samples array<double>").cache()


def values(df, column):
    return {(r.name, r.frame): r[column] for r in df.select("name", "frame", column).collect()}


def same(got, want, tolerance=1e-9):
    assert got.keys() == want.keys()
    for key, v in want.items():
        assert (got[key] is None) == (v is None)
        if v is not None:
            np.testing.assert_allclose(got[key], v, rtol=tolerance, atol=tolerance)


@pytest.mark.parametrize("centred", [True, False])
@pytest.mark.parametrize("length, hop", [(32, 16), (64, 16), (10, 16)])
def test_frames_equal_those_of_whole_recordings(waves, centred, length, hop):
    want = values(P.frames(waves.select("name", "samples"), length, hop, centred), "x")
    for size, cell in ((1, 1), (7, 3), (100, 4), (10_000, 512)):
        chunks = C.cut_chunks(waves, ["name"], size).repartition(3)
        same(values(C.frames(chunks, ["name"], length, hop, centred, cell), "x"), want, 0)


@pytest.mark.parametrize("size, cell", [(1, 2), (50, 3), (333, 9), (10_000, 512)])
def test_spectra_levels_and_deltas_equal_those_of_whole_recordings(waves, size, cell):
    chunks = C.cut_chunks(waves, ["name"], size)
    whole = waves.select("name", "samples")
    same(values(C.power_frames(chunks, ["name"], 32, 16, cell_frames_n=cell), "power"), values(P.power_frames(whole, 32, 16), "power"))
    same(values(C.log_mel(chunks, ["name"], PARAMS, cell), "mel"), values(P.log_mel(whole, PARAMS), "mel"))
    got = C.cepstral_frames(chunks, ["name"], PARAMS, cell).cache()
    want = cepstral_frames(whole, ["name"], PARAMS).cache()
    for family in ("mfcc", "mfcc_delta", "mfcc_delta2"):
        rows = want.select("name", F.posexplode(family).alias("frame", family))
        own = got if family == "mfcc" else got.where(f"{family} is not null")
        same(values(own, family), values(rows, family), 1e-8)
    short = {r.name for r in got.where("mfcc_delta is null").select("name").distinct().collect()}
    assert short == {f"r{n}" for n in LENGTHS if 0 < n and n // 16 + 1 < 9}


def test_chunks_of_mixed_lengths_and_clashing_columns(spark, waves):
    pieces = [(0, 10), (10, 11), (11, 300), (300, 300), (300, 800)]
    whole = {r.name: r.samples for r in waves.where("name = 'r800'").collect()}["r800"]
    rows = [("r800", a, whole[a:b], 1, "x") for a, b in pieces]
    chunks = spark.createDataFrame(rows, "name string, start long, samples array<double>, cell int, frame string")
    want = {k: v for k, v in values(P.frames(waves.select("name", "samples"), 32, 16), "x").items() if k[0] == "r800"}
    same(values(C.frames(chunks, ["name"], 32, 16, cell_frames_n=6), "x"), want, 0)


def test_gaps_overlaps_and_repeats_are_listed(spark):
    rows = [("ok", 0, 5), ("ok", 5, 5), ("gap", 0, 5), ("gap", 6, 5), ("late", 3, 5), ("twice", 0, 5), ("twice", 0, 5),
            ("over", 0, 5), ("over", 4, 5), ("empty", 0, 0), (None, 0, 2), (None, 2, 2)]
    chunks = spark.createDataFrame([(k, a, [1.0] * n) for k, a, n in rows], "name string, start long, samples array<double>")
    found = {(r.name, r.start, r.violation.split()[0]) for r in C.chunk_violations(chunks, ["name"]).collect()}
    assert found == {("gap", 6, "gap"), ("late", 3, "gap"), ("twice", 0, "start"), ("over", 4, "gap")}
    kept = {r.name for r in C.sound_chunks(chunks, ["name"]).collect()}
    assert kept == {"ok", "empty", None}


def test_one_long_recording_is_spread_over_tasks(spark):
    chunks = spark.range(400).select(
        F.lit("long").alias("name"), (F.col("id") * 1000).alias("start"), F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.sin(i.cast("double"))).alias("samples")
    )
    framed = C.frames(chunks, ["name"], 32, 16, cell_frames_n=200)
    parts = framed.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == 400_000 // 16 + 1
    assert framed.agg(F.count_distinct("frame")).first()[0] == 400_000 // 16 + 1


def test_no_recordings(waves):
    none = C.cut_chunks(waves.where("false"), ["name"], 10)
    assert C.cepstral_frames(none, ["name"], PARAMS).count() == 0 and C.log_mel(none, ["name"], PARAMS).count() == 0


@pytest.mark.parametrize("rate, target", [(8000, 16000), (44100, 16000), (16000, 16000), (48000, 16000), (11025, 16000)])
@pytest.mark.parametrize("size, cell", [(1, 40), (97, 64), (10_000, 10_000)])
def test_resampling_in_blocks_equals_one_shot(waves, rate, target, size, cell):
    whole = {r.name: np.array(r.samples) for r in waves.collect()}
    some = waves.where("n in (1, 33, 500, 801)")
    rows = C.resample(C.cut_chunks(some, ["name"], size), ["name"], rate, target, cell).collect()
    got = {}
    for r in sorted(rows, key=lambda r: r.start):
        own = got.setdefault(r.name, [])
        assert r.start == len(own)
        own.extend(r.samples)
    assert got.keys() == {"r1", "r33", "r500", "r801"}
    for name, own in got.items():
        np.testing.assert_allclose(own, S._resample(whole[name], rate, target), atol=1e-9)


@pytest.mark.parametrize("size, cell", [(7, 1), (100, 4), (10_000, 512)])
def test_harmonic_split_in_cells_equals_that_of_whole_recordings(waves, size, cell):
    got = {r.name: (r.harmonic_energy, r.percussive_energy) for r in C.harmonic_energies(C.cut_chunks(waves, ["name"], size), ["name"], 32, 16, 9, cell).collect()}
    want = {r.name: S.split_energies(np.array(r.samples), 32, 16, 9) for r in waves.where("n > 0").collect()}
    assert got.keys() == want.keys()
    for name in want:
        np.testing.assert_allclose(got[name], want[name], rtol=1e-9, atol=1e-15)
