"""WAV files read by ranges against files decoded whole."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadyhum.sources import wav_ranges as R
from steadyhum.sources.wav import decode_wav
from tests.test_signal import wav_bytes


def bodies():
    r = np.random.default_rng(0)
    x = np.clip(r.normal(0, 0.3, 1000), -1, 1)
    mono = wav_bytes(x)
    out = {f"w{w}.wav": wav_bytes(x, width=w) for w in (1, 2, 3, 4)}
    out |= {f"c{c}.wav": wav_bytes(x[: 990 // c * c], channels=c, rate=44100) for c in (2, 3)}
    out |= {"empty.wav": b"", "text.wav": b"hello, this is no audio", "none.wav": wav_bytes([]), "tiny.wav": wav_bytes(x[:1])}
    out["cut.wav"] = mono[:-400]  # ends before the header says
    out["odd.wav"] = mono[:-401]  # within a sample
    out["header.wav"] = mono[:30]
    out["float.wav"] = mono[:20] + struct.pack("<H", 3) + mono[22:]
    out["width.wav"] = mono[:34] + struct.pack("<H", 40) + mono[36:]
    grown = mono[:4] + struct.pack("<I", len(mono) - 8 + 14) + mono[8:12]
    out["list.wav"] = grown + b"LIST" + struct.pack("<I", 5) + b"notes\0" + mono[12:]  # a chunk of odd length first
    out["late.wav"] = mono[:12] + mono[36:] + mono[12:36]
    return out


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = f"file:{tmp_path_factory.mktemp('wavs')}"
    rows = [(f"sub {i % 2}/{k}", v, i) for i, (k, v) in enumerate(bodies().items())]
    return folder, R.write_wavs(spark.createDataFrame(rows, "name string, content binary, extra int"), folder)


def joined(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r.start):
        key = r.path.rpartition("/")[2]
        n = sum(map(len, out.get(key, (0, 0, []))[2])) if key in out else 0
        assert r.start == n
        out.setdefault(key, (r.sample_rate, r.channels, []))[2].append(r.samples or [])
        assert (r.samples is None) == (r.error is not None)
    return {k: (a, b, np.concatenate(c).tolist()) for k, (a, b, c) in out.items()}


@pytest.mark.parametrize("size", [1, 7, 333, 1 << 20])
def test_ranges_equal_whole_files(spark, files, size):
    _, paths = files
    whole = decode_wav(spark.createDataFrame(list(bodies().items()), "path string, content binary")).collect()
    want = {r.path: (r.sample_rate, r.channels, list(r.samples or [])) for r in whole}
    rows = R.read_wav_chunks(paths, range_frames=size).collect()
    assert max(len(r.samples or []) for r in rows) <= size
    got = joined(rows)
    assert got.keys() == want.keys()
    failed = {r.path for r in whole if r.error}
    assert failed == {r.path.rpartition("/")[2] for r in rows if r.error}
    for k in want.keys() - failed:
        assert got[k] == want[k], k


def test_tasks_follow_the_samples_not_the_ranges(spark, files):
    _, paths = files
    before = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for size in (1, 1 << 20):
        read = R.read_wav_chunks(paths, range_frames=size)
        assert read.rdd.getNumPartitions() == before
    dealt = spark.range(R.ROWS_PER_TASK * before * 2).selectExpr("1L AS n")
    assert R.reading_tasks(dealt) == 2 * before
    long = spark.range(3 * before).selectExpr(f"{R.RANGE_FRAMES * R.RANGES_PER_TASK}L AS n")
    assert R.reading_tasks(long) == 3 * before


def test_small_ranges_are_read_in_stretches():
    spots = [("a", 0, 5, None), ("a", 5, 5, None), ("a", 20, 5, None), ("b", 0, 0, "bad"), ("b", 0, 0, "bad"), ("c", 0, R.RANGE_FRAMES, None), ("c", R.RANGE_FRAMES, 1, None)]
    assert list(R.runs_of(spots, list(range(7)))) == [[0, 1], [2], [3], [4], [5], [6]]


def test_data_source_reads_a_folder(spark, files):
    folder, paths = files
    R.register(spark)
    rows = spark.read.format("wav_chunks").option("path", folder).option("rangeFrames", 400).load()
    assert joined(rows.collect()) == joined(R.read_wav_chunks(paths, range_frames=400).collect())
    assert rows.rdd.getNumPartitions() == R.wav_ranges(paths, range_frames=400).count()
    one = spark.read.format("wav_chunks").load(f"{folder}/sub 0/w1.wav")
    assert one.agg(F.sum(F.size("samples"))).first()[0] == 1000


def test_long_files_in_the_form_for_over_four_gigabytes(tmp_path):
    mono = wav_bytes(np.zeros(100))
    sizes = struct.pack("<QQQI", len(mono), 200, 100, 0)
    body = b"RF64\xff\xff\xff\xffWAVEds64" + struct.pack("<I", 28) + sizes + mono[12:36] + b"data\xff\xff\xff\xff" + mono[44:]
    (tmp_path / "x.wav").write_bytes(body)
    h = R.header_of(str(tmp_path / "x.wav"))
    assert (h.error, h.n_frames, h.width, h.offset) == (None, 100, 2, len(body) - 200)
    assert R.header_of(str(tmp_path / "missing.wav")).error.startswith("not a readable wav")


def test_no_files(spark):
    none = spark.createDataFrame([], "path string, name string")
    assert R.read_wav_chunks(none).count() == 0
