import io
import wave

import numpy as np
import pytest

from steadyhum.functions import signal as S
from steadyhum.functions.signal import SignalParams
from steadyhum.operators import features as FT
from steadyhum.operators import preprocess as P
from steadyhum.sources.wav import decode_wav


def wav_bytes(x, rate=16000, channels=1, width=2):
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        full = np.round(np.asarray(x) * (2 ** (8 * width - 1) - 1)).astype(np.int64)
        if width == 1:
            f.writeframes((full + 128).astype("u1").tobytes())
        elif width == 3:
            f.writeframes(b"".join(int(v).to_bytes(3, "little", signed=True) for v in full))
        else:
            f.writeframes(full.astype(f"<i{width}").tobytes())
    return buffer.getvalue()


def tone(hz, seconds=0.5, rate=16000):
    return 0.5 * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_decode_widths(spark, width):
    x = tone(440, 0.01)
    row = decode_wav(spark.createDataFrame([(1, wav_bytes(x, width=width))], "id int, content binary")).first()
    assert (row["sample_rate"], row["channels"], row["error"]) == (16000, 1, None)
    np.testing.assert_allclose(row["samples"], x, atol=2.0 ** (2 - 8 * min(width, 3)))


def test_decode_stereo_and_bad_files(spark):
    left, right = tone(440, 0.01), tone(880, 0.01)
    both = np.column_stack([left, right]).ravel()
    rows = [("stereo", wav_bytes(both, channels=2)), ("empty", b""), ("text", b"hello"), ("silent", wav_bytes([]))]
    out = {r["k"]: r for r in decode_wav(spark.createDataFrame(rows, "k string, content binary")).collect()}
    np.testing.assert_allclose(out["stereo"]["samples"], (left + right) / 2, atol=1e-4)
    assert all(out[k]["error"] and out[k]["samples"] is None for k in ("empty", "text", "silent"))


@pytest.mark.parametrize("rate", [8000, 22050, 44100, 48000])
def test_resampling_keeps_a_tone(rate):
    x = tone(1000, 0.5, rate)
    y = S._resample(x, rate, 16000)
    assert len(y) == int(np.ceil(len(x) * 16000 / rate))
    inner = slice(800, -800)
    want = tone(1000, 0.5)[: len(y)]
    assert np.abs(y[inner] - want[inner]).max() < 5e-3
    assert np.argmax(np.abs(np.fft.rfft(y))) == pytest.approx(1000 * len(y) / 16000, abs=1)


def test_resample_leaves_matching_rows(spark):
    rows = [(1, 16000, [0.1, 0.2, 0.3]), (2, 8000, [0.0] * 80)]
    df = spark.createDataFrame(rows, "id int, sample_rate int, samples array<double>")
    out = {r["id"]: r for r in P.resample_waves(df).collect()}
    assert out[1]["samples"] == [0.1, 0.2, 0.3] and len(out[2]["samples"]) == 160
    assert {r["sample_rate"] for r in out.values()} == {16000}


def test_frames_short_and_edge(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, [7.0]), (3, [])], "id int, samples array<double>")
    plain = P.frames(df, 4, 2, centred=False).collect()
    assert [(r["id"], r["frame"], r["x"]) for r in plain] == [(1, 0, [1.0, 2.0, 3.0, 4.0])]
    edge = [r["x"] for r in P.frames(df.where("id = 1"), 4, 2, edge=True).orderBy("frame").collect()]
    assert edge == [[1.0, 1.0, 1.0, 2.0], [1.0, 2.0, 3.0, 4.0], [3.0, 4.0, 5.0, 5.0]]


def test_deltas_of_polynomials():
    t = np.arange(20.0)
    rows = np.column_stack([3 * t + 1, t**2])
    np.testing.assert_allclose(S.deltas(rows, S.SLOPE_WEIGHTS)[:, 0], 3.0)
    np.testing.assert_allclose(S.deltas(rows, S.CURVATURE_WEIGHTS)[:, 1], 2.0)
    assert len(S.deltas(rows[:8], S.SLOPE_WEIGHTS)) == 0


def test_mel_filters_have_unit_area():
    w = S.mel_weights(16000, 1024, 40, 20.0)
    area = w.sum(axis=1) * 16000 / 1024
    np.testing.assert_allclose(area[10:], 1.0, rtol=0.05)


def test_dct_is_orthonormal():
    d = S.dct_weights(16, 16)
    np.testing.assert_allclose(d @ d.T, np.eye(16), atol=1e-12)


def test_contrast_bands_need_bins():
    with pytest.raises(ValueError, match="half the sample rate"):
        S.contrast_slices(2000, 1024, 6, 200.0)


def test_harmonic_split_of_tone_and_clicks():
    steady = tone(1000, 1.0)
    clicks = np.zeros(16000)
    clicks[::2000] = 1.0
    for x, harmonic in ((steady, True), (clicks, False)):
        h, p = S.split_energies(x, 2048, 512, 31)
        assert (h > 10 * p) == harmonic and (p > 10 * h) == (not harmonic)


def test_centred_frame_count():
    x = np.random.default_rng(0).normal(size=4000)
    assert S.power(x, S.hann(256), 128).shape == (1 + 4000 // 128, 129)
    assert S.power(x[:0], S.hann(256), 128).shape == (0, 129)


@pytest.fixture(scope="module")
def features(spark):
    rng = np.random.default_rng(4)
    rows = [(i, 16000, [float(v) for v in rng.normal(0, 0.1, 16000) + tone(500 * (i + 1), 1.0)]) for i in range(3)]
    rows.append((9, 16000, [0.0] * 16000))
    df = spark.createDataFrame(rows, "rec_id int, sample_rate int, samples array<float>")
    return df, {r["rec_id"]: r.asDict() for r in FT.extract(df, ["rec_id"]).collect()}


def test_production_vector_has_153_finite_features(spark, features):
    _, rows = features
    names = FT.feature_names(SignalParams())
    assert len(names) == 153 and len(set(names)) == 153
    assert names[0] == "mfcc_0_mean" and names[20] == "mfcc_0_std" and names[-1] == "harmonic_ratio"
    for row in rows.values():
        assert all(row[n] is not None and np.isfinite(row[n]) for n in names)


def test_feature_values_of_known_signals(features):
    _, rows = features
    assert rows[0]["spectral_centroid_mean"] < rows[2]["spectral_centroid_mean"]
    assert rows[0]["harmonic_ratio"] > 0.5
    silent = rows[9]
    assert silent["rms_max"] == 0.0 and silent["zcr_mean"] == 0.0 and silent["harmonic_ratio"] == 0.0
    assert silent["spectral_centroid_mean"] == 0.0 and silent["dynamic_range_db"] == 0.0
    assert silent["spectral_flatness_mean"] == pytest.approx(1.0)


def test_features_against_plain_numpy(features):
    df, rows = features
    x = np.array(df.where("rec_id = 1").first()["samples"], dtype=np.float64)
    padded = np.pad(x, 512)
    frames = np.stack([padded[k * 512 : k * 512 + 1024] for k in range(1 + len(x) // 512)])
    rms = np.sqrt((frames**2).mean(axis=1))
    assert rows[1]["rms_mean"] == pytest.approx(rms.mean())
    assert rows[1]["rms_std"] == pytest.approx(rms.std())
    mag = np.abs(np.fft.rfft(frames * S.hann(1024), axis=1))
    freq = np.arange(513) * 16000 / 1024
    centroid = (mag * freq).sum(1) / mag.sum(1)
    assert rows[1]["spectral_centroid_mean"] == pytest.approx(centroid.mean())
    width = np.sqrt((mag * (freq - centroid[:, None]) ** 2).sum(1) / mag.sum(1))
    assert rows[1]["spectral_bandwidth_std"] == pytest.approx(width.std())


def test_feature_vector(spark, features):
    df, _ = features
    names = FT.feature_names(SignalParams())
    row = FT.feature_vector(FT.extract(df, ["rec_id"]), names).first()
    assert row["feature_names"] == names and len(row["feature_vector"]) == 153
    with pytest.raises(ValueError):
        FT.feature_vector(df, [])


def test_normalized_samples_reach_the_kernels(spark, features):
    df, rows = features
    peak = np.abs(df.where("rec_id = 0").first()["samples"]).max()
    loud = FT.extract(P.normalize(df), ["rec_id"]).where("rec_id = 0").first()
    assert loud["rms_max"] == pytest.approx(rows[0]["rms_max"] / peak, rel=1e-5)


def test_too_short_recordings(spark):
    df = spark.createDataFrame([(1, [0.1] * 500), (2, [0.1] * 3000), (3, [0.1] * 16000)], "id int, samples array<double>")
    found = {r["id"]: r["violation"] for r in FT.too_short(df, SignalParams()).collect()}
    assert found == {1: "shorter than one frame", 2: "too few frames for deltas"}
