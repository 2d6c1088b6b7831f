"""A tree of WAV files through the whole plan."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadyhum.functions.signal import SignalParams
from steadyhum.operators.projection import Head
from steadyhum.plans import from_files as FF
from steadyhum.plans.report import health_report
from tests.test_signal import wav_bytes

PARAMS = SignalParams(n_mels=40, mfcc_mels=40)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("audio")
    rng = np.random.default_rng(0)
    t = np.arange(12000) / 16000
    for m, hz in (("id_00", 400), ("id_02", 900)):
        for label, extra, n in (("normal", 0.02, 6), ("abnormal", 0.3, 2)):
            folder = base / "pump" / m / label
            folder.mkdir(parents=True)
            for i in range(n):
                x = 0.4 * np.sin(2 * np.pi * hz * t) + rng.normal(0, extra, len(t))
                (folder / f"{i:08d}.wav").write_bytes(wav_bytes(np.clip(x, -1, 1)))
    (base / "pump" / "id_00" / "normal" / "broken.wav").write_bytes(b"nothing")
    (base / "pump" / "id_00" / "odd").mkdir()
    (base / "pump" / "id_00" / "odd" / "x.wav").write_bytes(b"nothing")
    (base / "loose.wav").write_bytes(b"nothing")
    return str(base)


@pytest.fixture(scope="module")
def dsp(spark, root):
    return FF.dsp_vectors(FF.decoded_recordings(spark, root), PARAMS).cache()


def test_catalog_and_errors(spark, root):
    reasons = FF.catalog(spark, root).groupBy("reject_reason").count().collect()
    assert {r["reject_reason"]: r["count"] for r in reasons} == {None: 17, "unknown label": 1, "too few segments": 1}
    decoded = FF.decoded_recordings(spark, root)
    assert decoded.where("error is not null").select("filename").collect()[0][0] == "broken.wav"


def test_abnormal_files_drift_further(dsp):
    recs = dsp.withColumnRenamed("feature_vector", "vector").drop("feature_names")
    assert recs.count() == 16
    out = health_report(recs, recs.where("label = 'normal'"))
    means = {(r["machine_id"], r["label"]): r["s"] for r in out.groupBy("machine_id", "label").agg(F.avg("health_score").alias("s")).collect()}
    for m in ("id_00", "id_02"):
        assert means[m, "normal"] > means[m, "abnormal"]


def test_learned_report(spark, dsp):
    embeddings = dsp.select(
        "machine_type", "machine_id", "label", F.regexp_replace("filename", "[.]wav$", "").alias("stem"),
        F.array(*[F.rand(i) for i in range(8)]).alias("embedding"),
    )
    fused = FF.fused_vectors(dsp, embeddings, embedding_dim=8).cache()
    head = Head.initial((161, 16, 8), 1)
    report = FF.learned_report(fused, fused.where("label = 'normal'"), head)
    row = report.first()
    assert report.count() == 16
    assert (row["dsp_dim"], row["embedding_dim"], row["fused_dim"], row["learned_dim"]) == (153, 8, 161, 8)
    assert 0.0 <= row["health_score"] <= 100.0 and row["health_percentage"].endswith("%")


def test_listing_by_tasks_equals_the_scan(spark, root, tmp_path):
    from steadyhum.sources.recordings import list_files, scan_files

    for place in (root, f"file:{root}", f"file://{root}"):
        want = scan_files(spark, root).selectExpr("regexp_replace(path, '^file:/+', '/') AS path", "length").collect()
        listed = list_files(spark, place)
        got = listed.selectExpr("regexp_replace(path, '^file:/+', '/') AS path", "length").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 19
    gap = listed.join(scan_files(spark, root).selectExpr("regexp_replace(path, '^file:/+', 'file:///') AS path", "modificationTime AS m"), "path")
    assert gap.where("abs(unix_millis(modificationTime) - unix_millis(m)) > 1").count() == 0 and gap.count() == 19
    (tmp_path / "none").mkdir()
    assert list_files(spark, str(tmp_path)).count() == 0
    with pytest.raises(FileNotFoundError):
        list_files(spark, str(tmp_path / "missing"))
