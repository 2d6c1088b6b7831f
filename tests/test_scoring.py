import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadyhum.functions import scale
from steadyhum.functions import vectors as V
from steadyhum.functions.moments import element_moments
from steadyhum.functions.text import percent_text
from steadyhum.operators import drift as D
from steadyhum.operators import evaluate as E
from steadyhum.operators import health as H
from steadyhum.operators import profile as P
from steadyhum.plans.report import health_report, report_violations

SCHEMA = "machine_type string, machine_id string, label string, filename string, vector array<double>"


@pytest.fixture(scope="module")
def recs(spark):
    """One machine holds most of the rows, one has no normal recording."""
    rng = np.random.default_rng(0)
    rows = []
    for m, n in (("hot", 400), ("cold", 12), ("bare", 5)):
        for i in range(n):
            label = "abnormal" if m == "bare" or i % 5 == 0 else "normal"
            v = rng.normal(3.0, 1.0, 6) + (0.7 if label == "abnormal" else 0.0)
            v[2] = 0.25
            rows.append(("pump", m, label, f"{m}{i:04d}", [float(x) for x in v]))
    return spark.createDataFrame(rows, SCHEMA).repartition(8).cache()


def test_statistics_against_numpy(recs):
    got = {r["machine_id"]: r for r in P.build_profile(recs).collect()}
    assert set(got) == {"hot", "cold"}
    x = np.array([r["vector"] for r in recs.where("machine_id = 'hot' and label = 'normal'").collect()])
    r = got["hot"]
    assert r["n_samples"] == len(x)
    np.testing.assert_allclose(r["mean"], x.mean(0), rtol=1e-12)
    np.testing.assert_allclose(r["std"], x.std(0), rtol=1e-9, atol=1e-12)
    assert r["min"] == list(x.min(0)) and r["max"] == list(x.max(0))


def test_statistics_reject_mixed_lengths(spark):
    df = spark.createDataFrame([("a", [1.0]), ("a", [1.0, 2.0])], "k string, vector array<double>").coalesce(1)
    with pytest.raises(Exception, match="different length"):
        element_moments(df, ["k"], "vector").collect()


def test_salted_join_equals_broadcast(recs):
    profile = scale.materialize(P.build_profile(recs), "profile")
    keys = ["machine_type", "machine_id"]
    fast = recs.join(F.broadcast(profile), keys).select("filename", "mean")
    slow = scale.bounded_join(recs, profile, keys, [F.col("filename")], F.lit(100), limit=0).select("filename", "mean")
    assert fast.exceptAll(slow).count() == 0 and fast.count() == slow.count() == 412


def test_drift_metrics_against_numpy(recs):
    profile = scale.materialize(P.build_profile(recs), "profile")
    by_machine = {r["machine_id"]: r for r in profile.collect()}
    source = {r["filename"]: r for r in recs.collect()}
    for r in D.drift(recs, profile).collect():
        v = np.array(source[r["filename"]]["vector"])
        mu, sd = (np.array(by_machine[r["machine_id"]][k]) for k in ("mean", "std"))
        z = np.where(sd < 1e-10, 0.0, (v - mu) / np.where(sd < 1e-10, 1.0, sd))
        assert z[2] == 0.0
        assert r["euclidean_distance"] == pytest.approx(np.linalg.norm(v - mu))
        assert r["cosine_similarity"] == pytest.approx(v @ mu / np.linalg.norm(v) / np.linalg.norm(mu))
        assert r["norm_manhattan_distance"] == pytest.approx(np.abs(z).sum())
        assert r["norm_cosine_similarity"] == pytest.approx(z.sum() / np.linalg.norm(z) / math.sqrt(6))


def test_machine_without_profile_is_reported(recs):
    profile = scale.materialize(P.build_profile(recs), "profile")
    found = D.compatibility_violations(recs, profile).groupBy("machine_id", "violation").count().collect()
    assert [tuple(r) for r in found] == [("bare", "no profile for machine", 5)]


def test_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    r = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.cosine_to_ones(F.col("a")).alias("o")).first()
    assert (r["c"], r["o"]) == (0.0, 0.0)


def test_members_average_fifty(recs):
    members = recs.where("label = 'normal' and machine_id <> 'bare'")
    fitted = P.fit_profile(members)
    scored = H.health(D.drift(members, fitted))
    for r in scored.groupBy("machine_id").agg(F.avg(50.0 * (2 - F.col("norm_euclidean_distance") / F.col("healthy_norm"))).alias("m")).collect():
        assert r["m"] == pytest.approx(50.0)


def test_states_and_rules_at_the_bounds(spark):
    values = [100.0, 90.0, 89.999, 75.0, 74.0, 50.0, 49.9, 0.0, -1.0, 101.0, float("nan")]
    df = spark.createDataFrame([(v,) for v in values], "health_score double")
    rows = H.explain(df.withColumn("state", H.health_state(F.col("health_score")))).collect()
    first = [r["summary"].split()[0] for r in rows]
    assert first == ["Machine", "Machine", "Minor", "Minor", "Moderate", "Moderate"] + ["Significant"] * 5
    assert [r["state"] for r in rows[:8]] == ["EXCELLENT", "EXCELLENT", "GOOD", "GOOD", "WARNING", "WARNING", "CRITICAL", "CRITICAL"]


def test_health_score_limits(spark):
    df = spark.createDataFrame([(0.0, 4.0), (4.0, 4.0), (8.0, 4.0), (99.0, 4.0), (1.0, 0.0), (float("nan"), 4.0)], "z double, h double")
    assert [r[0] for r in df.select(H.health_score(F.col("z"), F.col("h"))).collect()] == [100.0, 50.0, 0.0, 0.0, 0.0, 100.0]


def test_percent_text_follows_exact_binary_rounding(spark):
    rng = np.random.default_rng(1)
    values = [0.0, 0.05, 0.15, 0.25, 0.35, 12.25, 12.35, 12.75, 49.95, 99.95, 99.949999, 100.0, 1e-9, 0.1 + 0.2]
    values += [k / 20 for k in range(2000)] + list(rng.uniform(0, 100, 3000)) + [k / 64 for k in range(6400)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for r in df.select("v", percent_text(F.col("v")).alias("t")).collect():
        assert r["t"] == f"{r['v']:.1f}%", r


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


def test_roc_with_ties(spark):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 600), rng.integers(0, 15, 600).astype(float)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y_true int, anomaly_score double")
    assert E.roc_auc(df).first()["auc"] == pytest.approx(brute_auc(y, s), abs=1e-12)
    points = sorted((r["fpr"], r["tpr"]) for r in E.roc_curve(df).collect())
    assert len(points) == 16 and points[0] == (0.0, 0.0) and points[-1] == (1.0, 1.0)


def test_roc_needs_both_classes(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0)], "y_true int, anomaly_score double")
    assert E.roc_auc(df).count() == 0 and E.roc_curve(df).count() == 0


def test_medians(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.integers(0, 5, 900)] + [("even", 1.0), ("even", 4.0), ("one", 7.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["median"] for r in E.medians(df, ["k"], "v").collect()}
    hot = np.array([v for k, v in rows if k == "hot"])
    assert got == {"hot": float(np.median(hot)), "even": 2.5, "one": 7.0}


def test_separation_with_zero_mean_and_missing_class(spark):
    rows = [("t", "a", "normal", 0.0), ("t", "a", "abnormal", 2.0), ("t", "b", "normal", 1.0)]
    df = spark.createDataFrame(rows, "machine_type string, machine_id string, label string, d double")
    out = E.separation(df, "d").collect()
    assert len(out) == 1 and math.isnan(out[0]["separation_ratio"]) and out[0]["status"] == "PASS"


def test_pca_against_svd(recs):
    x = np.array([r["vector"] for r in recs.collect()])
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    got = [r["explained_variance_ratio"] for r in E.explained_variance(recs).orderBy("component").collect()]
    np.testing.assert_allclose(got, s[:2] / s.sum(), rtol=1e-9)
    coords = E.pca_coordinates(recs).agg(F.var_pop("pc1"), F.var_pop("pc2"), F.avg("pc1")).first()
    np.testing.assert_allclose(coords[:2], s[:2] / len(x), rtol=1e-9)
    assert abs(coords[2]) < 1e-9


def test_null_elements_and_mixed_lengths_become_violations(spark):
    rows = [("fan", "id_00", "normal", f"{i}.wav", [1.0 + i, 2.0]) for i in range(6)]
    rows += [("fan", "id_00", "normal", "short.wav", [1.0]), ("fan", "id_00", "normal", "null.wav", [1.0, None])]
    rows += [("fan", "id_09", "abnormal", "alone.wav", [1.0, 2.0]), ("fan", "id_00", "normal", "none.wav", None)]
    recs = spark.createDataFrame(rows, "machine_type string, machine_id string, label string, filename string, vector array<double>")
    members = recs.where("label = 'normal'")
    scored = {r.filename for r in health_report(recs, members).collect()}
    listed = {r.filename: r.violation for r in report_violations(recs, members, ["filename"]).collect()}
    assert listed == {
        "short.wav": "length differs from the profile", "null.wav": "null values",
        "alone.wav": "no profile", "none.wav": "empty vector",
    }
    assert scored == {f"{i}.wav" for i in range(6)}
