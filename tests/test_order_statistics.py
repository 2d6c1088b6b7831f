"""Medians from a sketch and a band, prefix sums over many buckets, and principal axes from one pass."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from steadyhum.functions import ranking
from steadyhum.functions.scale import fresh_path
from steadyhum.operators import evaluate as E
from steadyhum.operators import principal as PA
from steadyhum.operators.health import health_score, health_state


def values():
    r = np.random.default_rng(0)
    out = {"normal": r.normal(size=9001), "few": np.array([3.0, 1.0]), "one": np.array([7.0]), "equal": np.full(500, 2.0)}
    out["ties"] = r.integers(0, 5, 4000).astype(float)
    out["spread"] = np.concatenate([r.normal(size=3000) * 1e9, [0.0] * 3000])
    out["gap"] = np.concatenate([np.zeros(1000), np.ones(1000)])
    out[None] = r.exponential(size=777)
    return out


@pytest.mark.parametrize("share", [1e-3, 0.05, 0.4])
def test_medians_are_exact(spark, share):
    rows = [(k, float(x)) for k, v in values().items() for x in v] + [("one", None), ("empty", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(7)
    got = {r.k: r["median"] for r in E.medians(df, ["k"], "x", share).collect()}
    assert got == {k: float(np.median(v)) for k, v in values().items()}


def test_the_median_of_all_rows(spark):
    df = spark.range(100001).select((F.col("id") * 7919 % 100003).cast("double").alias("x"))
    assert E.medians(df.withColumn("k", F.lit(1)), ["k"], "x").first()["median"] == float(np.median(np.arange(100001) * 7919 % 100003))


@pytest.mark.parametrize("held", [4, 256])
def test_running_sums_with_any_number_of_buckets(spark, monkeypatch, held):
    """With ``held`` 4 the buckets are more than an expression holds."""
    monkeypatch.setattr(ranking, "BOUNDS_HELD", held)
    r = np.random.default_rng(1)
    pairs = {(int(k), float(v)): int(n) for k, v, n in zip(r.integers(0, 3, 3000), r.normal(size=3000).round(3), r.integers(1, 9, 3000))}
    df = spark.createDataFrame([(k, v, n) for (k, v), n in pairs.items()], "k int, v double, n long")
    for descending in (False, True):
        got = {(x.k, x.v): (x.n_before, x.n_total) for x in E.running_sums(df, ["k"], "v", ["n"], descending).collect()}
        for k in range(3):
            own = sorted(((v, n) for (g, v), n in pairs.items() if g == k), reverse=descending)
            total, before = sum(n for _, n in own), 0
            for v, n in own:
                assert got[k, v] == (before, total)
                before += n


def test_buckets_grow_with_the_rows(spark):
    df = spark.range(1)
    assert ranking.default_buckets(df) == 16 and ranking.default_buckets(df, 5000 * ranking.BUCKET_ROWS) == 5000


def svd_axes(x, k):
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    axes = vt[:k] * np.sign(vt[:k][np.arange(k), np.abs(vt[:k]).argmax(axis=1)])[:, None]
    return axes, s[:k] ** 2 / (len(x) - 1), (s**2).sum() / (len(x) - 1)


@pytest.mark.parametrize("n, d, parts", [(2, 3, 1), (40, 5, 40), (1500, 921, 20)])
def test_axes_equal_a_singular_value_decomposition(spark, n, d, parts):
    r = np.random.default_rng(d)
    x = r.normal(size=(n, d)) * np.linspace(5, 0.1, d) + 1e5
    x[:, : min(3, d)] += r.normal(size=(n, 1)) * 20
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(n, None)], "id long, vector array<double>").repartition(parts)
    got = PA.fit_axes(df, k=2)
    k = min(2, n - 1)
    axes, variances, total = svd_axes(x, k)
    assert got.n == n and got.total == pytest.approx(total, rel=1e-8)
    np.testing.assert_allclose(got.axes[:k], axes, atol=1e-6)
    np.testing.assert_allclose(got.variances[:k], variances, rtol=1e-7)
    rows = {r.id: (r.pc1, r.pc2) for r in PA.coordinates(df, got).collect()}
    assert rows[n] == (None, None)
    np.testing.assert_allclose([rows[i][0] for i in range(n)], (x - x.mean(axis=0)) @ axes[0], atol=1e-4)


def test_one_model_serves_coordinates_and_shares(spark):
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(v,) for v in r.normal(size=(60, 4)).tolist()], "vector array<double>")
    axes, path = PA.fit_axes(df), fresh_path(spark, "axes")
    PA.save_axes(spark, axes, path)
    back = PA.load_axes(spark, path)
    assert E.explained_variance(df, axes=back).collect() == E.explained_variance(df).collect()
    assert E.pca_coordinates(df, axes=back).collect() == E.pca_coordinates(df).collect()


def test_axes_need_vectors_of_one_length(spark):
    with pytest.raises(ValueError, match="two vectors"):
        PA.fit_axes(spark.createDataFrame([([1.0],)], "vector array<double>"))
    with pytest.raises(Exception, match="dimensions"):
        PA.fit_axes(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "vector array<double>").coalesce(1))


def test_scores_are_kept_and_bounds_have_a_tolerance(spark):
    df = spark.createDataFrame([(1.0 + 1e-13,), (1.0 + 1e-7,), (0.12345678901234,)], "d double")
    rows = df.select(health_score(F.col("d"), F.lit(1.0)).alias("s")).select("s", health_state(F.col("s")).alias("state")).collect()
    assert [r.state for r in rows] == ["WARNING", "CRITICAL", "EXCELLENT"]
    assert rows[2].s == 100.0 * (1.0 - 0.12345678901234 / 2.0) and rows[0].s < 50.0
