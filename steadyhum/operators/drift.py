"""Similarity of vectors and drift of recordings from their machine's profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.kernels import DRIFT_METRICS, drift_metrics
from .catalog import MACHINE
from .profile import with_profile

# Tolerances of the element-wise closeness test.
CLOSE_ABS = 1e-8
CLOSE_REL = 1e-5


def similarity(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Add cosine, Euclidean and Manhattan of two vector columns of equal length."""
    va, vb = V.as_double(F.col(a)), V.as_double(F.col(b))
    return pairs.withColumns(
        {
            "cosine_similarity": V.cosine(va, vb),
            "euclidean_distance": V.euclidean(va, vb),
            "manhattan_distance": V.manhattan(va, vb),
        }
    )


def length_violations(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Pairs whose vectors differ in length."""
    return pairs.select(
        *[c for c in pairs.columns if c not in (a, b)],
        F.size(a).alias("length_a"),
        F.size(b).alias("length_b"),
    ).where("length_a <> length_b")


def drift(
    recs: DataFrame,
    profile: DataFrame,
    vector: str = "vector",
    learned: bool = True,
    with_vectors: bool = False,
    unit_fallback: bool = False,
) -> DataFrame:
    """Six drift metrics per recording against its machine's profile, in one narrow pass.

    ``learned`` selects the zero guard of the raw cosine: exactly zero for learned vectors,
    below a floor for signal features. ``unit_fallback`` divides constant dimensions by one
    instead of masking them. Recordings without a profile, or of another length, are not
    scored here; see ``compatibility_violations``.
    """
    joined = with_profile(recs, profile).where(F.size(vector) == F.size("mean"))
    v, mean, std = F.col(vector), F.col("mean"), F.col("std")
    scored = joined.withColumn(
        "_d", drift_metrics(v, mean, std, 0.0 if learned else V.NORM_FLOOR, unit_fallback)
    )
    metrics = {m: F.col(f"_d.{m}") for m in DRIFT_METRICS}
    if with_vectors:
        score = V.zscore_unit_fallback if unit_fallback else V.zscore
        metrics["normalized_vector"] = score(V.as_double(v), mean, std)
        metrics["absolute_difference_vector"] = V.abs_difference(V.as_double(v), mean)
    dropped = ["_d", "mean", "std", "min", "max", "n_samples", vector]
    return scored.withColumns(metrics).drop(*dropped)


def compatibility_violations(
    recs: DataFrame, profile: DataFrame, vector: str = "vector", names: str | None = None
) -> DataFrame:
    """Recordings that cannot be compared with a profile, with the reason."""
    reasons = [
        F.when(F.col("mean").isNull(), "no profile for machine"),
        F.when(F.size(vector) != F.size("mean"), "vector length mismatch"),
    ]
    if names:
        reasons.append(F.when(F.col(names) != F.col("profile_names"), "feature names mismatch"))
        profile = profile.withColumnRenamed("feature_names", "profile_names")
    joined = with_profile(recs, profile, "left")
    return joined.select(*MACHINE, "filename", F.coalesce(*reasons).alias("violation")).where(
        F.col("violation").isNotNull()
    )


def _close(a: Column, b: Column) -> Column:
    near = F.zip_with(a, b, lambda x, y: F.abs(x - y) <= CLOSE_ABS + CLOSE_REL * F.abs(y))
    return (F.size(a) == F.size(b)) & F.forall(near, lambda x: x)


def statistic_diagnostic(profile: DataFrame, compared: str = "compared") -> DataFrame:
    """Which profile statistic the compared vector equals, per machine."""
    c = F.col(compared)
    return profile.select(
        *MACHINE,
        *[_close(c, F.col(s)).alias(f"is_{s}") for s in ("mean", "std", "min", "max")],
    )


def name_mismatches(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Positions at which two feature-name arrays differ."""
    keep = [c for c in pairs.columns if c not in (a, b)]
    at = pairs.select(*keep, F.posexplode(F.arrays_zip(a, b)).alias("feature_index", "n"))
    named = at.select(*keep, "feature_index", F.col(f"n.{a}").alias("name_a"), F.col(f"n.{b}").alias("name_b"))
    return named.where(~F.col("name_a").eqNullSafe(F.col("name_b")))
