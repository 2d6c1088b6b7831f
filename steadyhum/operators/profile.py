"""Healthy profiles: element-wise statistics of each machine's normal recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import drift_metrics
from ..functions.moments import element_moments
from ..functions.scale import bounded_join, materialize
from ..functions.vectors import has_inf, has_nan, has_null
from .catalog import MACHINE, cap_per_machine, exclude_files


def element_statistics(vectors: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """Per key: count and element-wise mean, population std, min and max."""
    n = F.col("n")
    return element_moments(vectors, keys, vector).select(
        *keys,
        n.alias("n_samples"),
        "mean",
        F.transform("m2", lambda v: F.sqrt(v / n)).alias("std"),
        F.col("lo").alias("min"),
        F.col("hi").alias("max"),
    )


def build_profile(recs: DataFrame, vector: str = "vector", names: str | None = None) -> DataFrame:
    """One profile row per machine from its normal recordings."""
    normal = recs.where(F.col("label") == "normal")
    profile = element_statistics(normal, MACHINE, vector)
    if names:
        first = F.element_at(F.sort_array(F.collect_set(names)), 1)
        feature_names = normal.groupBy(*MACHINE).agg(first.alias("feature_names"))
        profile = profile.join(feature_names, MACHINE)
    return profile


def profile_violations(recs: DataFrame, vector: str = "vector", names: str = "feature_names") -> DataFrame:
    """Machines whose input cannot form a profile, with every reason."""
    size, named = F.size(vector), F.xxhash64(names)
    checks = recs.groupBy(*MACHINE).agg(
        F.count_if(F.col("label") != "normal").alias("n_not_normal"),
        F.count_if(F.col("label") == "normal").alias("n_normal"),
        (F.min(named) != F.max(named)).alias("names_differ"),
        (F.min(size) != F.max(size)).alias("lengths_differ"),
    )
    reasons = F.array(
        F.when(F.col("n_normal") == 0, "no normal recordings"),
        F.when(F.col("n_not_normal") > 0, "contains other labels"),
        F.when(F.col("names_differ"), "feature names differ"),
        F.when(F.col("lengths_differ"), "vector lengths differ"),
    )
    return checks.select(*MACHINE, F.explode(F.array_compact(reasons)).alias("violation"))


def usable(recs: DataFrame, vector: str = "vector") -> DataFrame:
    """Recordings whose vector is present and finite; the rest belong in a violation table."""
    v = F.col(vector)
    return recs.where((F.size(v) > 0) & ~has_null(v) & ~has_nan(v) & ~has_inf(v))


def of_common_length(members: DataFrame, vector: str = "vector") -> DataFrame:
    """Members whose vector has their machine's most frequent length, of equally frequent ones the longest.

    Only counts per machine and length are shuffled.
    """
    sized = members.withColumn("_size", F.size(vector))
    counts = sized.groupBy(*MACHINE, "_size").agg(F.count(F.lit(1)).alias("_n"))
    most = counts.groupBy(*MACHINE).agg(F.max(F.struct("_n", "_size")).alias("_most"))
    most = materialize(most.select(*MACHINE, F.col("_most._size").alias("_common")), "common_length")
    joined = bounded_join(sized, most, MACHINE, [F.col("filename")], F.lit(64))
    return joined.where(F.col("_size") == F.col("_common")).drop("_size", "_common")


def build_learned_profile(
    recs: DataFrame,
    max_recordings: int | None = None,
    excluded: DataFrame | None = None,
    vector: str = "vector",
) -> DataFrame:
    """Profile over learned vectors: normal, not excluded, capped in path order, finite."""
    members = learned_profile_members(recs, max_recordings, excluded, vector)
    return element_statistics(members, MACHINE, vector).drop("min", "max")


def learned_profile_members(
    recs: DataFrame,
    max_recordings: int | None = None,
    excluded: DataFrame | None = None,
    vector: str = "vector",
) -> DataFrame:
    members = recs.where(F.col("label") == "normal")
    if excluded is not None:
        members = exclude_files(members, excluded)
    if max_recordings is not None:
        members = cap_per_machine(members, max_recordings, by_label=False).drop("position")
    return usable(members, vector)


def with_profile(recs: DataFrame, profile: DataFrame, how: str = "inner") -> DataFrame:
    """Attach each machine's profile row to its recordings."""
    width = sum((F.size(n) for n in ("mean", "std", "min", "max") if n in profile.columns), F.lit(0))
    return bounded_join(recs, profile, MACHINE, [F.col("filename")], width * 8 + 128, how)


def healthy_norm(members: DataFrame, profile: DataFrame, vector: str = "vector") -> DataFrame:
    """Per machine: mean length of the z-score vector over the profile's own members."""
    joined = with_profile(members.select(*MACHINE, "filename", vector), profile)
    scored = joined.select(*MACHINE, drift_metrics(F.col(vector), F.col("mean"), F.col("std")).alias("d"))
    return scored.groupBy(*MACHINE).agg(F.avg("d.norm_euclidean_distance").alias("healthy_norm"))


def fit_profile(members: DataFrame, vector: str = "vector") -> DataFrame:
    """Materialized profile with its healthy norm: what scoring needs, one row per machine."""
    stats = materialize(element_statistics(members, MACHINE, vector).drop("min", "max"), "profile")
    norms = healthy_norm(members, stats, vector)
    return materialize(stats.join(norms, MACHINE, "left"), "fitted_profile")


def profile_listing(profile: DataFrame, names: Column | None = None) -> DataFrame:
    """One row per machine and feature: position, name, mean, std."""
    labelled = profile.withColumn(
        "_names",
        names
        if names is not None
        else F.transform(F.sequence(F.lit(0), F.size("mean") - 1), lambda i: F.concat(F.lit("f"), i.cast("string"))),
    )
    rows = labelled.select(
        *MACHINE,
        "n_samples",
        F.size("mean").alias("n_features"),
        F.posexplode(F.arrays_zip("_names", "mean", "std")).alias("feature_index", "f"),
    )
    return rows.select(
        *MACHINE,
        "n_samples",
        "n_features",
        "feature_index",
        F.col("f._names").alias("feature_name"),
        F.col("f.mean").alias("mean"),
        F.col("f.std").alias("std"),
    )
