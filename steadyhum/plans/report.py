"""The machine health report: recordings in, one scored row per recording out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scale import bounded_join
from ..functions.vectors import has_inf, has_nan, has_null
from ..operators.catalog import MACHINE
from ..operators.drift import drift
from ..operators.health import explain, health
from ..operators.profile import fit_profile, of_common_length, usable


def score_recordings(
    recs: DataFrame,
    members: DataFrame,
    vector: str = "vector",
    thresholds: dict[str, float] | None = None,
) -> DataFrame:
    """Drift and health of ``recs`` against profiles of ``members``.

    Three passes over the vectors (statistics, healthy norm, scoring). The first two shuffle
    only per-machine partials; the scoring pass does not shuffle at all.
    """
    fitted = fit_profile(of_common_length(usable(members, vector), vector), vector)
    return health(drift(usable(recs, vector), fitted, vector), thresholds)


def report_violations(recs: DataFrame, members: DataFrame, keep: list[str], vector: str = "vector") -> DataFrame:
    """The rows of ``recs`` that the report leaves out, each with its first reason.

    Together with the report these are all rows of ``recs``.
    """
    sound = of_common_length(usable(members, vector), vector)
    lengths = sound.groupBy(*MACHINE).agg(F.max(F.size(vector)).alias("_length"))
    joined = bounded_join(recs, lengths, MACHINE, [F.col("filename")], F.lit(64), "left")
    v = F.col(vector)
    reason = F.coalesce(
        F.when(v.isNull() | (F.size(v) == 0), "empty vector"),
        F.when(has_null(v), "null values"),
        F.when(has_nan(v), "NaN values"),
        F.when(has_inf(v), "infinite values"),
        F.when(F.col("_length").isNull(), "no profile"),
        F.when(F.size(v) != F.col("_length"), "length differs from the profile"),
    )
    return joined.select(*keep, reason.alias("violation")).where(F.col("violation").isNotNull())


def health_report(
    recs: DataFrame,
    members: DataFrame,
    vector: str = "vector",
    dims: dict[str, str] | None = None,
    thresholds: dict[str, float] | None = None,
) -> DataFrame:
    """Dimensions, six drift metrics, score, percentage and state per recording.

    ``dims`` maps output column to the vector column whose length it reports.
    """
    sized = recs
    for name, column in (dims or {"learned_dim": vector}).items():
        sized = sized.withColumn(name, F.size(column))
    return score_recordings(sized, members, vector, thresholds).drop("healthy_norm")


def explained_report(recs: DataFrame, members: DataFrame, vector: str = "vector") -> DataFrame:
    """The report with summary, possible causes and recommendation."""
    return explain(health_report(recs, members, vector))
