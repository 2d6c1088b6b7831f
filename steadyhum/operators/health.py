"""Health score, state and explanation from drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent_text

# Lower bounds of the health states, best first.
STATE_THRESHOLDS = {"EXCELLENT": 90.0, "GOOD": 75.0, "WARNING": 50.0}
WORST_STATE = "CRITICAL"
NORM_FLOOR = 1e-8

BOUND_TOLERANCE = 5e-10

# Explanation rules (score_min, score_max, summary, possible_causes,
# recommendation). Bounds are inclusive, the first match wins, the last rule also takes
# everything out of range.
EXPLANATION_RULES = [
    (90.0, 100.0, "Machine operating normally.", [], "No action required."),
    (75.0, 90.0, "Minor deviation detected.", [], "Continue monitoring."),
    (
        50.0,
        75.0,
        "Moderate deviation from healthy profile.",
        ["bearing wear", "misalignment", "load variation"],
        "Schedule inspection.",
    ),
    (
        0.0,
        50.0,
        "Significant deviation detected.",
        ["bearing failure", "shaft damage", "mechanical looseness"],
        "Immediate maintenance recommended.",
    ),
]


def health_score(norm_euclidean: Column, healthy_norm: Column) -> Column:
    """100 at zero drift, 50 at the healthy norm, 0 at twice the healthy norm."""
    scale = 2.0 * F.greatest(healthy_norm, F.lit(NORM_FLOOR))
    raw = 100.0 * (1.0 - norm_euclidean / scale)
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))


def health_state(score: Column, thresholds: dict[str, float] | None = None, tolerance: float = BOUND_TOLERANCE) -> Column:
    """The best state whose bound the score reaches, within ``tolerance``.

    The two members of a machine both score 50, and the order of sums, which differs from run to run,
    must not decide their state. Scores themselves are not rounded. Given scores, which are the same in
    every run, are compared exactly with a tolerance of 0.
    """
    bounds = thresholds or STATE_THRESHOLDS
    state = None
    for name in STATE_THRESHOLDS:
        hit = score >= bounds[name] - tolerance
        state = F.when(hit, name) if state is None else state.when(hit, name)
    return state.otherwise(WORST_STATE)


def health_state_by_machine(
    scored: DataFrame, thresholds: DataFrame, score: str = "health_score", tolerance: float = BOUND_TOLERANCE
) -> DataFrame:
    """State with per-machine bounds (machine_type, machine_id, excellent, good, warning)."""
    from ..functions.scale import bounded_join
    from .catalog import MACHINE

    joined = bounded_join(scored, thresholds, MACHINE, [F.col("filename")], F.lit(128), "left")
    s = F.col(score)
    state = None
    for name, default in STATE_THRESHOLDS.items():
        hit = s >= F.coalesce(F.col(name.lower()), F.lit(default)) - tolerance
        state = F.when(hit, name) if state is None else state.when(hit, name)
    return joined.withColumn("health_state", state.otherwise(WORST_STATE)).drop(
        *[n.lower() for n in STATE_THRESHOLDS]
    )


def health(drifted: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Add score, percentage text and state to drift rows that carry ``healthy_norm``."""
    score = health_score(F.col("norm_euclidean_distance"), F.col("healthy_norm"))
    scored = drifted.withColumn("health_score", score)
    return scored.withColumns(
        {
            "health_percentage": percent_text(F.col("health_score")),
            "health_state": health_state(F.col("health_score"), thresholds),
        }
    )


def _rule_struct(rule) -> Column:
    _, _, summary, causes, recommendation = rule
    listed = F.array(*[F.lit(c) for c in causes]).cast("array<string>")
    return F.struct(
        F.lit(summary).alias("summary"),
        listed.alias("possible_causes"),
        F.lit(recommendation).alias("recommendation"),
    )


def explain(scored: DataFrame, score: str = "health_score", rules=None) -> DataFrame:
    """Add summary, possible causes and recommendation, with the states' tolerance; rules fold into one expression."""
    table = rules or EXPLANATION_RULES
    chosen = None
    for rule in table:
        hit = F.col(score).between(rule[0] - BOUND_TOLERANCE, rule[1] + BOUND_TOLERANCE)
        chosen = F.when(hit, _rule_struct(rule)) if chosen is None else chosen.when(hit, _rule_struct(rule))
    matched = scored.withColumn("_rule", chosen.otherwise(_rule_struct(table[-1])))
    return matched.select("*", "_rule.*").drop("_rule")
