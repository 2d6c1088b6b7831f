"""Evaluation of drift and health: separation, distributions, outliers, ROC, PCA."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranking import bucket_offsets, first_n, in_ordered_buckets, number_rows, value_buckets
from ..functions.scale import bounded_join, materialize
from .catalog import MACHINE
from .principal import Axes, coordinates, fit_axes, variance_shares

# Fixed value: scores below it are predicted abnormal.
ABNORMAL_BELOW = 50.0

BAND_SHARE = 1e-3  # of the rows of a group, on either side of its median

LABELS = ("normal", "abnormal")


def _of(label: str, value: str) -> Column:
    return F.when(F.col("label") == label, F.col(value))


def class_means(scored: DataFrame, metrics: list[str], keys: list[str] = MACHINE) -> DataFrame:
    """Mean of each metric by machine, one column per class: ``<class>_<metric>``."""
    return scored.groupBy(*keys).agg(
        *[F.avg(_of(c, m)).alias(f"{c}_{m}") for m in metrics for c in LABELS]
    )


def safe_ratio(numerator: Column, denominator: Column, undefined: float) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(undefined))


def separation(scored: DataFrame, metric: str, undefined: float = float("nan")) -> DataFrame:
    """Per machine: class means, abnormal/normal ratio, PASS when abnormal drifts further.

    Machines lacking one of the classes are skipped.
    """
    n, a = F.col(f"normal_{metric}"), F.col(f"abnormal_{metric}")
    means = class_means(scored, [metric]).where(n.isNotNull() & a.isNotNull())
    return means.select(
        *MACHINE,
        n.alias("mean_normal"),
        a.alias("mean_abnormal"),
        safe_ratio(a, n, undefined).alias("separation_ratio"),
        F.when(a > n, "PASS").otherwise("FAIL").alias("status"),
    )


def final_evaluation(scored: DataFrame) -> DataFrame:
    """Per machine: drift and health by class; passes if drift rises and health falls."""
    metrics = ["euclidean_distance", "norm_euclidean_distance", "health_score"]
    means = class_means(scored, metrics)
    n, a = F.col("normal_norm_euclidean_distance"), F.col("abnormal_norm_euclidean_distance")
    passed = (a > n) & (F.col("normal_health_score") > F.col("abnormal_health_score"))
    return (
        means.where(n.isNotNull() & a.isNotNull())
        .withColumn("separation_ratio", safe_ratio(a, n, 0.0))
        .withColumn("passed", passed)
    )


def overall_summary(evaluated: DataFrame) -> DataFrame:
    """One row over all machines of ``final_evaluation``; NaN ratios are left out."""
    ratio = F.col("separation_ratio")
    return evaluated.agg(
        F.count(F.lit(1)).alias("n_machines"),
        F.count_if("passed").alias("n_pass"),
        F.count_if(~F.col("passed")).alias("n_fail"),
        F.avg(F.when(~F.isnan(ratio), ratio)).alias("mean_separation_ratio"),
        F.avg("normal_health_score").alias("mean_normal_health"),
        F.avg("abnormal_health_score").alias("mean_abnormal_health"),
        F.coalesce(F.bool_and("passed"), F.lit(False)).alias("all_passed"),
    )


def compare_representations(scored: DataFrame, raw: str, normalized: str) -> DataFrame:
    """Per machine: separation of raw against normalized distances and the better one."""
    means = class_means(scored, [raw, normalized])
    rn, ra = F.col(f"normal_{raw}"), F.col(f"abnormal_{raw}")
    nn, na = F.col(f"normal_{normalized}"), F.col(f"abnormal_{normalized}")
    both = means.where(rn.isNotNull() & ra.isNotNull()).select(
        *MACHINE,
        safe_ratio(ra, rn, float("nan")).alias("raw_ratio"),
        safe_ratio(na, nn, float("nan")).alias("normalized_ratio"),
        (ra > rn).alias("raw_separates"),
        (na > nn).alias("normalized_separates"),
    )
    raw_ok, norm_ok = F.col("raw_separates"), F.col("normalized_separates")
    verdict = (
        F.when(raw_ok & norm_ok & (F.col("raw_ratio") >= F.col("normalized_ratio")), "raw")
        .when(raw_ok & norm_ok, "normalized")
        .when(raw_ok, "only raw")
        .when(norm_ok, "only normalized")
        .otherwise("neither")
    )
    return both.withColumn("better", verdict)


def same_group_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on ``keys``, null being a group like any other; the columns of ``left`` and the others of ``right``."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    rest = [c for c in right.columns if c not in keys]
    return left.join(right.select(*[F.col(k).alias(f"_of_{k}") for k in keys], *rest), same).drop(*[f"_of_{k}" for k in keys])


def running_sums(
    counted: DataFrame, keys: list[str], value: str, amounts: list[str], descending: bool = False
) -> DataFrame:
    """Add ``<amount>_before`` and ``<amount>_total`` along ``value``.

    ``counted`` has one row per (keys, value), so ties are already merged and the buckets
    stay even however often one value repeats. It is written once, and there are more buckets for more rows.
    """
    marked = value_buckets(materialize(counted, "counted"), value)
    if descending:
        marked = marked.withColumn("_bucket", -F.col("_bucket"))
    offsets = bucket_offsets(marked, keys, {a: F.sum(a) for a in amounts})
    order = F.col(value).desc() if descending else F.col(value).asc()
    earlier = W.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    local = marked.select(
        "*", *[F.coalesce(F.sum(a).over(earlier), F.lit(0)).alias(f"_local_{a}") for a in amounts]
    )
    joined = same_group_join(local, offsets, [*keys, "_bucket"])
    summed = joined.withColumns({f"{a}_before": F.col(f"{a}_before") + F.col(f"_local_{a}") for a in amounts})
    return summed.drop("_bucket", *[f"_local_{a}" for a in amounts])


def medians(scored: DataFrame, keys: list[str], value: str, share: float = BAND_SHARE) -> DataFrame:
    """Exact median per group: a mergeable sketch gives a narrow band around it, exact selection works inside.

    The sketch's ranks are off by ``share`` / 2 at most, so ranks ``share`` on either side of the middle
    enclose it. Only counts below the band and the distinct values within are shuffled.
    """
    held = scored.where(F.col(value).isNotNull()).select(*keys, value)
    accuracy = F.lit(int(2 / share))
    quantile = F.percentile_approx(value, [0.5 - share, 0.5, 0.5 + share], accuracy)
    bands = held.groupBy(*keys).agg(quantile.alias("_q"), F.count(F.lit(1)).alias("_n"))
    marked_keys = {f"_key_{i}": F.col(k) for i, k in enumerate(keys)}
    bands = materialize(bands.select(*[c.alias(n) for n, c in marked_keys.items()], "_q", "_n"), "median_bands")
    text = lambda names: F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    bands = bands.select(text([F.col(n).alias(f"k{i}") for i, n in enumerate(marked_keys)]).alias("_group"), "_q", "_n")
    keyed = held.withColumn("_group", text([F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]))
    joined = bounded_join(keyed, bands, ["_group"], [F.col(value)], F.octet_length("_group") + 40)
    v, low, high = F.col(value), F.get("_q", F.lit(0)), F.get("_q", F.lit(2))
    place = F.when(v < low, low).when(v > high, high).otherwise(v)
    counted = (
        joined.withColumns({"_below": (v < low).cast("int"), "_above": (v > high).cast("int"), "_at": place})
        .groupBy(*keys, "_n", "_at")
        .agg(F.sum("_below").alias("_below"), F.sum("_above").alias("_above"), F.count(F.lit(1)).alias("n"))
        .withColumn("n", F.col("n") - F.col("_below") - F.col("_above"))
    )
    below = counted.groupBy(*keys).agg(F.sum("_below").alias("_all_below"))
    summed = running_sums(counted.where("n > 0").select(*keys, "_n", "_at", "n"), keys, "_at", ["n"])
    through = F.col("_all_below") + F.col("n_before") + F.col("n")
    middle_low, middle_high = F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1
    return (
        same_group_join(summed, below, keys)
        .groupBy(*keys)
        .agg(
            F.min(F.when(through >= middle_low, F.col("_at"))).alias("_low"),
            F.min(F.when(through >= middle_high, F.col("_at"))).alias("_high"),
        )
        .select(*keys, ((F.col("_low") + F.col("_high")) / 2).alias("median"))
    )


def distribution(scored: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, median, min, max and population std per group."""
    stats = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.stddev_pop(value).alias("std"),
    )
    return stats.join(medians(scored, keys, value), keys)


def outliers(scored: DataFrame, value: str, k: int = 5, tie: str = "filename") -> DataFrame:
    """Per machine: the k farthest normal and the k closest abnormal recordings."""
    far = first_n(
        scored.where(F.col("label") == "normal"), MACHINE, [F.desc(value), F.asc(tie)], k, [F.col(tie)], "rank"
    )
    close = first_n(
        scored.where(F.col("label") == "abnormal"), MACHINE, [F.asc(value), F.asc(tie)], k, [F.col(tie)], "rank"
    )
    return far.withColumn("kind", F.lit("farthest normal")).unionByName(
        close.withColumn("kind", F.lit("closest abnormal"))
    )


def overlap(scored: DataFrame, value: str, tie: str = "filename") -> DataFrame:
    """Per machine: abnormal recordings closer than the mean normal recording."""
    means = materialize(
        scored.where(F.col("label") == "normal").groupBy(*MACHINE).agg(F.avg(value).alias("mean_normal")),
        "normal_means",
    )
    abnormal = scored.where(F.col("label") == "abnormal").select(*MACHINE, tie, value)
    met = bounded_join(abnormal, means, MACHINE, [F.col(tie)], F.lit(96))
    return met.groupBy(*MACHINE).agg(
        F.first("mean_normal").alias("mean_normal"),
        F.avg(value).alias("mean_abnormal"),
        F.count_if(F.col(value) < F.col("mean_normal")).alias("n_below_normal_mean"),
        F.count(F.lit(1)).alias("n_abnormal"),
    )


def predict(scored: DataFrame, score: str = "health_score", below: float = ABNORMAL_BELOW) -> DataFrame:
    """Add y_pred (1 = abnormal) and the anomaly score."""
    return scored.withColumns(
        {
            "y_pred": F.when(F.col(score) < below, 1).otherwise(0),
            "anomaly_score": 100.0 - F.col(score),
        }
    )


def confusion(predicted: DataFrame) -> DataFrame:
    def cell(t: int, p: int) -> Column:
        return F.count_if((F.col("y_true") == t) & (F.col("y_pred") == p))

    return predicted.agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def _score_counts(scored: DataFrame, score: str, keys: list[str]) -> DataFrame:
    """Distinct thresholds, highest first, with class counts before, at and in total."""
    counted = scored.groupBy(*keys, F.col(score).alias("threshold")).agg(
        F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") == 0).alias("neg")
    )
    return running_sums(counted, keys, "threshold", ["pos", "neg"], descending=True)


def both_classes(counts: DataFrame) -> DataFrame:
    return counts.where((F.col("pos_total") > 0) & (F.col("neg_total") > 0))


def roc_curve(scored: DataFrame, score: str = "anomaly_score", keys: list[str] | None = None) -> DataFrame:
    """(fpr, tpr) after every distinct threshold, plus the starting point (0, 0).

    Empty unless both classes are present. No point is dropped, collinear or not.
    """
    keys = keys or []
    counts = both_classes(_score_counts(scored, score, keys))
    point = F.struct(
        F.col("threshold").cast("double").alias("threshold"),
        ((F.col("neg_before") + F.col("neg")) / F.col("neg_total")).alias("fpr"),
        ((F.col("pos_before") + F.col("pos")) / F.col("pos_total")).alias("tpr"),
    )
    start = F.struct(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    first = (F.col("pos_before") == 0) & (F.col("neg_before") == 0)
    points = F.when(first, F.array(start, point)).otherwise(F.array(point))
    return counts.select(*keys, F.explode(points).alias("_p")).select(*keys, "_p.*")


def roc_auc(scored: DataFrame, score: str = "anomaly_score", keys: list[str] | None = None) -> DataFrame:
    """Area under the ROC curve by trapezoids; no row unless both classes are present."""
    keys = keys or []
    counts = both_classes(_score_counts(scored, score, keys))
    area = F.sum(F.col("neg") * (F.col("pos_before") + F.col("pos") / 2.0))
    sums = counts.groupBy(*keys).agg(
        area.alias("_area"), F.max("pos_total").alias("n_pos"), F.max("neg_total").alias("n_neg")
    )
    present = sums.where(F.col("n_pos").isNotNull())
    return present.select(
        *keys,
        "n_pos",
        "n_neg",
        (F.col("_area") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("auc"),
    )


def pca_coordinates(embedded: DataFrame, vector: str = "vector", k: int = 2, axes: Axes | None = None) -> DataFrame:
    """Add pc1..pck; ``axes`` of an earlier fit spare the pass over the vectors."""
    return coordinates(embedded, axes or fit_axes(embedded, vector, k), vector)


def explained_variance(embedded: DataFrame, vector: str = "vector", k: int = 2, axes: Axes | None = None) -> DataFrame:
    """Share of total variance per component."""
    return variance_shares(embedded.sparkSession, axes or fit_axes(embedded, vector, k))


def trend_series(scored: DataFrame, value: str, order: str, keys: list[str] = MACHINE) -> DataFrame:
    """(machine, 0-based recording index, value) in recording order; ``order`` may be a number, a time or a path."""
    ranges = in_ordered_buckets(scored.select(*keys, order, value), [F.col(order)])
    numbered = number_rows(ranges, keys, [F.col(order)], F.col("_bucket"), "_n")
    return numbered.select(
        *keys, (F.col("_n") - 1).alias("recording_index"), F.col(order), F.col(value).alias("value")
    )
