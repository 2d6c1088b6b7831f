"""Evaluation queries over scored recordings and over the event scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scale import materialize
from ..operators import catalog as C
from ..operators import evaluate as E
from . import views as X
from .health_queries import METRICS, scored
from .registry import query, r6, rounded
from .report import score_recordings

MACHINE = "machine_type, machine_id"


def mean_sql(metric: str, label: str) -> str:
    return f"avg({metric}) FILTER (label = '{label}')"


@query(
    "class_means",
    "E1",
    X.sql(
        f"SELECT {MACHINE}, "
        + ", ".join(f"round({mean_sql(m, c)}, 6) + 0.0 AS {c}_{m}" for m in METRICS for c in ("normal", "abnormal"))
        + f" FROM dr GROUP BY {MACHINE}",
        *X.DRIFT_VIEWS,
    ),
)
def class_means(spark, sf_dir):
    means = E.class_means(scored(spark, sf_dir), METRICS)
    return rounded(means, *[f"{c}_{m}" for m in METRICS for c in ("normal", "abnormal")])


def separation_sql(view: str, metric: str) -> str:
    n, a = mean_sql(metric, "normal"), mean_sql(metric, "abnormal")
    return f"""SELECT {MACHINE}, round(n, 6) + 0.0 AS mean_normal, round(a, 6) + 0.0 AS mean_abnormal,
       round(CASE WHEN n > 0 THEN a / n ELSE 'NaN'::DOUBLE END, 6) + 0.0 AS separation_ratio,
       CASE WHEN a > n THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT {MACHINE}, {n} AS n, {a} AS a FROM {view} GROUP BY {MACHINE}) t WHERE n IS NOT NULL AND a IS NOT NULL"""


def tidy_separation(df):
    return rounded(df, "mean_normal", "mean_abnormal", "separation_ratio")


@query("separation", "E2", X.sql(separation_sql("dr", "norm_euclidean_distance"), *X.DRIFT_VIEWS))
def separation(spark, sf_dir):
    return tidy_separation(E.separation(scored(spark, sf_dir), "norm_euclidean_distance"))


HELD_PROFILE_SQL = X.PROFILE_SQL.replace(
    "FROM dim WHERE label = 'normal'",
    """FROM dim WHERE label = 'normal' AND rec_id NOT IN (
    SELECT rec_id FROM (SELECT rec_id, row_number() OVER (PARTITION BY machine_type, machine_id ORDER BY filename) AS rn
                        FROM rec WHERE label = 'normal') h WHERE rn = 1)""",
)


@query(
    "separation_first_held_out",
    "E2 C6",
    X.sql(
        separation_sql("dr", "euclidean_distance"),
        *X.DIM_VIEWS, HELD_PROFILE_SQL, X.Z_SQL, X.DRIFT_SQL,
    ),
)
def separation_first_held_out(spark, sf_dir):
    recs = C.hold_out_first_normal(X.recordings(spark, sf_dir))
    return tidy_separation(E.separation(score_recordings(recs, recs.where("in_profile")), "euclidean_distance"))


FINAL_SQL = f"""final AS (
  SELECT *, CASE WHEN n_ne > 0 THEN a_ne / n_ne ELSE 0.0 END AS ratio, a_ne > n_ne AND n_h > a_h AS passed FROM (
    SELECT {MACHINE}, {mean_sql('euclidean_distance', 'normal')} AS n_e, {mean_sql('euclidean_distance', 'abnormal')} AS a_e,
           {mean_sql('norm_euclidean_distance', 'normal')} AS n_ne, {mean_sql('norm_euclidean_distance', 'abnormal')} AS a_ne,
           {mean_sql('health_score', 'normal')} AS n_h, {mean_sql('health_score', 'abnormal')} AS a_h
    FROM health GROUP BY {MACHINE}) t)"""


@query(
    "final_evaluation",
    "E3",
    X.sql(
        f"""SELECT {MACHINE}, round(n_e, 6) + 0.0 AS normal_euclidean_distance, round(a_e, 6) + 0.0 AS abnormal_euclidean_distance,
       round(n_ne, 6) + 0.0 AS normal_norm_euclidean_distance, round(a_ne, 6) + 0.0 AS abnormal_norm_euclidean_distance,
       round(n_h, 6) + 0.0 AS normal_health_score, round(a_h, 6) + 0.0 AS abnormal_health_score,
       round(ratio, 6) + 0.0 AS separation_ratio, passed FROM final""",
        *X.HEALTH_VIEWS, FINAL_SQL,
    ),
)
def final_evaluation(spark, sf_dir):
    out = E.final_evaluation(scored(spark, sf_dir))
    return rounded(out, *[c for c in out.columns if c not in ("machine_type", "machine_id", "passed")])


@query(
    "overall_summary",
    "E4",
    X.sql(
        """SELECT count(*) AS n_machines, count(*) FILTER (passed) AS n_pass, count(*) FILTER (NOT passed) AS n_fail,
       round(avg(ratio), 6) + 0.0 AS mean_separation_ratio, round(avg(n_h), 6) + 0.0 AS mean_normal_health,
       round(avg(a_h), 6) + 0.0 AS mean_abnormal_health, bool_and(passed) AS all_passed FROM final""",
        *X.HEALTH_VIEWS, FINAL_SQL,
    ),
)
def overall_summary(spark, sf_dir):
    out = E.overall_summary(E.final_evaluation(scored(spark, sf_dir)))
    return rounded(out, "mean_separation_ratio", "mean_normal_health", "mean_abnormal_health")


@query(
    "raw_versus_normalized",
    "E5",
    X.sql(
        f"""SELECT {MACHINE}, round(ra / rn, 6) + 0.0 AS raw_ratio, round(na / nn, 6) + 0.0 AS normalized_ratio,
       ra > rn AS raw_separates, na > nn AS normalized_separates,
       CASE WHEN ra > rn AND na > nn THEN CASE WHEN ra / rn >= na / nn THEN 'raw' ELSE 'normalized' END
            WHEN ra > rn THEN 'only raw' WHEN na > nn THEN 'only normalized' ELSE 'neither' END AS better
FROM (SELECT {MACHINE}, {mean_sql('euclidean_distance', 'normal')} AS rn, {mean_sql('euclidean_distance', 'abnormal')} AS ra,
             {mean_sql('norm_euclidean_distance', 'normal')} AS nn, {mean_sql('norm_euclidean_distance', 'abnormal')} AS na
      FROM dr GROUP BY {MACHINE}) t WHERE rn IS NOT NULL AND ra IS NOT NULL""",
        *X.DRIFT_VIEWS,
    ),
)
def raw_versus_normalized(spark, sf_dir):
    out = E.compare_representations(scored(spark, sf_dir), "euclidean_distance", "norm_euclidean_distance")
    return rounded(out, "raw_ratio", "normalized_ratio")


DISTRIBUTION_SQL = """round(avg({v}), 6) + 0.0 AS mean, round(median({v}), 6) + 0.0 AS median,
       round(min({v}), 6) + 0.0 AS min, round(max({v}), 6) + 0.0 AS max, round(stddev_pop({v}), 6) + 0.0 AS std"""


@query(
    "distance_distribution",
    "E7",
    X.sql(
        f"SELECT {MACHINE}, label, count(*) AS n, {DISTRIBUTION_SQL.format(v='euclidean_distance')} FROM dr GROUP BY {MACHINE}, label",
        *X.DRIFT_VIEWS,
    ),
)
def distance_distribution(spark, sf_dir):
    distances = materialize(scored(spark, sf_dir).select(*C.MACHINE, "label", "euclidean_distance"), "distances")
    out = E.distribution(distances, [*C.MACHINE, "label"], "euclidean_distance")
    return rounded(out, "mean", "median", "min", "max", "std")


@query(
    "score_distribution",
    "E7",
    X.sql(
        f"SELECT label, count(*) AS n, {DISTRIBUTION_SQL.format(v='health_score')} FROM sc GROUP BY label",
        *X.SCORE_VIEWS,
    ),
)
def score_distribution(spark, sf_dir):
    out = E.distribution(X.scores(spark, sf_dir), ["label"], "health_score")
    return rounded(out, "mean", "median", "min", "max", "std")


@query(
    "outliers",
    "E8",
    X.sql(
        f"""SELECT {MACHINE}, label, filename, kind, CAST(rank AS INTEGER) AS rank, round(euclidean_distance, 6) + 0.0 AS euclidean_distance FROM (
  SELECT *, 'farthest normal' AS kind, row_number() OVER (PARTITION BY {MACHINE} ORDER BY euclidean_distance DESC, filename) AS rank
  FROM dr WHERE label = 'normal'
  UNION ALL
  SELECT *, 'closest abnormal', row_number() OVER (PARTITION BY {MACHINE} ORDER BY euclidean_distance, filename)
  FROM dr WHERE label = 'abnormal') t WHERE rank <= 5""",
        *X.DRIFT_VIEWS,
    ),
)
def outliers(spark, sf_dir):
    distances = scored(spark, sf_dir).select(*C.MACHINE, "label", "filename", "euclidean_distance")
    return rounded(E.outliers(materialize(distances, "distances"), "euclidean_distance"), "euclidean_distance")


@query(
    "overlap",
    "E9",
    X.sql(
        f"""SELECT {MACHINE}, round(any_value(m), 6) + 0.0 AS mean_normal, round(avg(euclidean_distance), 6) + 0.0 AS mean_abnormal,
       count(*) FILTER (euclidean_distance < m) AS n_below_normal_mean, count(*) AS n_abnormal
FROM dr JOIN (SELECT {MACHINE}, avg(euclidean_distance) AS m FROM dr WHERE label = 'normal' GROUP BY {MACHINE}) n USING ({MACHINE})
WHERE label = 'abnormal' GROUP BY {MACHINE}""",
        *X.DRIFT_VIEWS,
    ),
)
def overlap(spark, sf_dir):
    distances = scored(spark, sf_dir).select(*C.MACHINE, "label", "filename", "euclidean_distance")
    return rounded(E.overlap(materialize(distances, "distances"), "euclidean_distance"), "mean_normal", "mean_abnormal")


PRED_SQL = """pred AS (
  SELECT *, CASE WHEN health_score < 50 THEN 1 ELSE 0 END AS y_pred, 100.0 - health_score AS anomaly_score FROM sc)"""


@query(
    "predictions",
    "E10",
    X.sql("SELECT rec_id, y_true, y_pred, round(anomaly_score, 6) + 0.0 AS anomaly_score FROM pred", *X.SCORE_VIEWS, PRED_SQL),
)
def predictions(spark, sf_dir):
    out = E.predict(X.scores(spark, sf_dir))
    return out.select("rec_id", "y_true", "y_pred", r6("anomaly_score").alias("anomaly_score"))


@query(
    "confusion_matrix",
    "E11",
    X.sql(
        """SELECT count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
       count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp FROM pred""",
        *X.SCORE_VIEWS, PRED_SQL,
    ),
)
def confusion_matrix(spark, sf_dir):
    return E.confusion(E.predict(X.scores(spark, sf_dir)))


@query(
    "roc_curve",
    "E12 E14",
    X.sql(
        """SELECT round(threshold, 6) AS threshold, round(sum(neg) OVER w / sum(neg) OVER (), 9) + 0.0 AS fpr,
       round(sum(pos) OVER w / sum(pos) OVER (), 9) + 0.0 AS tpr
FROM (SELECT anomaly_score AS threshold, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 0) AS neg FROM pred GROUP BY 1) t
WINDOW w AS (ORDER BY threshold DESC)
UNION ALL SELECT 'Infinity'::DOUBLE, 0.0, 0.0""",
        *X.SCORE_VIEWS, PRED_SQL,
    ),
)
def roc_curve(spark, sf_dir):
    points = E.roc_curve(E.predict(X.scores(spark, sf_dir)))
    finite = F.when(F.col("threshold") == float("inf"), F.col("threshold")).otherwise(r6("threshold"))
    return rounded(points, "fpr", "tpr", digits=9).withColumn("threshold", finite)


RANK_SUM_SQL = """SELECT {keys} n_pos, n_neg, round((ranks - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 9) + 0.0 AS auc FROM (
  SELECT {keys} sum(r) FILTER (y_true = 1) AS ranks, count(*) FILTER (y_true = 1) AS n_pos, count(*) FILTER (y_true = 0) AS n_neg
  FROM (SELECT *, rank() OVER ({part} ORDER BY anomaly_score) + (count(*) OVER (PARTITION BY {keys} anomaly_score) - 1) / 2.0 AS r FROM pred) a
  {group}) t WHERE n_pos > 0 AND n_neg > 0"""


@query(
    "roc_auc",
    "E13 E14",
    X.sql(RANK_SUM_SQL.format(keys="", part="", group=""), *X.SCORE_VIEWS, PRED_SQL),
)
def roc_auc(spark, sf_dir):
    return rounded(E.roc_auc(E.predict(X.scores(spark, sf_dir))), "auc", digits=9)


@query(
    "roc_auc_by_machine",
    "E13 E14",
    X.sql(
        RANK_SUM_SQL.format(keys="machine_id,", part="PARTITION BY machine_id", group="GROUP BY machine_id"),
        *X.SCORE_VIEWS, PRED_SQL,
    ),
)
def roc_auc_by_machine(spark, sf_dir):
    return rounded(E.roc_auc(E.predict(X.scores(spark, sf_dir)), keys=["machine_id"]), "auc", digits=9)


def principal_axis_sql(k: int, matrix: str, squarings: int = 16) -> list[str]:
    """The leading axis of ``matrix`` by repeated squaring, and the matrix without it."""
    first = f"m{k}_0 AS MATERIALIZED (SELECT i, j, c / max(abs(c)) OVER () AS c FROM {matrix})"
    squares = [
        f"""m{k}_{t} AS MATERIALIZED (SELECT i, j, c / max(abs(c)) OVER () AS c FROM (
  SELECT a.i, b.j, sum(a.c * b.c) AS c FROM m{k}_{t - 1} a JOIN m{k}_{t - 1} b ON a.j = b.i GROUP BY a.i, b.j) t)"""
        for t in range(1, squarings + 1)
    ]
    last = f"m{k}_{squarings}"
    axis = f"""axis{k} AS MATERIALIZED (
  SELECT i, a / sqrt(sum(a * a) OVER ()) * sign(max_by(a, abs(a)) OVER ()) AS a
  FROM (SELECT i, c AS a FROM {last} WHERE j = (SELECT i FROM {last} WHERE i = j ORDER BY c DESC, i LIMIT 1)) t)"""
    size = f"size{k} AS MATERIALIZED (SELECT sum(x.a * m.c * y.a) AS l FROM {matrix} m JOIN axis{k} x ON x.i = m.i JOIN axis{k} y ON y.i = m.j)"
    rest = f"""rest{k} AS MATERIALIZED (
  SELECT m.i, m.j, m.c - l * x.a * y.a AS c FROM {matrix} m JOIN axis{k} x ON x.i = m.i JOIN axis{k} y ON y.i = m.j, size{k})"""
    return [first, *squares, axis, size, rest]


PCA_VIEWS = (
    *X.DIM_VIEWS,
    "centred AS MATERIALIZED (SELECT rec_id, label, i, v - avg(v) OVER (PARTITION BY i) AS v FROM dim)",
    """cov AS MATERIALIZED (
  SELECT a.i, b.i AS j, sum(a.v * b.v) / (count(*) - 1) AS c FROM centred a JOIN centred b USING (rec_id) GROUP BY a.i, b.i)""",
    *principal_axis_sql(1, "cov"),
    *principal_axis_sql(2, "rest1"),
)


@query(
    "pca_coordinates",
    "E15",
    X.sql(
        """SELECT rec_id, label, round(sum(v * axis1.a), 6) + 0.0 AS pc1, round(sum(v * axis2.a), 6) + 0.0 AS pc2
FROM centred JOIN axis1 USING (i) JOIN axis2 USING (i) GROUP BY rec_id, label""",
        *PCA_VIEWS,
    ),
)
def pca_coordinates(spark, sf_dir):
    recs = X.recordings(spark, sf_dir)
    return rounded(E.pca_coordinates(recs).select("rec_id", "label", "pc1", "pc2"), "pc1", "pc2")


@query(
    "pca_explained_variance",
    "E15",
    X.sql(
        """SELECT component, round(l / (SELECT sum(c) FROM cov WHERE i = j), 6) + 0.0 AS explained_variance_ratio
FROM (SELECT 1 AS component, l FROM size1 UNION ALL SELECT 2, l FROM size2) t""",
        *PCA_VIEWS,
    ),
)
def pca_explained_variance(spark, sf_dir):
    return rounded(E.explained_variance(X.recordings(spark, sf_dir)), "explained_variance_ratio")


@query(
    "health_trend",
    "E16",
    X.sql(
        f"""SELECT {MACHINE}, rec_id, row_number() OVER (PARTITION BY {MACHINE} ORDER BY rec_id) - 1 AS recording_index,
       round(health_score, 6) + 0.0 AS value FROM health""",
        *X.HEALTH_VIEWS,
    ),
)
def health_trend(spark, sf_dir):
    series = materialize(scored(spark, sf_dir).select(*C.MACHINE, "rec_id", "health_score"), "series")
    return rounded(E.trend_series(series, "health_score", "rec_id"), "value")


@query(
    "drift_trend",
    "E16",
    X.sql(
        f"""SELECT {MACHINE}, rec_id, row_number() OVER (PARTITION BY {MACHINE} ORDER BY rec_id) - 1 AS recording_index,
       round(norm_euclidean_distance, 6) + 0.0 AS value FROM sc""",
        *X.SCORE_VIEWS,
    ),
)
def drift_trend(spark, sf_dir):
    return rounded(E.trend_series(X.scores(spark, sf_dir), "norm_euclidean_distance", "rec_id"), "value")
