"""The whole plan on clips: features, store, fusion, projection, profiles, drift, health, explanation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scale import fresh_path, materialize
from ..sources.stores import with_store_key
from . import views as X
from .from_files import full_report
from .health_queries import EXPLAIN_SQL
from .pair_queries import PROJECTED_SQL, layer_sql, rational_head
from .registry import query, rounded
from .wave_queries import ALL_NAMES, FEATURE_VIEWS, SMALL

N_DSP, N_EMBEDDING = len(ALL_NAMES), 64
CLIP_META = ["machine_type", "machine_id", "label"]


def clip_recordings(spark, sf_dir):
    """Clips as decoded recordings of the machine that has the number of their signal."""
    signal = F.shiftright("rec_id", X.CLIP_BITS)
    clips = X.clips(spark, sf_dir).withColumn("signal_id", signal)
    recs = X.recordings(spark, sf_dir).select(F.col("rec_id").alias("signal_id"), *CLIP_META)
    name = F.concat(F.col("rec_id").cast("string"), F.lit(".wav"))
    return clips.join(recs, "signal_id").select(
        *CLIP_META, name.alias("filename"), "sample_rate", "samples", F.lit(None).cast("string").alias("error")
    )


def clip_embeddings(spark, sf_dir, clips):
    """The embedding of every one of ``clips``: that of the recording with its signal's number."""
    keys = with_store_key(clips.drop("samples"))
    signal = F.shiftright(F.col("stem").cast("bigint"), X.CLIP_BITS)
    vectors = X.recordings(spark, sf_dir).select(F.col("rec_id").alias("signal_id"), F.col("vector").alias("embedding"))
    return keys.select(*CLIP_META, "stem", signal.alias("signal_id")).join(vectors, "signal_id")


def unrounded(view: str) -> str:
    """A feature view with digits that leave the values alone."""
    return view.replace(", 5) + 0.0", ", 12) + 0.0")


UNIT_CLIP_SQL = X.CLIP_SQL.replace("clip AS", "raw_clip AS") + """,
clip AS (
  SELECT rec_id, i, CASE WHEN m < 1e-9 THEN x ELSE x / m END AS x
  FROM (SELECT *, max(abs(x)) OVER (PARTITION BY rec_id) AS m FROM raw_clip) t)"""
FUSED_SQL = f"""fused AS (
  SELECT v.rec_id, n.position AS i, CAST(CAST(v.value AS FLOAT) AS DOUBLE) AS v
  FROM (UNPIVOT feature ON {", ".join(ALL_NAMES)} INTO NAME name VALUE value) v
  JOIN (VALUES {", ".join(f"({i}, '{n}')" for i, n in enumerate(ALL_NAMES))}) n(position, name) ON v.name = n.name
  WHERE v.rec_id // {1 << X.CLIP_BITS} IN (SELECT rec_id FROM rec)
  UNION ALL
  SELECT f.rec_id, e.i + {N_DSP}, CAST(CAST(e.v AS FLOAT) AS DOUBLE) FROM feature f JOIN embedded e ON f.rec_id // {1 << X.CLIP_BITS} = e.rec_id)"""
LEARNED_SQL = f"""dim AS (
  SELECT p.rec_id, machine_type, machine_id, label, concat(CAST(p.rec_id AS VARCHAR), '.wav') AS filename, p.i, p.v
  FROM projected p JOIN rec r ON p.rec_id // {1 << X.CLIP_BITS} = r.rec_id)"""
REPORT_VIEWS = (
    UNIT_CLIP_SQL,
    *[unrounded(v) for v in FEATURE_VIEWS[1:]],
    X.REC_SQL,
    X.DIM_SQL.replace("dim AS", "embedded AS", 1),
    FUSED_SQL,
    layer_sql("hidden", "fused", 32, "greatest(0.0, {s})"),
    layer_sql("outer_layer", "hidden", 16),
    PROJECTED_SQL,
    LEARNED_SQL,
    X.PROFILE_SQL,
    X.Z_SQL,
    X.DRIFT_SQL,
    X.HEALTH_SQL,
)
MEASURES = [
    "euclidean_distance", "manhattan_distance", "cosine_similarity",
    "norm_euclidean_distance", "norm_manhattan_distance", "norm_cosine_similarity", "health_score",
]


@query(
    "full_report",
    "H8 H7 S8 V7 K6",
    X.sql(
        f"""SELECT machine_type, machine_id, label, filename, {N_DSP} AS dsp_dim, {N_EMBEDDING} AS embedding_dim, {N_DSP + N_EMBEDDING} AS fused_dim,
       16 AS learned_dim, {", ".join(f"round({m}, 4) + 0.0 AS {m}" for m in MEASURES)}, health_state, {EXPLAIN_SQL} FROM health""",
        *REPORT_VIEWS,
    ),
)
def full(spark, sf_dir):
    head = rational_head((N_DSP + N_EMBEDDING, 32, 16))
    store = fresh_path(spark, "feature_store")
    clips = materialize(clip_recordings(spark, sf_dir), "clips")  # the store reads its recordings twice, the embeddings their keys
    report = full_report(clips, clip_embeddings(spark, sf_dir, clips), head, store, SMALL)
    dims = ["dsp_dim", "embedding_dim", "fused_dim", "learned_dim"]
    causes = F.array_join("possible_causes", "|").alias("possible_causes")
    kept = report.select(*CLIP_META, "filename", *dims, *MEASURES, "health_state", "summary", causes, "recommendation")
    return rounded(kept, *MEASURES, digits=4)
