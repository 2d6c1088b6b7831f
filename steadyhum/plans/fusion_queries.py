"""Vector checks, fingerprints, embeddings and fusion over recordings and clips."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import total
from ..operators import features as FT
from ..operators import fusion as FU
from . import views as X
from .registry import query, r6
from .report import health_report, report_violations
from .wave_queries import FXOK, OK, TEMPORAL_SQL, temporal

REC = "rec_id, machine_type, machine_id, label, filename"


def spoiled(spark, sf_dir):
    """Recordings with NaN, infinite and short vectors and blank metadata at known rows."""
    rid = F.col("rec_id")
    nan = F.lit(float("nan"))
    inf = F.lit(float("inf"))
    bad = F.transform(
        "vector",
        lambda x, i: F.when((i == 3) & (rid % 17 == 0), nan).when((i == 5) & (rid % 29 == 0), inf).otherwise(x),
    )
    size = F.when(rid % 19 == 0, 63).otherwise(64)
    return X.recordings(spark, sf_dir).withColumns(
        {
            "feature_names": F.transform("vector", lambda x, i: F.concat(F.lit("f"), i.cast("string"))),
            "vector": F.slice(bad, F.lit(1), size),
            "machine_id": F.when(rid % 31 == 0, F.lit(" ")).otherwise(F.col("machine_id")),
            "filename": F.when(rid % 37 == 0, F.lit(None)).otherwise(F.col("filename")),
        }
    )


@query(
    "metadata_violations",
    "V1",
    X.sql(
        """SELECT rec_id, 'empty machine_id' AS violation FROM rec WHERE rec_id % 31 = 0
UNION ALL SELECT rec_id, 'empty filename' FROM rec WHERE rec_id % 37 = 0""",
        *X.REC_VIEWS,
    ),
)
def metadata_violations(spark, sf_dir):
    return FU.metadata_violations(spoiled(spark, sf_dir), ["rec_id"])


@query(
    "vector_violations",
    "V2",
    X.sql(
        """SELECT rec_id, 'NaN values' AS violation FROM rec WHERE rec_id % 17 = 0
UNION ALL SELECT rec_id, 'infinite values' FROM rec WHERE rec_id % 29 = 0
UNION ALL SELECT rec_id, 'length differs from names' FROM rec WHERE rec_id % 19 = 0""",
        *X.REC_VIEWS,
    ),
)
def vector_violations(spark, sf_dir):
    return FU.vector_violations(spoiled(spark, sf_dir), ["rec_id"], names="feature_names")


@query(
    "fingerprints",
    "V3",
    X.sql(
        f"""SELECT {REC}, CAST(count(*) AS INTEGER) AS dimension, round(sum(v), 4) + 0.0 AS total FROM dim
WHERE rec_id % 17 <> 0 AND rec_id % 19 <> 0 AND rec_id % 29 <> 0 AND rec_id % 31 <> 0 AND rec_id % 37 <> 0 GROUP BY {REC}""",
        *X.DIM_VIEWS,
    ),
)
def fingerprints(spark, sf_dir):
    rows = spoiled(spark, sf_dir)
    features = rows.select("rec_id", "feature_names", F.col("vector").alias("feature_vector"))
    built = FU.build_fingerprints(features, rows)
    return built.select(*REC.split(", "), F.size("feature_vector").alias("dimension"), r6(total(F.col("feature_vector")), 4).alias("total"))


@query(
    "mean_pooled_frames",
    "V4",
    X.sql(
        """SELECT rec_id, CAST(i % 16 AS INTEGER) AS dim, round(avg(v), 6) + 0.0 AS value FROM dim GROUP BY rec_id, i % 16""",
        *X.DIM_VIEWS,
    ),
)
def mean_pooled_frames(spark, sf_dir):
    """Each 64-dim vector read as four frames of 16."""
    recs = X.recordings(spark, sf_dir)
    frames = recs.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(
        "rec_id", F.slice("vector", F.col("t") * 16 + 1, F.lit(16)).alias("vector")
    )
    return FU.mean_pool(frames, ["rec_id"]).select("rec_id", F.posexplode("vector").alias("dim", "value")).withColumn("value", r6("value"))


def embedding_table(spark, sf_dir):
    """Embeddings that have arrived: every ninth recording has none."""
    return X.recordings(spark, sf_dir).where("rec_id % 9 <> 0").select("rec_id", F.col("vector").alias("embedding"))


@query(
    "report_outcomes",
    "H8 V2",
    X.sql(
        """SELECT rec_id, CASE WHEN rec_id % 17 = 0 THEN 'NaN values' WHEN rec_id % 29 = 0 THEN 'infinite values'
       WHEN rec_id % 19 = 0 THEN 'length differs from the profile' ELSE 'scored' END AS outcome FROM rec""",
        *X.REC_VIEWS,
    ),
)
def report_outcomes(spark, sf_dir):
    """What becomes of every recording when some vectors are spoiled: a score or a violation."""
    recs = X.recordings(spark, sf_dir).drop("vector").join(spoiled(spark, sf_dir).select("rec_id", "vector"), "rec_id")
    members = recs.where("label = 'normal'")
    scored = health_report(recs, members).select("rec_id", F.lit("scored").alias("outcome"))
    return scored.unionByName(report_violations(recs, members, ["rec_id"]).withColumnRenamed("violation", "outcome"))


@query("attach_embeddings", "V6", X.sql(f"SELECT {REC}, 64 AS embedding_dim FROM rec WHERE rec_id % 9 <> 0", *X.REC_VIEWS))
def attach_embeddings(spark, sf_dir):
    recs = X.recordings(spark, sf_dir).drop("vector")
    joined = FU.attach_embeddings(recs, embedding_table(spark, sf_dir))
    return FU.dimensions(joined, {"embedding_dim": "embedding"}).drop("embedding")


@query("missing_embeddings", "V6", X.sql(f"SELECT {REC} FROM rec WHERE rec_id % 9 = 0", *X.REC_VIEWS))
def missing_embeddings(spark, sf_dir):
    recs = X.recordings(spark, sf_dir).drop("vector")
    return FU.without_embedding(recs, embedding_table(spark, sf_dir))


def fused_table(spark, sf_dir):
    """Temporal features of every clip with the embedding of the recording of its signal's number."""
    names = list(FT.TEMPORAL)
    features = FT.feature_vector(temporal(spark, sf_dir), names)
    features = features.withColumn("signal_id", F.shiftright("rec_id", X.CLIP_BITS))
    embeddings = embedding_table(spark, sf_dir).withColumnRenamed("rec_id", "signal_id")
    return FU.attach_embeddings(features, embeddings, "signal_id")


FUSED_SQL = f"""ready AS (SELECT rec_id // {1 << X.CLIP_BITS} AS rid, * FROM temporal),
fused AS (
  SELECT rec_id, p.position, CASE p.position WHEN 0 THEN rms_mean WHEN 1 THEN rms_std WHEN 2 THEN rms_max
         WHEN 3 THEN ste_mean WHEN 4 THEN ste_std ELSE dynamic_range_db END AS value
  FROM ready, (SELECT unnest(range(6)) AS position) p WHERE rid IN (SELECT vec_id FROM embeddings WHERE vec_id % 9 <> 0)
  UNION ALL
  SELECT ready.rec_id, d.i + 6, d.v FROM dim d JOIN ready ON rid = d.rec_id WHERE d.rec_id % 9 <> 0)"""
FUSED_VIEWS = (*OK, FXOK, TEMPORAL_SQL, *X.DIM_VIEWS, FUSED_SQL)


@query(
    "fused_vectors",
    "V7",
    X.sql("SELECT rec_id, CAST(position AS INTEGER) AS position, round(value, 3) + 0.0 AS value FROM fused", *FUSED_VIEWS),
)
def fused_vectors(spark, sf_dir):
    fused = FU.fuse(fused_table(spark, sf_dir), embedding_dim=64)
    rows = fused.select("rec_id", F.posexplode("fused_vector").alias("position", "value"))
    return rows.withColumn("value", r6(F.col("value").cast("double"), 3))


@query(
    "fusion_violations",
    "V7",
    X.sql(
        """SELECT rec_id, 'embedding: NaN values' AS violation FROM rec WHERE rec_id % 17 = 0
UNION ALL SELECT rec_id, 'embedding: infinite values' FROM rec WHERE rec_id % 29 = 0
UNION ALL SELECT rec_id, 'embedding: length is not 64' FROM rec WHERE rec_id % 19 = 0""",
        *X.REC_VIEWS,
    ),
)
def fusion_violations(spark, sf_dir):
    rows = spoiled(spark, sf_dir).select("rec_id", F.array(F.lit(1.0)).alias("feature_vector"), F.col("vector").alias("embedding"))
    return FU.fusion_violations(rows, ["rec_id"], embedding_dim=64)


@query(
    "vector_dimensions",
    "V8",
    X.sql("SELECT DISTINCT rec_id, 6 AS dsp_dim, 64 AS embedding_dim, 70 AS fused_dim FROM fused", *FUSED_VIEWS),
)
def vector_dimensions(spark, sf_dir):
    fused = FU.fuse(fused_table(spark, sf_dir), embedding_dim=64)
    sized = FU.dimensions(fused, {"dsp_dim": "feature_vector", "embedding_dim": "embedding", "fused_dim": "fused_vector"})
    return sized.select("rec_id", "dsp_dim", "embedding_dim", "fused_dim")
