"""The given tables seen as recordings, paths, signals and scores.

Each view exists twice: as a DataFrame for the queries and as a SQL fragment for the
checks, written independently of the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import number_rows

CLIP = 512  # samples per clip cut from a long signal
SAMPLE_RATE = 16000
SIGNAL_SCALE = 110000.0  # above the largest price, so scaled samples stay inside [-1, 1]
ORDER_BLOCK = 1024  # order keys per bucket when a signal is numbered
CLIP_BITS = 32  # a clip's id is its signal's, moved up by as many bits, and its number


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings with a learned vector: machine = cluster label, every fifth is abnormal.

    Abnormal rows carry a graded shift on the first 16 dimensions.
    """
    emb = table(spark, sf_dir, "embeddings").withColumnRenamed("label", "cluster")
    kind = F.col("cluster") % 4
    abnormal = F.col("vec_id") % 5 == 0
    step = 1 + F.floor(F.col("vec_id") / 5).cast("bigint") % 5
    based = emb.select(
        F.col("vec_id").alias("rec_id"),
        F.when(kind == 0, "fan").when(kind == 1, "pump").when(kind == 2, "valve").otherwise("slider").alias("machine_type"),
        F.concat(F.lit("id_"), F.lpad(F.col("cluster").cast("string"), 2, "0")).alias("machine_id"),
        F.when(abnormal, "abnormal").otherwise("normal").alias("label"),
        F.concat(F.lpad(F.col("vec_id").cast("string"), 8, "0"), F.lit(".wav")).alias("filename"),
        F.when(abnormal, 0.05 * step).otherwise(F.lit(0.0)).alias("_shift"),
        F.col("embedding").cast("array<double>").alias("_raw"),
    )
    moved = F.transform("_raw", lambda x, i: F.when(i < 16, x + F.col("_shift")).otherwise(x))
    return based.withColumn("vector", moved).drop("_raw", "_shift")


REC_SQL = """rec AS (
  SELECT vec_id AS rec_id,
         CASE label % 4 WHEN 0 THEN 'fan' WHEN 1 THEN 'pump' WHEN 2 THEN 'valve' ELSE 'slider' END AS machine_type,
         concat('id_', lpad(CAST(label AS VARCHAR), 2, '0')) AS machine_id,
         CASE WHEN vec_id % 5 = 0 THEN 'abnormal' ELSE 'normal' END AS label,
         concat(lpad(CAST(vec_id AS VARCHAR), 8, '0'), '.wav') AS filename,
         embedding,
         CASE WHEN vec_id % 5 = 0
              THEN CAST(0.05 * (1 + CAST(floor(vec_id / 5) AS BIGINT) % 5) AS DOUBLE) ELSE 0.0 END AS shift
  FROM embeddings)"""

DIM_SQL = """dim AS (
  SELECT rec_id, machine_type, machine_id, label, filename, CAST(i AS INTEGER) AS i,
         CAST(e AS DOUBLE) + CASE WHEN i < 16 THEN CAST(shift AS DOUBLE) ELSE 0 END AS v
  FROM (SELECT *, unnest(range(len(embedding))) AS i, unnest(embedding) AS e FROM rec) t)"""

PROFILE_SQL = """prof AS (
  SELECT machine_type, machine_id, i, count(*) AS n, avg(v) AS mu, stddev_pop(v) AS sd, min(v) AS mn, max(v) AS mx
  FROM dim WHERE label = 'normal' GROUP BY machine_type, machine_id, i)"""

Z_SQL = """z AS (
  SELECT d.*, p.mu, p.sd, CASE WHEN p.sd < 1e-10 THEN 0 ELSE (d.v - p.mu) / p.sd END AS z
  FROM dim d JOIN prof p USING (machine_type, machine_id, i))"""

DRIFT_SQL = """dr AS (
  SELECT rec_id, machine_type, machine_id, label, filename, count(*) AS d,
         sqrt(sum((v - mu) * (v - mu))) AS euclidean_distance,
         sum(abs(v - mu)) AS manhattan_distance,
         CASE WHEN sum(v * v) = 0 OR sum(mu * mu) = 0 THEN 0
              ELSE sum(v * mu) / (sqrt(sum(v * v)) * sqrt(sum(mu * mu))) END AS cosine_similarity,
         sqrt(sum(z * z)) AS norm_euclidean_distance,
         sum(abs(z)) AS norm_manhattan_distance,
         CASE WHEN sum(z * z) = 0 THEN 0 ELSE sum(z) / (sqrt(sum(z * z)) * sqrt(count(*))) END AS norm_cosine_similarity
  FROM z GROUP BY rec_id, machine_type, machine_id, label, filename)"""

HEALTH_SQL = """hn AS (
  SELECT machine_type, machine_id, avg(norm_euclidean_distance) AS healthy_norm
  FROM dr WHERE label = 'normal' GROUP BY machine_type, machine_id),
health0 AS (
  SELECT dr.*, healthy_norm,
         greatest(0.0, least(100.0, 100.0 * (1.0 - norm_euclidean_distance / (2.0 * greatest(healthy_norm, 1e-8))))) AS health_score
  FROM dr JOIN hn USING (machine_type, machine_id)),
health AS (
  SELECT *, printf('%.1f%%', health_score) AS health_percentage,
         CASE WHEN round(health_score, 9) >= 90 THEN 'EXCELLENT' WHEN round(health_score, 9) >= 75 THEN 'GOOD'
              WHEN round(health_score, 9) >= 50 THEN 'WARNING' ELSE 'CRITICAL' END AS health_state
  FROM health0)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative paths with two kinds of malformed rows."""
    rid = F.col("rec_id")
    path = (
        F.when(rid % 13 == 0, F.concat_ws("/", "machine_type", "filename"))
        .when(rid % 11 == 0, F.concat_ws("/", "machine_type", "machine_id", F.lit("unknown"), "filename"))
        .otherwise(F.concat_ws("/", "machine_type", "machine_id", "label", "filename"))
    )
    return recordings(spark, sf_dir).select("rec_id", path.alias("relative_path"))


PATH_SQL = """path_fx AS (
  SELECT rec_id,
         CASE WHEN rec_id % 13 = 0 THEN concat(machine_type, '/', filename)
              WHEN rec_id % 11 = 0 THEN concat(machine_type, '/', machine_id, '/unknown/', filename)
              ELSE concat(machine_type, '/', machine_id, '/', label, '/', filename) END AS relative_path
  FROM rec)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores over all states, with ties, from events; machine = user."""
    ev = table(spark, sf_dir, "events")
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 * (1.0 - F.col("value") / 100.0)))
    return ev.select(
        F.col("event_id").alias("rec_id"),
        F.lit("event").alias("machine_type"),
        F.concat(F.lit("id_"), F.col("user_id").cast("string")).alias("machine_id"),
        "ts",
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("y_true"),
        F.when(F.col("event_type") == "error", "abnormal").otherwise("normal").alias("label"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("filename"),
        F.col("value").alias("norm_euclidean_distance"),
        score.alias("health_score"),
    )


SCORE_SQL = """sc AS (
  SELECT event_id AS rec_id, 'event' AS machine_type, concat('id_', CAST(user_id AS VARCHAR)) AS machine_id, ts,
         CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y_true,
         CASE WHEN event_type = 'error' THEN 'abnormal' ELSE 'normal' END AS label,
         lpad(CAST(event_id AS VARCHAR), 12, '0') AS filename,
         value AS norm_euclidean_distance,
         greatest(0.0, least(100.0, 100.0 * (1.0 - value / 100.0))) AS health_score
  FROM events)"""


def numbered_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form signals: (signal_id, n, v), one signal per supplier, in order-key order."""
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", *order)
    block = F.floor(F.col("l_orderkey") / ORDER_BLOCK)
    numbered = number_rows(lines, ["l_suppkey"], [F.col(c) for c in order], block, "_n")
    return numbered.select(
        F.col("l_suppkey").alias("signal_id"), (F.col("_n") - 1).alias("n"), F.col("l_extendedprice").alias("v")
    )


SAMPLE_SQL = """samples AS (
  SELECT l_suppkey AS signal_id,
         row_number() OVER (PARTITION BY l_suppkey
                            ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS n,
         l_extendedprice AS v
  FROM lineitem)"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings cut from the signals: at most ``CLIP`` samples each, scaled below one.

    A clip is bounded however long its signal is, so it is safe as one array.
    """
    samples = numbered_samples(spark, sf_dir).withColumn("clip", F.floor(F.col("n") / CLIP))
    inside = F.struct((F.col("n") % CLIP).alias("i"), (F.col("v") / SIGNAL_SCALE - 0.5).alias("x"))
    # a fixed number of partitions: what follows is heavy on the processor, not on bytes, and
    # must not be coalesced by size
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = samples.select("signal_id", "clip", inside.alias("s")).repartition(parts, "signal_id", "clip")
    cut = spread.groupBy("signal_id", "clip").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return cut.select(
        (F.shiftleft(F.col("signal_id").cast("long"), CLIP_BITS) + F.col("clip")).alias("rec_id"),
        F.lit(SAMPLE_RATE).alias("sample_rate"),
        F.col("s.x").alias("samples"),
    )


CLIP_SQL = SAMPLE_SQL + f""",
clip AS (
  SELECT signal_id * {1 << CLIP_BITS} + n // {CLIP} AS rec_id, CAST(n % {CLIP} AS INTEGER) AS i,
         v / {SIGNAL_SCALE} - 0.5 AS x
  FROM samples)"""


def signal_chunks(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """Whole signals as recordings, in chunks of ``size`` samples: (rec_id, start, samples)."""
    samples = numbered_samples(spark, sf_dir).withColumn("chunk", F.floor(F.col("n") / size))
    inside = F.struct("n", (F.col("v") / SIGNAL_SCALE - 0.5).alias("x"))
    cut = samples.groupBy("signal_id", "chunk").agg(F.sort_array(F.collect_list(inside)).alias("s"))
    return cut.select(
        F.col("signal_id").alias("rec_id"), (F.col("chunk") * size).cast("long").alias("start"), F.col("s.x").alias("samples")
    )


SIGNAL_SQL = SAMPLE_SQL + f""",
clip AS (SELECT signal_id AS rec_id, CAST(n AS INTEGER) AS i, v / {SIGNAL_SCALE} - 0.5 AS x FROM samples)"""


def sql(body: str, *views: str) -> str:
    """``body`` behind the named view fragments."""
    return "WITH " + ",\n".join(views) + "\n" + body if views else body


REC_VIEWS = (REC_SQL,)
DIM_VIEWS = (REC_SQL, DIM_SQL)
PROFILE_VIEWS = (*DIM_VIEWS, PROFILE_SQL)
DRIFT_VIEWS = (*PROFILE_VIEWS, Z_SQL, DRIFT_SQL)
HEALTH_VIEWS = (*DRIFT_VIEWS, HEALTH_SQL)
PATH_VIEWS = (REC_SQL, PATH_SQL)
SCORE_VIEWS = (SCORE_SQL,)
CLIP_VIEWS = (CLIP_SQL,)
