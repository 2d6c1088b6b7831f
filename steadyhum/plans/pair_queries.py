"""Pairs, batches, projection, loss and training over the recordings view."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.scale import fresh_path, materialize
from ..functions.vectors import unit
from ..operators import pairs as PR
from ..operators import projection as PJ
from ..operators.profile import build_profile
from ..operators.training import Adam, TrainingConfig, fit, step_gradient, task_slots, train_epoch, with_vectors
from . import views as X
from .catalog_queries import round_trip_summary
from .registry import query, rounded

SEED = 42
BATCH = 16


def hash_sql(key: str, seed: int) -> str:
    return f"(CAST('0x' || substr(md5(concat(CAST({key} AS BIGINT), ':{seed}')), 1, 15) AS BIGINT) % 2147483647)"


INDEX_SQL = f"""normals AS (SELECT *, {hash_sql('rec_id', SEED)} AS h FROM rec WHERE label = 'normal'),
sizes AS (
  SELECT machine_type, machine_id, count(*) AS n, md5(concat(machine_type, '/', machine_id)) AS m FROM normals GROUP BY machine_type, machine_id),
blocks AS (
  SELECT *, CAST(sum(n) OVER (ORDER BY m) - n AS BIGINT) AS start, CAST(sum(n) OVER () AS BIGINT) AS n_all FROM sizes),
idx AS (
  SELECT rec_id, machine_type, machine_id, n, start, n_all,
         row_number() OVER (PARTITION BY machine_type, machine_id ORDER BY h, rec_id) - 1 AS pos
  FROM normals JOIN blocks USING (machine_type, machine_id))"""
POSITIVE_SQL = f"""positive AS (
  SELECT a.rec_id AS anchor_id, b.rec_id AS paired_id, 1 AS label, 0 AS draw FROM idx a JOIN idx b
    ON a.machine_type = b.machine_type AND a.machine_id = b.machine_id
   AND b.pos = (a.pos + 1 + ({hash_sql('a.rec_id', SEED + 1)}) % (a.n - 1)) % a.n WHERE a.n >= 2)"""
NEGATIVE_SQL = f"""drawn AS (
  SELECT i.rec_id, i.n, i.start, k.draw, (({hash_sql('i.rec_id', SEED + 2)}) % (n_all - n) + k.draw * ((n_all - n) // least(3, n_all - n))) % (n_all - n) AS place
  FROM idx i, (SELECT CAST(unnest(range(3)) AS INTEGER) AS draw) k WHERE n_all > n AND k.draw < least(3, n_all - n)),
negative AS (
  SELECT d.rec_id AS anchor_id, b.rec_id AS paired_id, 0 AS label, draw FROM drawn d JOIN idx b
    ON b.start + b.pos = CASE WHEN place < d.start THEN place ELSE place + d.n END)"""
PAIR_SQL = "pairs AS (SELECT * FROM positive UNION ALL SELECT * FROM negative)"
POSITIVE_VIEWS = (X.REC_SQL, INDEX_SQL, POSITIVE_SQL)
PAIR_VIEWS = (*POSITIVE_VIEWS, NEGATIVE_SQL, PAIR_SQL)
PAIR_COLUMNS = "anchor_id, paired_id, label, draw"


def normals(spark, sf_dir):
    return X.recordings(spark, sf_dir).where("label = 'normal'")


def index(spark, sf_dir):
    return materialize(PR.indexed(normals(spark, sf_dir).drop("vector"), SEED), "pair_index")


@query("positive_pairs", "K1", X.sql(f"SELECT {PAIR_COLUMNS} FROM positive", *POSITIVE_VIEWS))
def positive_pairs(spark, sf_dir):
    return PR.positive_pairs(index(spark, sf_dir), SEED)


@query("negative_pairs", "K2", X.sql(f"SELECT {PAIR_COLUMNS} FROM negative", *PAIR_VIEWS))
def negative_pairs(spark, sf_dir):
    return PR.negative_pairs(index(spark, sf_dir), SEED)


def all_pairs(spark, sf_dir):
    return materialize(PR.build_pairs(normals(spark, sf_dir).drop("vector"), SEED), "pairs")


@query(
    "balanced_pairs",
    "K3",
    X.sql(
        f"""SELECT {PAIR_COLUMNS}, {hash_sql('anchor_id * 8 + draw * 2 + label', SEED + 4)} AS shuffle_key FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY draw, {hash_sql('anchor_id', SEED + 3)}, anchor_id) AS rn FROM pairs) t
WHERE rn <= (SELECT least(count(*) FILTER (label = 1), count(*) FILTER (label = 0)) FROM pairs)""",
        *PAIR_VIEWS,
    ),
)
def balanced_pairs(spark, sf_dir):
    return PR.balance(all_pairs(spark, sf_dir), SEED)


SPLIT_SQL = f"""split AS (
  SELECT {PAIR_COLUMNS}, row_number() OVER (ORDER BY {hash_sql('anchor_id', SEED + 5)}, anchor_id)
         <= greatest(1, floor((SELECT count(*) FROM positive) * CAST(0.2 AS DOUBLE))) AS is_validation FROM positive)"""


@query("validation_split", "K4", X.sql(f"SELECT {PAIR_COLUMNS}, is_validation FROM split", *POSITIVE_VIEWS, SPLIT_SQL))
def validation_split(spark, sf_dir):
    return PR.split_validation(positive_pairs(spark, sf_dir), 0.2, SEED)


@query(
    "split_violations",
    "K4",
    X.sql(
        """SELECT customer, n AS n_positive, CASE WHEN n < 2 THEN 'fewer than two positive pairs' ELSE 'fewer than two training pairs' END AS violation
FROM (SELECT o_custkey AS customer, count(*) AS n FROM orders GROUP BY o_custkey) t WHERE n < 3""",
    ),
)
def split_violations(spark, sf_dir):
    """Orders as pairs, one set per customer; some customers have too few."""
    pairs = X.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("anchor_id"), F.col("o_custkey").alias("customer"))
    return PR.split_violations(pairs, keys=["customer"])


BATCH_SQL = f"""batched AS (
  SELECT anchor_id, paired_id, (rn - 1) // {BATCH} AS batch, (rn - 1) % {BATCH} AS batch_position FROM (
    SELECT *, row_number() OVER (ORDER BY {hash_sql('anchor_id', SEED)}, anchor_id) AS rn, count(*) OVER () AS n FROM positive) t
  WHERE least({BATCH}, n - (rn - 1) // {BATCH} * {BATCH}) >= 2)"""


def batched(spark, sf_dir):
    return PR.batches(positive_pairs(spark, sf_dir), BATCH, SEED)


@query("mini_batches", "K5", X.sql("SELECT anchor_id, paired_id, batch, batch_position FROM batched", *POSITIVE_VIEWS, BATCH_SQL))
def mini_batches(spark, sf_dir):
    return batched(spark, sf_dir).select("anchor_id", "paired_id", "batch", "batch_position")


def rational_head(dims=(64, 32, 16)) -> PJ.Head:
    """Weights from a fixed rule, the same as in the checking SQL."""
    d, h, o = dims

    def layer(units: int, inputs: int) -> np.ndarray:
        j, i = np.arange(units)[:, None], np.arange(inputs)[None, :]
        return ((i * 31 + j * 17) % 101 - 50) / 500.0

    def bias(units: int) -> np.ndarray:
        return (np.arange(units) * 13 % 29 - 14) / 100.0

    return PJ.Head(layer(h, d), bias(h), layer(o, h), bias(o))


WEIGHT_SQL = "(((x.i * 31 + u.j * 17) % 101) - 50) / 500.0"
BIAS_SQL = "CAST(u.j * 13 % 29 - 14 AS DOUBLE) / 100"


def layer_sql(name: str, source: str, units: int, outer: str = "{s}") -> str:
    dot = outer.format(s=f"(sum(x.v * {WEIGHT_SQL}) + {BIAS_SQL})")
    return f"""{name} AS (
  SELECT x.rec_id, u.j AS i, {dot} AS v FROM {source} x, (SELECT unnest(range({units})) AS j) u GROUP BY x.rec_id, u.j)"""


PROJECTED_SQL = """projected AS (
  SELECT rec_id, CAST(i AS INTEGER) AS i, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY rec_id)), 1e-12) AS v FROM outer_layer)"""
PROJECT_VIEWS = (
    *X.DIM_VIEWS,
    layer_sql("hidden", "dim", 32, "greatest(0.0, {s})"),
    layer_sql("outer_layer", "hidden", 16),
    PROJECTED_SQL,
)


def projected(spark, sf_dir):
    return PJ.project(X.recordings(spark, sf_dir), rational_head(), "vector")


@query("projection", "K6", X.sql("SELECT rec_id, i AS dim, round(v, 6) + 0.0 AS value FROM projected", *PROJECT_VIEWS))
def projection(spark, sf_dir):
    rows = projected(spark, sf_dir).select("rec_id", F.posexplode("embedding").alias("dim", "value"))
    return rounded(rows, "value")


@query(
    "projection_violations",
    "K7",
    X.sql(
        """SELECT rec_id, 'NaN values' AS violation FROM rec WHERE rec_id % 17 = 0
UNION ALL SELECT rec_id, 'wrong dimension' FROM rec WHERE rec_id % 19 = 0
UNION ALL SELECT rec_id, 'not unit length' FROM (
  SELECT rec_id, sqrt(sum(CASE WHEN rec_id % 19 = 0 AND i = 15 THEN 0 ELSE v * v END)) * CASE WHEN rec_id % 13 = 0 THEN 1.01 ELSE 1 END AS n
  FROM projected GROUP BY rec_id) t WHERE abs(n - 1) > 1e-3 OR rec_id % 17 = 0""",
        *PROJECT_VIEWS,
    ),
)
def projection_violations(spark, sf_dir):
    rid = F.col("rec_id")
    scale = F.when(rid % 13 == 0, 1.01).otherwise(1.0)
    size = F.when(rid % 19 == 0, 15).otherwise(16)
    changed = F.transform(
        "embedding", lambda x, i: F.when((i == 3) & (rid % 17 == 0), F.lit(float("nan"))).otherwise(x * scale)
    )
    rows = projected(spark, sf_dir).withColumn("embedding", F.slice(changed, F.lit(1), size))
    return PJ.projection_violations(rows, ["rec_id"], 16)


def paired_units(spark, sf_dir):
    units = X.recordings(spark, sf_dir).select("rec_id", unit(F.col("vector")).alias("u"))
    a = units.select(F.col("rec_id").alias("anchor_id"), F.col("u").alias("a"))
    b = units.select(F.col("rec_id").alias("paired_id"), F.col("u").alias("b"))
    return batched(spark, sf_dir).join(a, "anchor_id").join(b, "paired_id")


MEMBER_SQL = """member AS (
  SELECT batch, batch_position AS p, 0 AS side, anchor_id AS rec_id FROM batched
  UNION ALL SELECT batch, batch_position, 1, paired_id FROM batched)"""
LOSS_VIEWS = (
    *X.DIM_VIEWS, INDEX_SQL, POSITIVE_SQL, BATCH_SQL,
    "units AS (SELECT rec_id, i, v / sqrt(sum(v * v) OVER (PARTITION BY rec_id)) AS v FROM dim)",
    MEMBER_SQL,
    """sim AS (
  SELECT a.batch, a.p, a.side, b.p AS p2, b.side AS side2, sum(x.v * y.v) / 0.1 AS s
  FROM member a JOIN member b ON a.batch = b.batch AND (a.p <> b.p OR a.side <> b.side)
  JOIN units x ON x.rec_id = a.rec_id JOIN units y ON y.rec_id = b.rec_id AND y.i = x.i
  GROUP BY a.batch, a.p, a.side, b.p, b.side)""",
)


@query(
    "contrastive_loss",
    "K9",
    X.sql(
        """SELECT batch, CAST(count(*) / 2 AS BIGINT) AS n_pairs, round(avg(l), 6) + 0.0 AS loss FROM (
  SELECT batch, p, side, ln(sum(exp(s - m))) + any_value(m) - sum(s) FILTER (p2 = p) AS l
  FROM (SELECT *, max(s) OVER (PARTITION BY batch, p, side) AS m FROM sim) t GROUP BY batch, p, side) u GROUP BY batch""",
        *LOSS_VIEWS,
    ),
)
def contrastive_loss(spark, sf_dir):
    return rounded(PJ.nt_xent(paired_units(spark, sf_dir)), "loss")


@query(
    "batch_violations",
    "K10",
    X.sql(
        """SELECT batch, 'NaN or infinite values' AS violation FROM batched GROUP BY batch HAVING bool_or(anchor_id % 29 = 1)
UNION ALL SELECT batch, 'lengths differ' FROM batched GROUP BY batch HAVING bool_or(paired_id % 31 = 1)
UNION ALL SELECT batch, 'temperature not positive' FROM batched WHERE batch % 3 = 0 GROUP BY batch
UNION ALL SELECT batch, 'fewer than two pairs' FROM batched WHERE batch % 5 <> 0 OR batch_position = 0 GROUP BY batch HAVING count(*) < 2""",
        *POSITIVE_VIEWS, BATCH_SQL,
    ),
)
def batch_violations(spark, sf_dir):
    """Batches spoiled at known rows; every fifth keeps its first pair only."""
    pairs = paired_units(spark, sf_dir).where("batch % 5 <> 0 OR batch_position = 0")
    kept = batched(spark, sf_dir)
    nan_batches = kept.where("anchor_id % 29 = 1").select("batch").distinct().withColumn("nan", F.lit(True))
    short_batches = kept.where("paired_id % 31 = 1").select("batch").distinct().withColumn("short", F.lit(True))
    marked = pairs.join(nan_batches, "batch", "left").join(short_batches, "batch", "left")
    a = F.transform("a", lambda x, i: F.when((i == 0) & F.col("nan"), F.lit(float("nan"))).otherwise(x))
    b = F.slice("b", F.lit(1), F.when(F.col("short"), 63).otherwise(64))
    temperature = F.when(F.col("batch") % 3 == 0, 0.0).otherwise(0.1)
    return PR.batch_violations(marked.withColumns({"a": a, "b": b}), temperature=temperature)


SMALL_TRAINING = TrainingConfig(hidden=32, output=16, batch_size=64, epochs=2, gradient_blocks=4)


@query("training_history", "K11")
def training_history(spark, sf_dir):
    _, history = fit(positive_pairs(spark, sf_dir), X.recordings(spark, sf_dir), SMALL_TRAINING)
    return history


STEP_VIEWS = (
    *PROJECT_VIEWS, INDEX_SQL, POSITIVE_SQL, BATCH_SQL, MEMBER_SQL,
    """near AS (
  SELECT a.batch, a.p, a.side, b.p AS p2, b.side AS side2, sum(x.v * y.v) / 0.1 AS s
  FROM member a JOIN member b ON a.batch = b.batch AND (a.p <> b.p OR a.side <> b.side)
  JOIN projected x ON x.rec_id = a.rec_id JOIN projected y ON y.rec_id = b.rec_id AND y.i = x.i
  GROUP BY a.batch, a.p, a.side, b.p, b.side)""",
    """soft AS (
  SELECT *, exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY batch, p, side) AS q, 1 + count(*) OVER (PARTITION BY batch, p, side) AS n2
  FROM (SELECT *, max(s) OVER (PARTITION BY batch, p, side) AS m FROM near) t)""",
    "pull AS (SELECT batch, p, side, p2, side2, (q - CASE WHEN p = p2 THEN 1 ELSE 0 END) / n2 AS g FROM soft)",
    """d_unit AS (
  SELECT a.batch, a.p, a.side, z.i, sum((a.g + b.g) * z.v) / 0.1 AS v
  FROM pull a JOIN pull b ON b.batch = a.batch AND b.p = a.p2 AND b.side = a.side2 AND b.p2 = a.p AND b.side2 = a.side
  JOIN member m ON m.batch = a.batch AND m.p = a.p2 AND m.side = a.side2 JOIN projected z ON z.rec_id = m.rec_id
  GROUP BY a.batch, a.p, a.side, z.i)""",
    """d_out AS (
  SELECT d.batch, d.p, d.side, m.rec_id, d.i, (d.v - sum(d.v * z.v) OVER (PARTITION BY d.batch, d.p, d.side) * z.v) / r.l AS v
  FROM d_unit d JOIN member m USING (batch, p, side) JOIN projected z ON z.rec_id = m.rec_id AND z.i = d.i
  JOIN (SELECT rec_id, sqrt(sum(v * v)) AS l FROM outer_layer GROUP BY rec_id) r ON r.rec_id = m.rec_id)""",
    """d_hidden AS (
  SELECT d.batch, d.p, d.side, d.rec_id, x.i, sum(d.v * ((((x.i * 31 + d.i * 17) % 101) - 50) / 500.0)) AS v
  FROM d_out d JOIN hidden x ON x.rec_id = d.rec_id WHERE x.v > 0 GROUP BY d.batch, d.p, d.side, d.rec_id, x.i)""",
    "n_batch AS (SELECT count(DISTINCT batch) AS nb FROM batched)",
    """slope AS (
  SELECT 1 AS layer, d.i AS unit, x.i + 1 AS position, sum(d.v * x.v) AS g FROM d_hidden d JOIN dim x ON x.rec_id = d.rec_id GROUP BY d.i, x.i
  UNION ALL SELECT 1, i, 0, sum(v) FROM d_hidden GROUP BY i
  UNION ALL SELECT 2, d.i, x.i + 1, sum(d.v * x.v) FROM d_out d JOIN hidden x ON x.rec_id = d.rec_id GROUP BY d.i, x.i
  UNION ALL SELECT 2, i, 0, sum(v) FROM d_out GROUP BY i)""",
    """place AS (
  SELECT 1 AS layer, u.j AS unit, q.position FROM (SELECT unnest(range(32)) AS j) u, (SELECT unnest(range(65)) AS position) q
  UNION ALL SELECT 2, u.j, q.position FROM (SELECT unnest(range(16)) AS j) u, (SELECT unnest(range(33)) AS position) q)""",
)


@query(
    "training_step",
    "K11",
    X.sql(
        """SELECT CAST(layer AS INTEGER) AS layer, CAST(unit AS INTEGER) AS unit, CAST(position AS INTEGER) AS position,
       round(coalesce(g, 0) / nb, 6) + 0.0 AS gradient FROM place LEFT JOIN slope USING (layer, unit, position), n_batch
UNION ALL SELECT 0, 0, 0, round(avg(l), 6) + 0.0 FROM (SELECT batch, -avg(ln(q)) FILTER (p = p2) AS l FROM soft GROUP BY batch) t""",
        *STEP_VIEWS,
    ),
)
def training_step(spark, sf_dir):
    """Loss (layer 0) and gradient of one step over all batches; position 0 is a unit's bias."""
    arranged = with_vectors(batched(spark, sf_dir), X.recordings(spark, sf_dir))
    grads, loss, _ = step_gradient(arranged, rational_head(), SMALL_TRAINING)
    units = PJ.weights_table(spark, PJ.Head(*grads), "gradient")
    values = F.posexplode(F.concat(F.array("bias"), F.col("weights"))).alias("position", "gradient")
    first = spark.createDataFrame([(0, 0, 0, loss)], "layer int, unit int, position int, gradient double")
    return rounded(units.select("layer", "unit", values).unionByName(first), "gradient")


HALVES_SQL = """halves AS (
  SELECT anchor_id, paired_id, pos * 2 // n AS batch, row_number() OVER (PARTITION BY pos * 2 // n ORDER BY pos) - 1 AS batch_position
  FROM (SELECT *, batch * 16 + batch_position AS pos, count(*) OVER () AS n FROM batched) t),
half AS (
  SELECT batch, batch_position AS p, 0 AS side, anchor_id AS rec_id FROM halves
  UNION ALL SELECT batch, batch_position, 1, paired_id FROM halves),
w0 AS (
  SELECT layer, unit, position, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v,
         CASE WHEN position = 0 THEN CAST(unit * 13 % 29 - 14 AS DOUBLE) / 100
              ELSE CAST(((position - 1) * 31 + unit * 17) % 101 - 50 AS DOUBLE) / 500 END AS w
  FROM place)"""


def dense_sql(name: str, source: str, weights: str, layer: int, outer: str = "{s}") -> str:
    """A layer with its weights from a table."""
    dot = outer.format(s=f"sum(x.v * w.w) + (SELECT b.w FROM {weights} b WHERE b.layer = {layer} AND b.position = 0 AND b.unit = w.unit)")
    return f"""{name} AS MATERIALIZED (
  SELECT x.rec_id, w.unit AS i, {dot} AS v FROM {source} x JOIN {weights} w ON w.layer = {layer} AND w.position = x.i + 1
  GROUP BY x.rec_id, w.unit)"""


def adam_step_sql(k: int, rate: float) -> str:
    """Gradient of the loss over batch ``k``, and Adam's step from ``wk`` to ``w(k + 1)``."""
    t = k + 1
    return f"""in{k} AS MATERIALIZED (SELECT p, side, rec_id FROM half WHERE batch = {k}),
x{k} AS MATERIALIZED (SELECT rec_id, i, v FROM dim WHERE rec_id IN (SELECT rec_id FROM in{k})),
{dense_sql(f"hid{k}", f"x{k}", f"w{k}", 1, "greatest(0.0, {s})")},
{dense_sql(f"out{k}", f"hid{k}", f"w{k}", 2)},
len{k} AS MATERIALIZED (SELECT rec_id, greatest(sqrt(sum(v * v)), 1e-12) AS l FROM out{k} GROUP BY rec_id),
z{k} AS MATERIALIZED (SELECT rec_id, i, v / l AS v FROM out{k} JOIN len{k} USING (rec_id)),
soft{k} AS MATERIALIZED (
  SELECT *, exp(s - top) / sum(exp(s - top)) OVER (PARTITION BY p, side) AS q, 1 + count(*) OVER (PARTITION BY p, side) AS n2
  FROM (
    SELECT *, max(s) OVER (PARTITION BY p, side) AS top FROM (
      SELECT a.p, a.side, b.p AS p2, b.side AS side2, sum(x.v * y.v) / 0.1 AS s
      FROM in{k} a JOIN in{k} b ON a.p <> b.p OR a.side <> b.side
      JOIN z{k} x ON x.rec_id = a.rec_id JOIN z{k} y ON y.rec_id = b.rec_id AND y.i = x.i GROUP BY a.p, a.side, b.p, b.side) r) t),
pull{k} AS MATERIALIZED (SELECT p, side, p2, side2, (q - CASE WHEN p = p2 THEN 1 ELSE 0 END) / n2 AS g FROM soft{k}),
du{k} AS MATERIALIZED (
  SELECT a.p, a.side, z.i, sum((a.g + b.g) * z.v) / 0.1 AS v
  FROM pull{k} a JOIN pull{k} b ON b.p = a.p2 AND b.side = a.side2 AND b.p2 = a.p AND b.side2 = a.side
  JOIN in{k} m ON m.p = a.p2 AND m.side = a.side2 JOIN z{k} z ON z.rec_id = m.rec_id GROUP BY a.p, a.side, z.i),
do{k} AS MATERIALIZED (
  SELECT d.p, d.side, m.rec_id, d.i, (d.v - sum(d.v * z.v) OVER (PARTITION BY d.p, d.side) * z.v) / l AS v
  FROM du{k} d JOIN in{k} m USING (p, side) JOIN z{k} z ON z.rec_id = m.rec_id AND z.i = d.i JOIN len{k} r ON r.rec_id = m.rec_id),
dh{k} AS MATERIALIZED (
  SELECT d.p, d.side, d.rec_id, x.i, sum(d.v * w.w) AS v FROM do{k} d JOIN hid{k} x ON x.rec_id = d.rec_id
  JOIN w{k} w ON w.layer = 2 AND w.unit = d.i AND w.position = x.i + 1 WHERE x.v > 0 GROUP BY d.p, d.side, d.rec_id, x.i),
g{k} AS MATERIALIZED (
  SELECT 1 AS layer, d.i AS unit, x.i + 1 AS position, sum(d.v * x.v) AS g FROM dh{k} d JOIN x{k} x ON x.rec_id = d.rec_id GROUP BY d.i, x.i
  UNION ALL SELECT 1, i, 0, sum(v) FROM dh{k} GROUP BY i
  UNION ALL SELECT 2, d.i, x.i + 1, sum(d.v * x.v) FROM do{k} d JOIN hid{k} x ON x.rec_id = d.rec_id GROUP BY d.i, x.i
  UNION ALL SELECT 2, i, 0, sum(v) FROM do{k} GROUP BY i),
w{t} AS MATERIALIZED (
  SELECT layer, unit, position, m, v, w - {rate} * (m / (1 - pow(0.9, {t}))) / (sqrt(v / (1 - pow(0.999, {t}))) + 1e-8) AS w
  FROM (SELECT layer, unit, position, w, 0.9 * m + 0.1 * coalesce(g, 0) AS m, 0.999 * v + 0.001 * coalesce(g, 0) * coalesce(g, 0) AS v
        FROM w{k} LEFT JOIN g{k} USING (layer, unit, position)) a)"""


@query(
    "training_two_steps",
    "K11",
    X.sql(
        """SELECT CAST(layer AS INTEGER) AS layer, CAST(unit AS INTEGER) AS unit, CAST(position AS INTEGER) AS position, round(w, 6) + 0.0 AS weight FROM w2
UNION ALL SELECT 0, 0, 0, round(sum(l), 6) + 0.0 FROM (
  SELECT -avg(ln(q)) AS l FROM soft0 WHERE p = p2 UNION ALL SELECT -avg(ln(q)) FROM soft1 WHERE p = p2) t""",
        *X.DIM_VIEWS, INDEX_SQL, POSITIVE_SQL, BATCH_SQL, STEP_VIEWS[-1], HALVES_SQL, adam_step_sql(0, 0.01), adam_step_sql(1, 0.01),
    ),
)
def training_two_steps(spark, sf_dir):
    """Weights after an epoch of two batches, all pairs between them, and the sum of their losses (layer 0)."""
    pairs = materialize(batched(spark, sf_dir), "numbered_pairs")
    n = pairs.count()
    place = F.col("batch") * BATCH + F.col("batch_position")
    second = F.floor(place * 2 / n)
    first_of_second = -(-n // 2)
    halves = pairs.withColumns({"batch": second, "batch_position": place - second * first_of_second})
    config = TrainingConfig(learning_rate=0.01, workers=task_slots(spark))  # the comparing of all pairs is spread over all
    head = rational_head()
    head, _, loss = train_epoch(with_vectors(halves, X.recordings(spark, sf_dir)), head, Adam(head, config.learning_rate), config, 2)
    units = PJ.weights_table(spark, head, "trained")
    values = F.posexplode(F.concat(F.array("bias"), F.col("weights"))).alias("position", "weight")
    first = spark.createDataFrame([(0, 0, 0, loss)], "layer int, unit int, position int, weight double")
    return rounded(units.select("layer", "unit", values).unionByName(first), "weight")


HISTORY_SQL = """history AS (
  SELECT CAST(user_id % 12 + 1 AS INTEGER) AS epoch, avg(value) AS training_loss,
         CAST(round(avg(value) FILTER (event_type = 'error') / 20) AS DOUBLE) AS validation_loss
  FROM events GROUP BY user_id % 12)"""


@query(
    "best_epoch",
    "K12",
    X.sql(
        """SELECT epoch, validation_loss FROM history WHERE validation_loss = (SELECT min(validation_loss) FROM history)
ORDER BY epoch LIMIT 1""",
        HISTORY_SQL,
    ),
)
def best_epoch(spark, sf_dir):
    """Losses per epoch taken from event values, rounded so that several epochs tie."""
    events = X.table(spark, sf_dir, "events")
    history = events.groupBy((F.col("user_id") % 12 + 1).cast("int").alias("epoch")).agg(
        F.avg("value").alias("training_loss"),
        F.round(F.avg(F.when(F.col("event_type") == "error", F.col("value"))) / 20).alias("validation_loss"),
    )
    return PJ.best_epoch(history)


@query(
    "weights_round_trip",
    "K13",
    X.sql("SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_differences FROM prof", *X.PROFILE_VIEWS),
)
def weights_round_trip(spark, sf_dir):
    """Each machine's profile read as one layer of units, through the weights table and back."""
    profile = build_profile(X.recordings(spark, sf_dir))
    units = profile.select(
        F.concat_ws("/", "machine_type", "machine_id").alias("model_id"), F.posexplode(F.arrays_zip("mean", "std")).alias("unit", "s")
    )
    weights = materialize(
        units.select(
            "model_id", F.lit(1).alias("layer"), "unit", F.col("s.mean").alias("bias"), F.array("s.mean", "s.std").alias("weights")
        ),
        "weights",
    )
    path = fresh_path(spark, "saved_weights")
    PJ.save_weights(weights, path)
    return round_trip_summary(weights, PJ.load_weights(spark, path))


@query(
    "pair_summary",
    "K14",
    X.sql(
        """SELECT (SELECT count(DISTINCT machine_type) FROM normals) AS n_machine_types,
       (SELECT count(DISTINCT machine_id) FROM normals) AS n_machine_ids,
       (SELECT count(*) FROM normals) AS n_recordings, count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 0) AS n_negative,
       2 * least(count(*) FILTER (label = 1), count(*) FILTER (label = 0)) AS n_balanced FROM pairs""",
        *PAIR_VIEWS,
    ),
)
def pair_summary(spark, sf_dir):
    return PR.pair_summary(normals(spark, sf_dir), all_pairs(spark, sf_dir))
