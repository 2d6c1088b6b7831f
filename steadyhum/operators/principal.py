"""Principal axes from one pass over the vectors.

Every task folds its Arrow batches into a count, a mean and a centred Gram matrix, which merge exactly
whatever the order (Chan's update), so nothing is lost to large means. The partial matrices, of the
size of the model and not of the data, meet in groups of ``FAN_IN`` until one is left; the
driver solves that one. The model serves coordinates and explained variance alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import as_double

FAN_IN = 16
PARTIAL = "part int, n long, mean array<double>, gram binary"
PARTIAL_ARROW = pa.schema(
    [("part", pa.int32()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("gram", pa.binary())]
)
MODEL_SCHEMA = "component int, variance double, total_variance double, n long, mean array<double>, axis array<double>"


@dataclass
class Moments:
    """Count, mean and centred Gram matrix (sum of outer products) of some vectors."""

    n: int
    mean: np.ndarray
    gram: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        mean = x.mean(axis=0)
        centred = x - mean
        return cls(len(x), mean, centred.T @ centred)

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        gap = other.mean - self.mean
        gram = self.gram + other.gram + np.outer(gap, gap) * (self.n * other.n / n)
        return Moments(n, self.mean + gap * (other.n / n), gram)

    def batch(self, part: int) -> pa.RecordBatch:
        values = [[part], [self.n], [self.mean.tolist()], [self.gram.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, PARTIAL_ARROW.types, strict=True)], schema=PARTIAL_ARROW)


@dataclass
class Axes:
    """The leading axes (a row each), their variances, and the variance of all dimensions together."""

    n: int
    mean: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    total: float


def moments(vectors: DataFrame, vector: str = "vector") -> Moments | None:
    """Moments of the column, in one pass; rows of null count for nothing. Lengths must agree."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                lengths = set(pa.compute.list_value_length(batch.column(0)).to_pylist())
                if len(lengths) > 1:
                    raise ValueError(f"vectors of {sorted(lengths)} dimensions")
                own = Moments.of(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
                total = own if total is None else total.merged(own)
        if total is not None:
            yield total.batch(TaskContext.get().partitionId())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for n, mean, gram in zip(*(batch.column(c).to_pylist() for c in ("n", "mean", "gram")), strict=True):
                own = Moments(n, np.array(mean), np.frombuffer(gram).reshape(len(mean), len(mean)))
                total = own if total is None else total.merged(own)
        if total is not None:
            yield total.batch(TaskContext.get().partitionId())

    held = vectors.where(F.col(vector).isNotNull()).select(as_double(F.col(vector)).alias("v"))
    tasks = held.rdd.getNumPartitions()
    partial = held.mapInArrow(fold, PARTIAL)
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        partial = partial.repartition(tasks, "part").mapInArrow(merge, PARTIAL)
    row = partial.first()
    if row is None:
        return None
    return Moments(row.n, np.array(row["mean"]), np.frombuffer(bytes(row.gram)).reshape(len(row["mean"]), -1))


def fit_axes(vectors: DataFrame, vector: str = "vector", k: int = 2) -> Axes:
    """The ``k`` axes of largest variance; each points to its largest absolute loading."""
    found = moments(vectors, vector)
    if found is None or found.n < 2:
        raise ValueError("principal axes need two vectors or more")
    covariance = found.gram / (found.n - 1)
    values, columns = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1][:k]
    axes = columns[:, order].T
    signs = np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)] >= 0, 1.0, -1.0)
    return Axes(found.n, found.mean, axes * signs[:, None], np.maximum(values[order], 0.0), float(np.trace(covariance)))


def save_axes(spark: SparkSession, axes: Axes, path: str) -> None:
    rows = [
        (i + 1, float(v), axes.total, axes.n, axes.mean.tolist(), a.tolist())
        for i, (v, a) in enumerate(zip(axes.variances, axes.axes, strict=True))
    ]
    spark.createDataFrame(rows, MODEL_SCHEMA).write.mode("overwrite").parquet(path)


def load_axes(spark: SparkSession, path: str) -> Axes:
    rows = spark.read.schema(MODEL_SCHEMA).parquet(path).orderBy("component").collect()
    if not rows:
        raise ValueError(f"no axes in {path}")
    first = rows[0]
    variances = np.array([r.variance for r in rows])
    return Axes(first.n, np.array(first["mean"]), np.array([r.axis for r in rows]), variances, first.total_variance)


def coordinates(vectors: DataFrame, axes: Axes, vector: str = "vector") -> DataFrame:
    """Add pc1..pck, without a shuffle."""
    k, mean, columns = len(axes.axes), axes.mean, axes.axes.T
    names = [f"pc{i + 1}" for i in range(k)]

    @F.arrow_udf("struct<" + ", ".join(f"{n}: double" for n in names) + ">")
    def run(column: pa.Array) -> pa.Array:
        there = column.is_valid().to_numpy(zero_copy_only=False)
        out = np.full((len(column), k), np.nan)
        out[there] = (column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(mean)) - mean) @ columns
        return pa.StructArray.from_arrays([pa.array(c, mask=~there) for c in out.T], names=names)

    placed = vectors.withColumn("_pc", run(as_double(F.col(vector))))
    return placed.select("*", *[F.col(f"_pc.{n}").alias(n) for n in names]).drop("_pc")


def variance_shares(spark: SparkSession, axes: Axes) -> DataFrame:
    """Share of total variance per component."""
    rows = [(i + 1, float(v) / axes.total if axes.total > 0 else 0.0) for i, v in enumerate(axes.variances)]
    return spark.createDataFrame(rows, "component int, explained_variance_ratio double")
