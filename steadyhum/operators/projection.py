"""The projection head: two dense layers and unit length, its loss, and its weights table."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import stack
from ..functions.vectors import UNIT_EPS, has_inf, has_nan, norm
from ..sources.stores import require_columns

# Layer widths, temperature, and the accepted deviation from unit length.
INPUT_DIM, HIDDEN_DIM, OUTPUT_DIM = 921, 512, 256
TEMPERATURE = 0.1
UNIT_TOLERANCE = 1e-3

BLOCK_CELLS = 1 << 20  # similarities of a batch that are held at a time
TILE = 256  # rows and columns of a tile of a larger batch, which stays in a core's cache
SAFE_EXPONENT = 600.0  # exponents of so much below zero are far from underflow
GRID = 512  # table entries of the exponential per unit; three terms of its series do the rest

WEIGHTS_SCHEMA = "model_id string, layer int, unit int, bias double, weights array<double>"
CHECKPOINT_SCHEMA = "model_id string, epoch int, validation_loss double, optimizer_state string, config string"


@dataclass
class Head:
    """Weights of the two layers: w1 (hidden, in), b1, w2 (out, hidden), b2."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @classmethod
    def initial(cls, dims: tuple[int, int, int] = (INPUT_DIM, HIDDEN_DIM, OUTPUT_DIM), seed: int = 42) -> Head:
        """Uniform within one over the square root of a layer's fan-in."""
        rng = np.random.default_rng(seed)
        d, h, o = dims
        layers = []
        for fan_in, units in ((d, h), (h, o)):
            r = 1.0 / np.sqrt(fan_in)
            layers += [rng.uniform(-r, r, (units, fan_in)), rng.uniform(-r, r, units)]
        return cls(*layers)

    def parts(self) -> list[np.ndarray]:
        return [self.w1, self.b1, self.w2, self.b2]

    def forward(self, x: np.ndarray) -> np.ndarray:
        out = np.maximum(x @ self.w1.T + self.b1, 0.0) @ self.w2.T + self.b2
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), UNIT_EPS)


def project(df: DataFrame, head: Head, vector: str = "fused_vector", output: str = "embedding") -> DataFrame:
    """Score every row in Arrow batches against broadcast weights; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(head)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for rows in batches:
            yield pd.Series(list(model.forward(stack(rows))) if len(rows) else [], dtype=object)

    return df.withColumn(output, run(F.col(vector)))


def projection_violations(df: DataFrame, keep: list[str], dim: int, vector: str = "embedding") -> DataFrame:
    """Wrong length, NaN, infinite, or not of unit length."""
    v = F.col(vector)
    reasons = F.array(
        F.when(F.size(v) != dim, "wrong dimension"),
        F.when(has_nan(v), "NaN values"),
        F.when(has_inf(v), "infinite values"),
        F.when(F.abs(norm(v) - 1.0) > UNIT_TOLERANCE, "not unit length"),
    )
    return df.select(*keep, F.explode(F.array_compact(reasons)).alias("violation"))


def similarity_blocks(z: np.ndarray, rows: np.ndarray, temperature: float) -> Iterator[tuple[slice, np.ndarray]]:
    """Similarities of ``rows`` of ``z`` to all rows, none to themselves, at most about ``BLOCK_CELLS`` at a time."""
    size = max(1, BLOCK_CELLS // max(1, len(z)))
    for start in range(0, len(rows), size):
        own = rows[start : start + size]
        sim = z[own] @ z.T / temperature
        sim[np.arange(len(own)), own] = -np.inf
        yield slice(start, start + len(own)), sim


def partners(n2: int) -> np.ndarray:
    return (np.arange(n2) + n2 // 2) % n2


def row_pulls(z: np.ndarray, rows: np.ndarray, temperature: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``rows``: the logarithm of their softmax's sum, similarity to the partner, and all rows weighted by the softmax."""
    partner = partners(len(z))[rows]
    logs, near, pull = np.empty(len(rows)), np.empty(len(rows)), np.empty((len(rows), z.shape[1]))
    for part, sim in similarity_blocks(z, rows, temperature):
        near[part] = sim[np.arange(len(sim)), partner[part]]
        top = sim.max(axis=1, keepdims=True)
        sim -= top
        p = np.exp(sim, out=sim)
        mass = p.sum(axis=1, keepdims=True)
        logs[part] = (top + np.log(mass))[:, 0]
        pull[part] = p @ z / mass
    return logs, near, pull


def column_pulls(z: np.ndarray, rows: np.ndarray, logs: np.ndarray, temperature: float) -> np.ndarray:
    """Of ``rows``: all rows weighted by what their own softmax, of the logarithms ``logs``, gives to this one."""
    pull = np.empty((len(rows), z.shape[1]))
    for part, sim in similarity_blocks(z, rows, temperature):
        sim -= logs
        pull[part] = np.exp(sim, out=sim) @ z
    return pull


def merged(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different rows of ``z``, how often each comes, and which of them every row is."""
    bits = np.ascontiguousarray(z).view(np.uint64)
    order = np.argsort(bits @ np.random.default_rng(0).integers(1 << 63, size=z.shape[1], dtype=np.uint64), kind="stable")
    near = bits[order]
    first = np.ones(len(z), bool)
    first[1:] = (near[1:] != near[:-1]).any(axis=1)
    of = np.empty(len(z), np.int64)
    of[order] = np.cumsum(first) - 1
    return z[order[first]], np.bincount(of).astype(np.float64), of


def reach(z: np.ndarray, temperature: float) -> float:
    """No similarity is above this, nor below its negative."""
    return float(np.einsum("ij,ij->i", z, z).max() / temperature)


class FallingExp:
    """exp(-n / GRID) of arrays of one size, n from 0 to ``most``, to some 4e-14; several times as fast as the C library's."""

    def __init__(self, shape: tuple[int, int], most: float):
        self.table = np.exp(-np.arange(int(most) + 2) / GRID)
        self.near, self.out, self.at = np.empty(shape), np.empty(shape), np.empty(shape, np.intp)

    def __call__(self, n: np.ndarray) -> np.ndarray:
        """``n`` is overwritten, and so is what the last call returned."""
        near, out, at = (x[: len(n), : n.shape[1]] for x in (self.near, self.out, self.at))
        np.rint(n, out=near)
        np.subtract(near, n, out=n)
        np.copyto(at, near, casting="unsafe")
        np.take(self.table, at, out=near, mode="clip")
        np.multiply(n, GRID**-3 / 6, out=out)
        for term in (GRID**-2 / 2, 1 / GRID):
            out += term
            out *= n
        out *= near
        out += near
        return out


def tiles(
    z: np.ndarray, counts: np.ndarray, temperature: float, worker: int, workers: int
) -> Iterator[tuple[slice, slice, np.ndarray]]:
    """Exponentials of similarities less ``reach``, of each two of the rows ``z`` once, in this worker's tiles.

    ``counts`` is how often a row comes: it meets its other copies, not itself, so on the diagonal stands a share. A tile is overwritten by the next.
    """
    side, top = min(TILE, max(1, math.isqrt(BLOCK_CELLS))), reach(z, temperature)
    parts = [slice(at, min(at + side, len(z))) for at in range(0, len(z), side)]
    right = np.hstack([z, np.ones((len(z), 1))])
    scale = np.array([*[-GRID / temperature] * z.shape[1], GRID * top])  # so scaled, the product is n
    held, exponential = np.empty((side, side)), FallingExp((side, side), 2 * GRID * top)
    for i, rows in enumerate(parts):
        a = right[rows] * scale
        for j in range(i + (worker - 2 * i) % workers, len(parts), workers):
            b = right[parts[j]]
            tile = exponential(np.matmul(a, b.T, out=held[: len(a), : len(b)]))
            if i == j:
                tile[np.diag_indices(len(tile))] *= (counts[rows] - 1) / counts[rows]
            yield rows, parts[j], tile


def large_loss(
    z: np.ndarray,
    rows: np.ndarray,
    temperature: float,
    worker: int = 0,
    workers: int = 1,
    total: Callable[[np.ndarray], np.ndarray] = lambda part: part,
) -> tuple[float, np.ndarray]:
    """As :func:`batch_loss`, with the slope at ``rows`` only; ``total`` adds up the workers' parts.

    Copies of a row, of which a batch has many as recordings are anchors and partners, are compared once. Similarities
    are the same both ways, so each two rows are compared once in each of two passes: for the sums of the softmax, and for the pulls.
    """
    unique, counts, of = merged(z)
    mass = np.zeros(len(unique))
    for i, j, tile in tiles(unique, counts, temperature, worker, workers):
        mass[i] += tile @ counts[j]
        if i != j:
            mass[j] += counts[i] @ tile
    mass = total(mass)
    share, weighted, pull = 1.0 / mass, counts[:, None] * unique, np.zeros(unique.shape)
    for i, j, tile in tiles(unique, counts, temperature, worker, workers):
        tile *= share[i, None] + share[j]
        pull[i] += tile @ weighted[j]
        if i != j:
            pull[j] += (weighted[i].T @ tile).T
    pull = total(pull)
    partner = partners(len(z))
    near = np.einsum("ij,ij->i", z, z[partner]) / temperature
    loss = float(np.mean(np.log(mass)[of] + reach(z, temperature) - near))
    return loss, (pull[of[rows]] - 2.0 * z[partner[rows]]) / len(z) / temperature


def is_large(z: np.ndarray, temperature: float) -> bool:
    """Whether a batch is compared in tiles; where similarities may be far apart, every row needs a maximum of its own."""
    return len(z) ** 2 > BLOCK_CELLS and 2.0 * reach(z, temperature) <= SAFE_EXPONENT


def batch_loss(z: np.ndarray, temperature: float) -> tuple[float, np.ndarray]:
    """Loss of one batch of unit vectors (anchors first, partners after) and d loss / d z."""
    rows = np.arange(len(z))
    if is_large(z, temperature):
        return large_loss(z, rows, temperature)
    logs, near, pull = row_pulls(z, rows, temperature)
    back = column_pulls(z, rows, logs, temperature)
    return float(np.mean(logs - near)), (pull + back - 2.0 * z[partners(len(z))]) / len(z) / temperature


def nt_xent(paired: DataFrame, a: str = "a", b: str = "b", temperature: float = TEMPERATURE) -> DataFrame:
    """(batch, n_pairs, loss) of unit vectors; a group is one batch, so its size is the batch size."""
    if temperature <= 0:
        raise ValueError(f"the temperature has to be positive, not {temperature}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z = np.concatenate([stack(pdf[a]), stack(pdf[b])])
        loss, _ = batch_loss(z, temperature)
        return pd.DataFrame({"batch": [pdf["batch"].iloc[0]], "n_pairs": [len(pdf)], "loss": [loss]})

    return paired.select("batch", a, b).groupBy("batch").applyInPandas(run, "batch long, n_pairs long, loss double")


# --- weights as tables ---


@dataclass
class Checkpoint:
    head: Head
    epoch: int
    validation_loss: float
    optimizer_state: dict | None = None
    config: dict = field(default_factory=dict)


def weights_table(spark: SparkSession, head: Head, model_id: str) -> DataFrame:
    """One row per unit; the size is that of the model."""
    rows = [
        (model_id, layer, unit, float(bias[unit]), weights[unit].tolist())
        for layer, (weights, bias) in enumerate(((head.w1, head.b1), (head.w2, head.b2)), start=1)
        for unit in range(len(bias))
    ]
    return spark.createDataFrame(rows, WEIGHTS_SCHEMA)


def head_from_table(weights: DataFrame, model_id: str | None = None) -> Head:
    """The head of ``model_id``; it may be left out where the table holds one model."""
    if model_id is not None:
        weights = weights.where(F.col("model_id") == model_id)
    elif weights.select("model_id").distinct().limit(2).count() > 1:
        raise ValueError("the weights table holds several models, name one")
    layers = {1: [], 2: []}
    for r in weights.orderBy("layer", "unit").collect():
        layers[r["layer"]].append((r["weights"], r["bias"]))
    if not layers[1] or not layers[2]:
        raise KeyError("weights table lacks a layer")
    parts = [np.array(p) for layer in (1, 2) for p in zip(*layers[layer])]
    return Head(*parts)


def save_weights(weights: DataFrame, path: str) -> None:
    weights.write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> DataFrame:
    """The weights table; raises if a required column is missing."""
    found = spark.read.parquet(path)
    return require_columns(found, ["model_id", "layer", "unit", "bias", "weights"])


def save_checkpoint(spark: SparkSession, checkpoint: Checkpoint, path: str, model_id: str) -> None:
    save_weights(weights_table(spark, checkpoint.head, model_id), f"{path}/weights")
    state = None if checkpoint.optimizer_state is None else json.dumps(checkpoint.optimizer_state)
    row = (model_id, checkpoint.epoch, checkpoint.validation_loss, state, json.dumps(checkpoint.config))
    spark.createDataFrame([row], CHECKPOINT_SCHEMA).write.mode("overwrite").parquet(f"{path}/checkpoint")


def load_checkpoint(spark: SparkSession, path: str) -> Checkpoint:
    """Raises on missing required fields; the optional ones default to None and {}."""
    meta = spark.read.parquet(f"{path}/checkpoint")
    row = require_columns(meta, ["epoch", "validation_loss"]).first().asDict()
    state, config = row.get("optimizer_state"), row.get("config")
    return Checkpoint(
        head_from_table(load_weights(spark, f"{path}/weights")),
        row["epoch"],
        row["validation_loss"],
        json.loads(state) if state else None,
        json.loads(config) if config else {},
    )


def best_epoch(history: DataFrame) -> DataFrame:
    """The earliest epoch with the lowest validation loss; NaN losses never win."""
    usable = history.where(~F.isnan("validation_loss"))
    best: Column = F.min(F.struct("validation_loss", "epoch"))
    return usable.agg(best.alias("b")).select("b.epoch", "b.validation_loss")
