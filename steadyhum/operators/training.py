"""Synchronous data-parallel training of the projection head, one Adam step per mini-batch.

An epoch is one job. Its pairs stay keys until their batch is known; vectors are then joined once and
dealt to a few barrier tasks, which all hold the model and the optimizer's state. Of every batch a
task reads its share of the pairs and projects them; an all-gather brings the projections together, as
the loss compares all pairs of a batch, and a second one the gradient: its factors, a few numbers
per row of the batch, or, for batches larger than the model, the sums of every task. All tasks then make the same
step, so their models stay equal. If a task is lost, the stage starts again from the state before the epoch.

What is gathered goes through small files in the shared folder. A barrier task context's own all-gather
would send it through the driver and looks for answers once a second, which is longer than a job per
step takes. The driver gets the last state, from one task.

Where barrier stages cannot run (dynamic allocation, or ``workers`` 0), and where batches are merged into
steps, every step is a job: one gradient per batch, summed block by block, and Adam on the driver. One
batch per step gives the same training either way. Only an explicit ``batches_per_step`` or ``max_steps`` merges
more batches into a step, which changes the result.
"""

from __future__ import annotations

import io
import math
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import file_system
from ..functions.kernels import stack
from ..functions.scale import fresh_path, materialize
from ..functions.vectors import UNIT_EPS
from .pairs import batches, split_validation, split_violations
from .projection import (
    BLOCK_CELLS,
    TEMPERATURE,
    Checkpoint,
    Head,
    batch_loss,
    column_pulls,
    is_large,
    large_loss,
    partners,
    row_pulls,
)

# Fixed values of the optimizer.
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8

PATIENCE = 600.0  # seconds that a worker waits for another one's message
PARTNERS = 1 << 40  # the place of the first partner, behind all anchors
GRADIENT_SCHEMA = "batch long, loss double, block int, gradient array<double>"


@dataclass(frozen=True)
class TrainingConfig:
    hidden: int = 512
    output: int = 256
    batch_size: int = 32
    epochs: int = 5
    learning_rate: float = 1e-3
    temperature: float = TEMPERATURE
    validation_share: float = 0.2
    seed: int = 42
    batches_per_step: int = 1
    max_steps: int | None = None  # bounds the steps of an epoch by merging batches; changes the result
    gradient_blocks: int = 16
    workers: int = 4  # barrier tasks of an epoch; 0 makes every step a job


def gradient(head: Head, x: np.ndarray, temperature: float) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients of one batch, ``x`` holding anchors first and partners after."""
    hidden = np.maximum(x @ head.w1.T + head.b1, 0.0)
    out = hidden @ head.w2.T + head.b2
    length = np.maximum(np.linalg.norm(out, axis=1, keepdims=True), UNIT_EPS)
    z = out / length
    loss, dz = batch_loss(z, temperature)
    d_out = (dz - (dz * z).sum(axis=1, keepdims=True) * z) / length
    d_hidden = (d_out @ head.w2) * (hidden > 0)
    return loss, [d_hidden.T @ x, d_hidden.sum(axis=0), d_out.T @ hidden, d_out.sum(axis=0)]


class Adam:
    def __init__(self, head: Head, rate: float) -> None:
        self.rate, self.t = rate, 0
        self.m = [np.zeros_like(p) for p in head.parts()]
        self.v = [np.zeros_like(p) for p in head.parts()]

    @classmethod
    def of(cls, other: Adam) -> Adam:
        """A copy with state arrays of its own."""
        made = cls.__new__(cls)
        made.rate, made.t = other.rate, other.t
        made.m, made.v = [x.copy() for x in other.m], [x.copy() for x in other.v]
        return made

    def step(self, head: Head, grads: list[np.ndarray]) -> Head:
        self.t += 1
        updated = []
        for i, (p, g) in enumerate(zip(head.parts(), grads)):
            self.m[i] = BETA1 * self.m[i] + (1 - BETA1) * g
            self.v[i] = BETA2 * self.v[i] + (1 - BETA2) * g * g
            m_hat = self.m[i] / (1 - BETA1**self.t)
            v_hat = self.v[i] / (1 - BETA2**self.t)
            updated.append(p - self.rate * m_hat / (np.sqrt(v_hat) + EPSILON))
        return Head(*updated)

    def state(self) -> dict:
        return {"step": self.t, "m": [x.tolist() for x in self.m], "v": [x.tolist() for x in self.v]}


def _shaped(flat: np.ndarray, head: Head) -> list[np.ndarray]:
    shaped, at = [], 0
    for p in head.parts():
        shaped.append(flat[at : at + p.size].reshape(p.shape))
        at += p.size
    return shaped


def step_gradient(batched: DataFrame, head: Head, config: TrainingConfig) -> tuple[list[np.ndarray], float, int]:
    """Mean gradient, mean loss and number of the batches in ``batched`` (batch, batch_position, a, b).

    Gradients are summed per block on the executors, so the reduction is spread and only one
    gradient of model size reaches the driver.
    """
    shared = batched.sparkSession.sparkContext.broadcast(head)
    blocks, temperature = config.gradient_blocks, config.temperature

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("batch_position")
        x = np.concatenate([stack(ordered["a"]), stack(ordered["b"])])
        loss, grads = gradient(shared.value, x, temperature)
        pieces = np.array_split(np.concatenate([g.ravel() for g in grads]), blocks)
        return pd.DataFrame(
            {
                "batch": np.int64(pdf["batch"].iloc[0]),
                "loss": loss,
                "block": np.arange(blocks, dtype=np.int32),
                "gradient": pieces,
            }
        )

    per_batch = batched.groupBy("batch").applyInPandas(run, GRADIENT_SCHEMA)
    summed = per_batch.groupBy("block").agg(
        Summarizer.mean(array_to_vector("gradient")).alias("g"),
        F.avg("loss").alias("loss"),
        F.count(F.lit(1)).alias("n"),
    )
    rows = sorted(summed.select("block", vector_to_array("g").alias("g"), "loss", "n").collect())
    flat = np.concatenate([np.asarray(r["g"]) for r in rows])
    return _shaped(flat, head), rows[0]["loss"], rows[0]["n"]


def mean_loss(batched: DataFrame, head: Head, config: TrainingConfig) -> float:
    """Mean loss over batches; 0 without batches."""
    shared = batched.sparkSession.sparkContext.broadcast(head)
    temperature = config.temperature

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values("batch_position")
        z = shared.value.forward(np.concatenate([stack(ordered["a"]), stack(ordered["b"])]))
        return pd.DataFrame({"loss": [batch_loss(z, temperature)[0]]})

    value = batched.groupBy("batch").applyInPandas(run, "loss double").agg(F.avg("loss")).first()[0]
    return 0.0 if value is None else value


def with_vectors(pairs: DataFrame, vectors: DataFrame, key: str = "rec_id", vector: str = "vector") -> DataFrame:
    """Attach anchor and partner vectors; a recording is partner of few anchors, so no hot key."""
    a = vectors.select(F.col(key).alias("anchor_id"), F.col(vector).alias("a"))
    b = vectors.select(F.col(key).alias("paired_id"), F.col(vector).alias("b"))
    return pairs.join(a, "anchor_id").join(b, "paired_id")


def epoch_keys(train: DataFrame, config: TrainingConfig, epoch: int) -> tuple[DataFrame, int]:
    """The epoch's batches as keys, written once, and their number."""
    keys = batches(train, config.batch_size, config.seed + 100 + epoch)
    keys = materialize(keys.select("anchor_id", "paired_id", "batch", "batch_position"), f"batches_{epoch}")
    last = keys.agg(F.max("batch")).first()[0]
    return keys, 0 if last is None else last + 1


def epoch_steps(
    train: DataFrame, vectors: DataFrame, config: TrainingConfig, epoch: int
) -> tuple[DataFrame, int]:
    """The epoch's batches with their vectors, written in step order, and the number of steps.

    Files hold ranges of steps, so the filter of a step skips nearly all of them by their statistics.
    """
    keys, n_batches = epoch_keys(train, config, epoch)
    per_step = config.batches_per_step
    if config.max_steps is not None:
        per_step = max(per_step, math.ceil(n_batches / config.max_steps))
    step = F.floor(F.col("batch") / per_step).cast("int")
    joined = with_vectors(keys.withColumn("step", step), vectors)
    arranged = joined.select("step", "batch", "batch_position", "a", "b").repartitionByRange("step").sortWithinPartitions("step")
    return materialize(arranged, f"epoch_{epoch}"), math.ceil(n_batches / per_step)


def task_slots(spark: SparkSession) -> int:
    """How many tasks can run at a time now, which a barrier stage must not exceed."""
    sc = spark.sparkContext._jsc.sc()
    return max(1, sc.maxNumConcurrentTasks(sc.resourceProfileManager().defaultResourceProfile()))


def worker_slots(spark: SparkSession, workers: int) -> list[int]:
    """A number per worker that Spark's hash partitioning into as many partitions sends to a partition of its own."""
    part = F.pmod(F.hash("id"), F.lit(workers))
    found = spark.range(64 * workers).groupBy(part.alias("part")).agg(F.min("id").alias("id")).collect()
    slots = {r.part: r.id for r in found}
    if len(slots) < workers:
        raise RuntimeError(f"no number for each of {workers} workers")
    return [slots[w] for w in range(workers)]


class Exchange:
    """All-gather between the tasks of a barrier stage, through a folder that all of them see."""

    def __init__(self, folder: str, worker: int, workers: int, patience: float = PATIENCE):
        self.system, self.folder = file_system(folder)
        self.worker, self.workers, self.patience, self.turn = worker, workers, patience, 0
        self.system.create_dir(self.folder, recursive=True)

    def _name(self, turn: int, worker: int) -> str:
        return f"{self.folder}/{turn}-{worker}"

    def messages(self, message: bytes) -> Iterator[bytes]:
        """The messages of all workers in their order, to be read to the end; every worker has to call this equally often."""
        self.turn += 1
        own = self._name(self.turn, self.worker)
        with self.system.open_output_stream(f"{own}.part", compression=None) as f:
            f.write(message)
        self.system.move(f"{own}.part", own)
        for w in range(self.workers):
            yield message if w == self.worker else self._read(self._name(self.turn, w))
        if self.turn > 1:  # all have written this turn's, so all have read the last one's
            self.system.delete_file(self._name(self.turn - 1, self.worker))

    def all_gather(self, message: bytes) -> list[bytes]:
        return list(self.messages(message))

    def all_sum(self, part: np.ndarray) -> np.ndarray:
        """The sum of all workers' ``part``, in the same order for each."""
        total = np.zeros(part.size)
        for message in self.messages(packed(part)):
            total += np.frombuffer(message, np.float64)
        return total.reshape(part.shape)

    def _read(self, name: str) -> bytes:
        until, pause = time.monotonic() + self.patience, 0.0005
        while True:
            try:
                with self.system.open_input_file(name) as f:
                    return f.read()
            except FileNotFoundError:
                if time.monotonic() > until:
                    raise
                time.sleep(pause)
                pause = min(0.02, 1.5 * pause)


def packed(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a, dtype=np.float64).tobytes() for a in arrays)


def unpacked(message: bytes, widths: list[int]) -> list[np.ndarray]:
    """The arrays of a message of (rows, width) arrays with equal numbers of rows."""
    flat = np.frombuffer(message, np.float64)
    rows = flat.size // sum(widths)
    ends = np.cumsum([rows * w for w in widths])
    return [flat[e - rows * w : e].reshape(rows, w) for e, w in zip(ends, widths, strict=True)]


def gathered(exchange: Exchange, widths: list[int], places: np.ndarray, *arrays: np.ndarray) -> list[np.ndarray]:
    """All workers' places in the batch, ascending, and their rows of ``arrays`` in that order."""
    messages = [unpacked(m, [1, *widths]) for m in exchange.all_gather(packed(places[:, None], *arrays))]
    every = np.concatenate([m[0][:, 0] for m in messages])
    order = np.argsort(every)
    return [every[order], *(np.concatenate([m[i + 1] for m in messages])[order] for i in range(len(widths)))]


def joint_loss(
    exchange: Exchange, places: np.ndarray, z: np.ndarray, rows: np.ndarray, temperature: float
) -> tuple[float, np.ndarray]:
    """Loss of a batch, and its slope at this worker's ``rows`` of the unit vectors ``z`` of all workers.

    Similarities are as many as the square of the batch: beyond one block of them the workers share the tiles, or, where
    similarities may be far apart, every worker makes those of its own rows, and the sums of the softmax, a number per row, are gathered between two passes.
    """
    if len(z) ** 2 <= BLOCK_CELLS:
        loss, dz = batch_loss(z, temperature)
        return loss, dz[rows]
    if is_large(z, temperature):
        return large_loss(z, rows, temperature, exchange.worker, exchange.workers, exchange.all_sum)
    logs, near, pull = row_pulls(z, rows, temperature)
    _, logs, near = gathered(exchange, [1, 1], places, logs[:, None], near[:, None])
    back = column_pulls(z, rows, logs[:, 0], temperature)
    return float(np.mean(logs - near)), (pull + back - 2.0 * z[partners(len(z))[rows]]) / len(z) / temperature


def joint_gradient(
    exchange: Exchange, head: Head, places: np.ndarray, x: np.ndarray, temperature: float
) -> tuple[float, list[np.ndarray]]:
    """Loss and gradient of a batch of which this worker holds the rows ``x``, at ascending ``places`` of all anchors, then all partners."""
    hidden = np.maximum(x @ head.w1.T + head.b1, 0.0)
    out = hidden @ head.w2.T + head.b2
    length = np.maximum(np.linalg.norm(out, axis=1, keepdims=True), UNIT_EPS)
    own = out / length
    every, z = gathered(exchange, [out.shape[1]], places, own)
    loss, dz = joint_loss(exchange, places, z, np.searchsorted(every, places), temperature)
    d_out = (dz - (dz * own).sum(axis=1, keepdims=True) * own) / length
    d_hidden = (d_out @ head.w2) * (hidden > 0)
    widths = [x.shape[1], hidden.shape[1], d_hidden.shape[1], d_out.shape[1]]
    if len(z) * sum(widths) <= exchange.workers * sum(p.size for p in head.parts()):
        _, x, hidden, d_hidden, d_out = gathered(exchange, widths, places, x, hidden, d_hidden, d_out)
        return loss, [d_hidden.T @ x, d_hidden.sum(axis=0), d_out.T @ hidden, d_out.sum(axis=0)]
    part = [d_hidden.T @ x, d_hidden.sum(axis=0), d_out.T @ hidden, d_out.sum(axis=0)]
    sums = [np.frombuffer(m, np.float64) for m in exchange.all_gather(packed(*[g.ravel() for g in part]))]
    return loss, _shaped(np.sum(sums, axis=0), head)


def batchwise(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, positions, anchors, partners) of rows sorted by batch; an Arrow batch may end within one."""
    held: list[pa.RecordBatch] = []
    last = None

    def whole() -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        table = pa.Table.from_batches(held)
        positions = table.column("batch_position").to_numpy()
        sides = []
        for side in ("a", "b"):
            column = table.column(side).combine_chunks()
            sides.append(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(positions), -1))
        return last, positions, *sides

    for rows in batches:
        numbers = rows.column(rows.schema.get_field_index("batch")).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)] if len(numbers) else []
        for i, j in zip(edges, edges[1:], strict=False):
            if held and numbers[i] != last:
                yield whole()
                held = []
            last = int(numbers[i])
            held.append(rows.slice(i, j - i))
    if held:
        yield whole()


def train_epoch(
    batched: DataFrame, head: Head, adam: Adam, config: TrainingConfig, n_batches: int
) -> tuple[Head, Adam, float]:
    """Head, optimizer and the sum of the losses after one step for each of the batches 0 to ``n_batches - 1``, in one job.

    ``batched`` holds (batch, batch_position, a, b); positions of a batch count from 0.
    """
    spark = batched.sparkSession
    workers = min(config.workers, spark.sparkContext.defaultParallelism)
    slots = F.array(*[F.lit(s).cast("long") for s in worker_slots(spark, workers)])
    slot = F.element_at(slots, (F.pmod("batch_position", F.lit(workers)) + 1).cast("int"))
    shared = spark.sparkContext.broadcast((head, adam))
    temperature, dim, folder = config.temperature, head.w1.shape[1], fresh_path(spark, "exchange")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = BarrierTaskContext.get()
        attempt = ctx.allGather(uuid.uuid4().hex)[0]  # the first worker names the folder, another one if the stage starts again
        exchange = Exchange(f"{folder}/{attempt}", ctx.partitionId(), workers)
        model, optimizer = shared.value
        optimizer = Adam.of(optimizer)  # a worker's process may serve several attempts
        stream, total = batchwise(rows), 0.0
        ahead = next(stream, None)
        for number in range(n_batches):
            places, x = np.zeros(0), np.zeros((0, dim))
            if ahead and ahead[0] == number:
                _, positions, a, b = ahead
                places, x = np.concatenate([positions, PARTNERS + positions]).astype(np.float64), np.concatenate([a, b])
                ahead = next(stream, None)
            loss, grads = joint_gradient(exchange, model, places, x, temperature)
            model, total = optimizer.step(model, grads), total + loss
        if ctx.partitionId() == 0:
            state = io.BytesIO()
            parts = {f"p{i}": p for i, p in enumerate([*model.parts(), *optimizer.m, *optimizer.v])}
            np.savez(state, t=optimizer.t, **parts)
            yield pa.RecordBatch.from_arrays([pa.array([state.getvalue()]), pa.array([total])], names=["state", "loss"])

    dealt = batched.select(slot.alias("slot"), "batch", "batch_position", "a", "b").repartition(workers, "slot")
    sorted_rows = dealt.sortWithinPartitions("batch", "batch_position").select("batch", "batch_position", "a", "b")
    # The exchange makes the barrier stage one that Spark can start again.
    row = sorted_rows.mapInArrow(run, "state binary, loss double", barrier=True).repartition(1).collect()[0]
    state = np.load(io.BytesIO(bytes(row.state)))
    n = len(head.parts())
    parts = [state[f"p{i}"] for i in range(3 * n)]
    after = Adam.of(adam)
    after.t, after.m, after.v = int(state["t"]), parts[n : 2 * n], parts[2 * n :]
    return Head(*parts[:n]), after, row.loss


def in_one_job(spark: SparkSession, config: TrainingConfig) -> bool:
    """Whether an epoch can be one barrier stage."""
    fixed = spark.conf.get("spark.dynamicAllocation.enabled", "false") != "true"
    return fixed and config.workers > 0 and config.batches_per_step == 1 and config.max_steps is None


def fit(positives: DataFrame, vectors: DataFrame, config: TrainingConfig | None = None, head: Head | None = None):
    """Train on positive pairs; returns (best checkpoint, history as a DataFrame).

    ``positives`` holds (anchor_id, paired_id), ``vectors`` (rec_id, vector).
    """
    c = config or TrainingConfig()
    spark: SparkSession = positives.sparkSession
    problem = split_violations(positives, c.validation_share).first()
    if problem:
        raise ValueError(problem["violation"])
    split = materialize(split_validation(positives, c.validation_share, c.seed), "training_pairs")
    train, held = split.where(~F.col("is_validation")), split.where("is_validation")
    validation = materialize(with_vectors(batches(held, c.batch_size, c.seed + 6), vectors), "validation_pairs")
    model = head or Head.initial((len(vectors.select("vector").first()[0]), c.hidden, c.output), c.seed)
    adam, best, history = Adam(model, c.learning_rate), None, []
    for epoch in range(1, c.epochs + 1):
        total, seen = 0.0, 0
        if in_one_job(spark, c):
            keys, seen = epoch_keys(train, c, epoch)
            if seen:
                model, adam, total = train_epoch(with_vectors(keys, vectors), model, adam, c, seen)
        else:
            stored, n_steps = epoch_steps(train, vectors, c, epoch)
            for step in range(n_steps):
                grads, loss, n = step_gradient(stored.where(F.col("step") == step), model, c)
                model = adam.step(model, grads)
                total, seen = total + loss * n, seen + n
        val = mean_loss(validation, model, c)
        history.append((epoch, total / seen if seen else 0.0, val))
        if val < (best.validation_loss if best else math.inf):
            settings = {"temperature": c.temperature, "batch_size": c.batch_size, "learning_rate": c.learning_rate}
            best = Checkpoint(model, epoch, val, adam.state(), settings)
    return best, spark.createDataFrame(history, "epoch int, training_loss double, validation_loss double")
