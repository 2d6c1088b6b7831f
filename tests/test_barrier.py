"""An epoch as one barrier stage: the same training as batch after batch, whatever the workers."""

import dataclasses
import os
import subprocess
import sys
import tracemalloc
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest

from steadyhum.operators import projection as PJ
from steadyhum.operators import training as TR

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def batched(spark, n=70, dim=10, size=16, seed=0):
    """Rows (batch, batch_position, a, b) and the plain arrays of every batch."""
    r = np.random.default_rng(seed)
    a, b = r.normal(size=(n, dim)), r.normal(size=(n, dim))
    rows = [(i // size, i % size, a[i].tolist(), b[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows, "batch long, batch_position long, a array<double>, b array<double>").repartition(5)
    return df, [np.concatenate([a[i : i + size], b[i : i + size]]) for i in range(0, n, size)]


def sequential(parts, head, rate, temperature):
    adam, total = TR.Adam(head, rate), 0.0
    for x in parts:
        loss, grads = TR.gradient(head, x, temperature)
        head, total = adam.step(head, grads), total + loss
    return head, adam, total


@pytest.mark.parametrize("workers", [1, 2, 4])
@pytest.mark.parametrize("dims", [(10, 8, 4), (10, 3, 2)])
def test_equals_training_batch_after_batch(spark, workers, dims):
    """The smaller head has fewer weights than a batch has factors, so its gradients are summed instead."""
    df, parts = batched(spark)
    config = TR.TrainingConfig(learning_rate=0.05, workers=workers)
    head = PJ.Head.initial(dims, 1)
    got, adam, total = TR.train_epoch(df, head, TR.Adam(head, 0.05), config, len(parts))
    want, state, loss = sequential(parts, head, 0.05, config.temperature)
    for p, q in zip([*got.parts(), *adam.m, *adam.v], [*want.parts(), *state.m, *state.v], strict=True):
        np.testing.assert_allclose(p, q, rtol=1e-9, atol=1e-12)
    assert adam.t == len(parts) and total == pytest.approx(loss, rel=1e-12)


def test_state_goes_on_in_the_next_epoch(spark):
    df, parts = batched(spark, seed=3)
    config, head = TR.TrainingConfig(workers=2), PJ.Head.initial((10, 8, 4), 2)
    once, adam, _ = TR.train_epoch(df, head, TR.Adam(head, 1e-2), config, len(parts))
    twice, adam, _ = TR.train_epoch(df, once, adam, config, len(parts))
    want, state, _ = sequential(parts + parts, head, 1e-2, config.temperature)
    assert adam.t == state.t == 2 * len(parts)
    for p, q in zip(twice.parts(), want.parts(), strict=True):
        np.testing.assert_allclose(p, q, rtol=1e-9, atol=1e-12)


def test_fit_is_the_same_with_a_job_per_step(spark):
    r = np.random.default_rng(5)
    recs = spark.createDataFrame([(i, r.normal(size=6).tolist()) for i in range(60)], "rec_id long, vector array<double>")
    positives = spark.createDataFrame([(i, (i + 7) % 60) for i in range(60)], "anchor_id long, paired_id long")
    one = TR.TrainingConfig(hidden=8, output=4, batch_size=16, epochs=2, gradient_blocks=2)
    best, history = TR.fit(positives, recs, one)
    other, steps = TR.fit(positives, recs, dataclasses.replace(one, workers=0))
    assert (best.epoch, best.optimizer_state["step"]) == (other.epoch, other.optimizer_state["step"])
    np.testing.assert_allclose(np.array(history.collect()), np.array(steps.collect()), rtol=1e-9)


def test_jobs_of_an_epoch_do_not_grow_with_its_batches(spark):
    sc, jobs = spark.sparkContext, []
    for n in (32, 160):
        df, parts = batched(spark, n)
        head = PJ.Head.initial((10, 8, 4), 1)
        sc.setJobGroup(f"epoch of {n}", "")
        TR.train_epoch(df, head, TR.Adam(head, 1e-2), TR.TrainingConfig(workers=2), len(parts))
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"epoch of {n}")))
    sc.setJobGroup("", "")
    assert jobs[0] == jobs[1] <= 8


def test_batches_larger_than_a_block_are_shared_by_rows(tmp_path, monkeypatch):
    for module in (PJ, TR):
        monkeypatch.setattr(module, "BLOCK_CELLS", 150)
    r, n = np.random.default_rng(7), 41
    x, head = r.normal(size=(2 * n, 10)), PJ.Head.initial((10, 8, 4), 3)
    z = head.forward(x)
    sim = z @ z.T / 0.1
    np.fill_diagonal(sim, -np.inf)
    p = np.exp(sim) / np.exp(sim).sum(axis=1, keepdims=True)
    partner = (np.arange(2 * n) + n) % (2 * n)
    loss = -np.log(p[np.arange(2 * n), partner]).mean()
    want, grads = TR.gradient(head, x, 0.1)
    assert want == pytest.approx(loss, rel=1e-12)
    workers = 3

    def work(w):
        own = np.arange(w, n, workers)
        places = np.concatenate([own, TR.PARTNERS + own]).astype(np.float64)
        rows = np.concatenate([x[own], x[n + own]])
        return TR.joint_gradient(TR.Exchange(str(tmp_path / "ex"), w, workers), head, places, rows, 0.1)

    with ThreadPoolExecutor(workers) as pool:
        for got, parts in pool.map(work, range(workers)):
            assert got == pytest.approx(loss, rel=1e-12)
            for a, b in zip(parts, grads, strict=True):
                np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-12)


def plain_loss(z, temperature):
    """Loss and slope by all similarities at once."""
    n2 = len(z)
    sim = z @ z.T / temperature
    np.fill_diagonal(sim, -np.inf)
    top = sim.max(axis=1, keepdims=True)
    logs = top + np.log(np.exp(sim - top).sum(axis=1, keepdims=True))
    p = np.exp(sim - logs)
    partner = (np.arange(n2) + n2 // 2) % n2
    loss = (logs[:, 0] - sim[np.arange(n2), partner]).mean()
    return loss, (p @ z + p.T @ z - 2 * z[partner]) / n2 / temperature


@pytest.mark.parametrize("case", ["copies", "one", "not of unit length", "tiny temperature", "zeros"])
@pytest.mark.parametrize("side", [7, 256])
def test_large_batches_equal_all_similarities_at_once(case, side, monkeypatch):
    monkeypatch.setattr(PJ, "BLOCK_CELLS", 900)
    monkeypatch.setattr(PJ, "TILE", side)
    r = np.random.default_rng(11)
    z = r.normal(size=(40, 5))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    z = z[r.integers(0, 40, 64)] if case == "copies" else z[np.zeros(64, int)] if case == "one" else z
    z = 3.0 * z if case == "not of unit length" else np.zeros((64, 5)) if case == "zeros" else z
    temperature = 1e-3 if case == "tiny temperature" else 0.1
    loss, dz = PJ.batch_loss(z, temperature)
    want, slope = plain_loss(z, temperature)
    assert loss == pytest.approx(want, rel=1e-11, abs=1e-11)
    np.testing.assert_allclose(dz, slope, rtol=1e-9, atol=1e-11)


def test_rows_of_a_large_batch_are_compared_once_for_all_their_copies(monkeypatch):
    """A recording is an anchor and a partner of some; its copies, and the other way round, are no comparisons of their own."""
    r = np.random.default_rng(9)
    z = r.normal(size=(1000, 8))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    z = np.concatenate([z[r.permutation(1000)] for _ in range(4)])
    cells, real = [], np.exp

    def counted(x, *args, **kwargs):
        cells.append(np.size(x))
        return real(x, *args, **kwargs)

    made = getattr(PJ, "tiles", lambda *a: [])
    monkeypatch.setattr(PJ, "tiles", lambda *a: ((i, j, cells.append(t.size) or t) for i, j, t in made(*a)), raising=False)
    monkeypatch.setattr(np, "exp", counted)
    loss, dz = PJ.batch_loss(z, 0.1)
    monkeypatch.undo()
    want, slope = plain_loss(z, 0.1)
    assert loss == pytest.approx(want, rel=1e-12)
    np.testing.assert_allclose(dz, slope, rtol=1e-9, atol=1e-13)
    assert sum(cells) < 2 * 1000**2 < 2 * 4000**2 / 10


def test_memory_of_a_batch_does_not_grow_with_its_square():
    z = np.random.default_rng(8).normal(size=(6000, 4))
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    tracemalloc.start()
    try:
        PJ.batch_loss(z, 0.1)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 80 << 20  # all similarities would be 288 MB


LOST = """
import os, sys
sys.path.insert(0, {root!r})
from pyspark import BarrierTaskContext
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4, 3]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.checkpoint.dir", {mark!r} + "-shared").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
from steadyhum.operators import projection as PJ, training as TR
from tests.test_barrier import batched, sequential
import numpy as np
df, parts = batched(spark)
head = PJ.Head.initial((10, 8, 4), 1)
real, mark = TR.joint_gradient, {mark!r}
def failing(exchange, model, places, x, temperature, calls=[]):
    calls.append(1)
    if exchange.worker == 1 and len(calls) == 3 and not os.path.exists(mark):
        open(mark, "w").close()
        raise RuntimeError("lost")
    return real(exchange, model, places, x, temperature)
import cloudpickle
from pyspark import cloudpickle as spark_pickle
TR.joint_gradient = failing
spark_pickle.register_pickle_by_value(TR)
got, adam, _ = TR.train_epoch(df, head, TR.Adam(head, 1e-2), TR.TrainingConfig(workers=2), len(parts))
TR.joint_gradient = real
want, state, _ = sequential(parts, head, 1e-2, 0.1)
for p, q in zip(got.parts(), want.parts()):
    np.testing.assert_allclose(p, q, rtol=1e-9, atol=1e-12)
assert os.path.exists(mark) and adam.t == len(parts)
print("recovered")
"""


def test_a_lost_task_starts_the_epoch_again(tmp_path):
    code = LOST.format(root=ROOT, mark=str(tmp_path / "lost")).replace("import cloudpickle\n", "")
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=180, cwd=ROOT)
    assert "recovered" in done.stdout, done.stderr[-3000:]
