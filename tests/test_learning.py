import numpy as np
import pytest
from pyspark.sql import functions as F

from steadyhum.functions.ranking import HASH_MODULUS, seeded_hash
from steadyhum.operators import pairs as PR
from steadyhum.operators import projection as PJ
from steadyhum.operators import training as TR


def recs_of(spark, counts):
    rows, i = [], 0
    for m, n in counts.items():
        for _ in range(n):
            rows.append((i, "pump", m))
            i += 1
    return spark.createDataFrame(rows, "rec_id long, machine_type string, machine_id string")


def test_pairs_of_a_dominant_machine(spark):
    recs = recs_of(spark, {"big": 400, "small": 30, "two": 2, "one": 1})
    machine = {r["rec_id"]: r["machine_id"] for r in recs.collect()}
    pairs = PR.build_pairs(recs).collect()
    pos = [(r["anchor_id"], r["paired_id"]) for r in pairs if r["label"] == 1]
    neg = [(r["anchor_id"], r["paired_id"]) for r in pairs if r["label"] == 0]
    assert len(pos) == 432 and len({a for a, _ in pos}) == 432
    assert all(a != b and machine[a] == machine[b] for a, b in pos)
    assert len(neg) == 3 * 433 == len(set(neg))
    assert all(machine[a] != machine[b] for a, b in neg)


def test_single_machine_has_no_negatives(spark):
    pairs = PR.build_pairs(recs_of(spark, {"only": 6}))
    assert pairs.where("label = 0").count() == 0 and pairs.count() == 6
    assert PR.balance(pairs).count() == 0


def test_small_pool_limits_negatives(spark):
    pairs = PR.build_pairs(recs_of(spark, {"a": 5, "b": 2})).where("label = 0")
    per_anchor = {r["anchor_id"]: r["count"] for r in pairs.groupBy("anchor_id").count().collect()}
    assert [per_anchor[i] for i in range(7)] == [2] * 5 + [3] * 2


def test_balance_split_and_batches(spark):
    pairs = PR.build_pairs(recs_of(spark, {"a": 40, "b": 25}))
    both = PR.balance(pairs).groupBy("label").count().collect()
    assert {r["label"]: r["count"] for r in both} == {0: 65, 1: 65}
    positives = pairs.where("label = 1")
    split = PR.split_validation(positives, 0.2, 7)
    assert split.where("is_validation").count() == 13 and split.count() == 65
    sizes = sorted(r["count"] for r in PR.batches(positives, 32, 7).groupBy("batch").count().collect())
    assert sizes == [32, 32]
    assert sorted(r["batch_position"] for r in PR.batches(positives, 32, 7).where("batch = 1").collect()) == list(range(32))


def test_split_errors(spark):
    one = spark.createDataFrame([(1, 2)], "anchor_id long, paired_id long")
    assert PR.split_violations(one).first()["violation"] == "fewer than two positive pairs"
    two = spark.createDataFrame([(1, 2), (2, 1)], "anchor_id long, paired_id long")
    assert PR.split_violations(two).first()["violation"] == "fewer than two training pairs"


def loss_by_definition(a, b, t):
    z = np.concatenate([a, b])
    n = len(a)
    out = []
    for i in range(2 * n):
        s = np.array([z[i] @ z[j] / t for j in range(2 * n) if j != i])
        out.append(np.log(np.exp(s).sum()) - z[i] @ z[(i + n) % (2 * n)] / t)
    return np.mean(out)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_loss_against_definition(spark):
    rng = np.random.default_rng(0)
    a, b = unit(rng.normal(size=(8, 16))), unit(rng.normal(size=(8, 16)))
    rows = [(i // 4, a[i].tolist(), b[i].tolist()) for i in range(8)]
    got = PJ.nt_xent(spark.createDataFrame(rows, "batch long, a array<double>, b array<double>")).orderBy("batch").collect()
    for k, r in enumerate(got):
        s = slice(4 * k, 4 * k + 4)
        assert r["loss"] == pytest.approx(loss_by_definition(a[s], b[s], 0.1)) and r["n_pairs"] == 4
    with pytest.raises(ValueError):
        PJ.nt_xent(spark.createDataFrame(rows, "batch long, a array<double>, b array<double>"), temperature=0.0)


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(1)
    head = PJ.Head.initial((7, 6, 5), 3)
    x = rng.normal(size=(8, 7))
    _, grads = TR.gradient(head, x, 0.3)
    for p, g in zip(head.parts(), grads):
        for at in [tuple(rng.integers(0, n) for n in p.shape) for _ in range(6)]:
            kept, h = p[at], 1e-6
            p[at] = kept + h
            up = TR.gradient(head, x, 0.3)[0]
            p[at] = kept - h
            down = TR.gradient(head, x, 0.3)[0]
            p[at] = kept
            assert g[at] == pytest.approx((up - down) / (2 * h), rel=1e-4, abs=1e-8)


def clustered(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(3, 10))
    rows = [(i, "pump", f"id_{i % 3}", [float(v) for v in centers[i % 3] + rng.normal(0, 0.8, 10)]) for i in range(90)]
    return spark.createDataFrame(rows, "rec_id long, machine_type string, machine_id string, vector array<double>")


def test_training_lowers_the_loss_and_round_trips(spark, tmp_path):
    recs = clustered(spark)
    positives = PR.build_pairs(recs.drop("vector")).where("label = 1")
    config = TR.TrainingConfig(hidden=12, output=6, batch_size=16, epochs=4, learning_rate=1e-2, gradient_blocks=3)
    best, history = TR.fit(positives, recs, config)
    losses = [r["training_loss"] for r in history.orderBy("epoch").collect()]
    assert len(losses) == 4 and losses[-1] < losses[0]
    chosen = PJ.best_epoch(history).first()
    assert (best.epoch, best.validation_loss) == (chosen["epoch"], pytest.approx(chosen["validation_loss"]))
    PJ.save_checkpoint(spark, best, str(tmp_path / "best"), "head")
    loaded = PJ.load_checkpoint(spark, str(tmp_path / "best"))
    for p, q in zip(best.head.parts(), loaded.head.parts()):
        np.testing.assert_array_equal(p, q)
    assert loaded.config["batch_size"] == 16 and loaded.optimizer_state["step"] == best.optimizer_state["step"]
    projected = PJ.project(recs, loaded.head, "vector")
    assert PJ.projection_violations(projected, ["rec_id"], 6).count() == 0


def test_one_batch_per_step_is_sequential_training(spark):
    recs = clustered(spark)
    vectors = {r["rec_id"]: np.array(r["vector"]) for r in recs.collect()}
    positives = PR.build_pairs(recs.drop("vector")).where("label = 1")
    c = TR.TrainingConfig(hidden=8, output=4, batch_size=16, epochs=1, gradient_blocks=2)
    _, history = TR.fit(positives, recs, c)
    train = PR.split_validation(positives, c.validation_share, c.seed).where("not is_validation")
    rows = PR.batches(train, c.batch_size, c.seed + 101).orderBy("batch", "batch_position").collect()
    head, losses = PJ.Head.initial((10, 8, 4), c.seed), []
    adam = TR.Adam(head, c.learning_rate)
    for k in sorted({r["batch"] for r in rows}):
        batch = [r for r in rows if r["batch"] == k]
        x = np.stack([vectors[r["anchor_id"]] for r in batch] + [vectors[r["paired_id"]] for r in batch])
        loss, grads = TR.gradient(head, x, c.temperature)
        losses.append(loss)
        head = adam.step(head, grads)
    assert history.first()["training_loss"] == pytest.approx(np.mean(losses), rel=1e-9)


def test_checkpoint_contract(spark, tmp_path):
    path = str(tmp_path / "bad")
    PJ.save_weights(PJ.weights_table(spark, PJ.Head.initial((3, 2, 2)), "m"), f"{path}/weights")
    spark.createDataFrame([("m", 1)], "model_id string, epoch int").write.parquet(f"{path}/checkpoint")
    with pytest.raises(ValueError, match="validation_loss"):
        PJ.load_checkpoint(spark, path)


def test_best_epoch_keeps_the_earliest_tie(spark):
    rows = [(1, 2.0, 2.1), (2, 1.5, 1.8), (3, 1.2, 1.8), (4, 1.1, 1.9), (5, 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "epoch int, training_loss double, validation_loss double")
    assert PJ.best_epoch(df).first()["epoch"] == 2


def test_production_head_dimensions(spark):
    head = PJ.Head.initial()
    df = spark.createDataFrame([([0.01 * i for i in range(921)],)], "fused_vector array<float>")
    row = PJ.project(df, head).first()
    assert len(row["embedding"]) == 256 and np.linalg.norm(row["embedding"]) == pytest.approx(1.0)
    assert PJ.projection_violations(PJ.project(df.withColumn("k", F.lit(1)), head), ["k"], 128).first()["violation"] == "wrong dimension"


def test_another_seed_gives_an_unrelated_order(spark):
    ids = spark.range(10000)
    picked = [
        {r.id for r in ids.where(seeded_hash(F.col("id"), seed) < HASH_MODULUS // 5).collect()} for seed in (47, 48, 1047)
    ]
    for a in range(3):
        assert 0.18 < len(picked[a]) / 10000 < 0.22
        for b in range(a):
            assert 0.15 < len(picked[a] & picked[b]) / len(picked[a]) < 0.25


def test_a_table_of_two_models_is_not_merged(spark):
    heads = [PJ.Head.initial((6, 4, 2), seed) for seed in (1, 2)]
    table = PJ.weights_table(spark, heads[0], "a").union(PJ.weights_table(spark, heads[1], "b"))
    assert np.array_equal(PJ.head_from_table(table, "b").w1, heads[1].w1)
    with pytest.raises(ValueError, match="several models"):
        PJ.head_from_table(table)
