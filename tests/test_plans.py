"""Shapes of the physical plans that matter on a large cluster."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from steadyhum.functions.scale import materialize
from steadyhum.operators import catalog as C
from steadyhum.operators import drift as D
from steadyhum.operators import features as FT
from steadyhum.operators import health as H
from steadyhum.operators import pairs as PR
from steadyhum.operators import profile as P
from steadyhum.plans import QUERIES
from steadyhum.plans import views as X

SF = "/root/testdata/sf0.001"


def plan_of(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture(scope="module")
def recs(spark):
    return X.recordings(spark, SF)


def test_scoring_does_not_shuffle(recs):
    fitted = P.fit_profile(recs.where("label = 'normal'"))
    plan = plan_of(H.health(D.drift(recs, fitted)))
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_oversized_profiles_are_salted(spark, recs, monkeypatch):
    from steadyhum.functions import scale

    profile = materialize(P.build_profile(recs), "profile")
    joined = scale.bounded_join(recs, profile, C.MACHINE, [F.col("filename")], F.lit(10), limit=0)
    assert "_salt" in plan_of(joined)


def test_features_do_not_shuffle(spark):
    waves = spark.range(4).select(F.col("id").alias("rec_id"), F.array_repeat(F.lit(0.1), 16000).alias("samples"))
    plan = plan_of(FT.extract(waves, ["rec_id"]))
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_scan_reads_only_needed_columns(recs):
    plan = plan_of(C.machine_ids(recs.drop("vector"), "fan"))
    assert "embedding:array" not in plan


def test_filters_reach_the_scan(spark):
    plan = plan_of(X.table(spark, SF, "embeddings").where("label = 3 and vec_id > 10"))
    assert "EqualTo(label,3)" in plan and "GreaterThan(vec_id,10)" in plan


def test_first_n_thins_before_the_shuffle(recs):
    assert "WindowGroupLimit" in plan_of(C.cap_per_machine(recs.drop("vector"), 5))


@pytest.mark.parametrize("name", ["negative_pairs", "positive_pairs", "balanced_pairs", "roc_curve", "score_distribution", "drift_trend", "sample_evenly", "feature_rows"])
def test_no_cross_joins(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_pairs_carry_no_vectors(recs):
    assert "embedding:array" not in plan_of(PR.indexed(recs))


def test_batches_are_formed_from_keys(spark, recs, monkeypatch):
    from steadyhum.operators import training as TR

    stored = []
    monkeypatch.setattr(TR, "materialize", lambda df, name: stored.append((name, df)) or materialize(df, name))
    positives = PR.build_pairs(recs.where("label = 'normal'").drop("vector")).where("label = 1")
    config = TR.TrainingConfig(batch_size=16, max_steps=3)
    arranged, steps = TR.epoch_steps(positives, recs, config, 1)
    keys = plan_of(dict(stored)["batches_1"])
    assert "embedding:array" not in keys and "Window" in keys
    assert "Window" not in plan_of(dict(stored)["epoch_1"])
    assert steps == 3 and arranged.select("step").distinct().count() == 3
    assert "PushedFilters: [IsNotNull(step), EqualTo(step,1)]" in plan_of(arranged.where("step = 1"))


def test_steps_do_not_merge_batches_unless_asked(spark):
    from steadyhum.operators import training as TR

    pairs = spark.range(2200).selectExpr("id AS anchor_id", "id + 1 AS paired_id")
    vectors = spark.range(2201).selectExpr("id AS rec_id", "array(1.0D, 2.0D) AS vector")
    assert TR.epoch_steps(pairs, vectors, TR.TrainingConfig(batch_size=2), 1)[1] == 1100
    assert TR.epoch_steps(pairs, vectors, TR.TrainingConfig(batch_size=2, max_steps=550), 1)[1] == 550


def test_the_full_report_computes_features_once(spark, monkeypatch):
    from steadyhum.plans import from_files as FF

    calls = []
    real = FF.dsp_vectors
    monkeypatch.setattr(FF, "dsp_vectors", lambda *a: calls.append(1) or real(*a))
    report = QUERIES["full_report"](spark, SF)
    assert calls == [1]
    plan = plan_of(report)
    assert "samples" not in plan and "feature_vector" not in plan and "Exchange hashpartitioning" not in plan


def test_the_full_report_cuts_its_clips_once(spark, monkeypatch):
    from steadyhum.plans import flagship_queries as FQ

    calls = []
    monkeypatch.setattr(FQ, "full_report", lambda decoded, embeddings, *a: calls.extend([decoded, embeddings]) or FQ.materialize(decoded, "x"))
    with contextlib.suppress(Exception):
        QUERIES["full_report"](spark, SF)
    decoded, embeddings = calls
    assert "Window" not in plan_of(decoded) and "Window" not in plan_of(embeddings)
