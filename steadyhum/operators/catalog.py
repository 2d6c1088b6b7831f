"""Catalog projections, filters, hold-outs and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import first_n

MACHINE = ["machine_type", "machine_id"]


def filter_recordings(
    recs: DataFrame,
    machine_type: str | None = None,
    machine_id: str | None = None,
    label: str | None = None,
) -> DataFrame:
    """Conjunctive filter; machine_id alone matches across machine types."""
    wanted = {"machine_type": machine_type, "machine_id": machine_id, "label": label}
    for name, value in wanted.items():
        if value is not None:
            recs = recs.where(F.col(name) == value)
    return recs


def machine_types(recs: DataFrame) -> DataFrame:
    return recs.select("machine_type").distinct().orderBy("machine_type")


def machine_ids(recs: DataFrame, machine_type: str | None = None) -> DataFrame:
    picked = filter_recordings(recs, machine_type=machine_type)
    return picked.select("machine_id").distinct().orderBy("machine_id")


def summary(recs: DataFrame) -> DataFrame:
    """One row: numbers of machine types and ids, recordings by label; the names themselves are
    the tables ``machine_types`` and ``machine_ids``."""
    return recs.agg(
        F.count_distinct("machine_type").alias("n_machine_types"),
        F.count_distinct("machine_id").alias("n_machine_ids"),
        F.count_if(F.col("label") == "normal").alias("n_normal"),
        F.count_if(F.col("label") == "abnormal").alias("n_abnormal"),
        F.count(F.lit(1)).alias("n_total"),
    )


def recordings_per_machine_id(recs: DataFrame) -> DataFrame:
    return recs.groupBy("machine_id").agg(F.count(F.lit(1)).alias("n_recordings"))


def cap_per_machine(recs: DataFrame, n: int, order: str = "filename", by_label: bool = True) -> DataFrame:
    """First ``n`` recordings of each machine (and label) in path order."""
    keys = [*MACHINE, "label"] if by_label else MACHINE
    return first_n(recs, keys, [F.col(order)], n, [F.col(order)])


def first_normal(recs: DataFrame, order: str = "filename") -> DataFrame:
    """Per machine: first normal recording and the number of normal recordings."""
    normal = recs.where(F.col("label") == "normal")
    return normal.groupBy(*MACHINE).agg(
        F.min(order).alias("held_out"), F.count(F.lit(1)).alias("n_normal")
    )


def hold_out_first_normal(recs: DataFrame, order: str = "filename") -> DataFrame:
    """Flag ``in_profile`` and ``is_held_out``: the first normal recording tests the profile.

    A machine with a single normal recording uses it for both. The machine-level side is a
    partial aggregate; only the held-out keys, one per machine, meet the recordings again,
    joined on (machine, order) so that a hot machine is spread.
    """
    heads = first_normal(recs, order).select(
        *MACHINE, F.col("held_out").alias(order), F.col("n_normal"), F.lit("normal").alias("label")
    )
    joined = recs.join(heads, [*MACHINE, "label", order], "left")
    held = F.col("n_normal").isNotNull()
    return joined.select(
        *recs.columns,
        held.alias("is_held_out"),
        ((F.col("label") == "normal") & (~held | (F.col("n_normal") == 1))).alias("in_profile"),
    )


def exclude_files(recs: DataFrame, excluded: DataFrame) -> DataFrame:
    """Profile candidates without an explicit set of (machine, filename)."""
    keys = [*MACHINE, "filename"]
    return recs.join(excluded.select(*keys), keys, "left_anti")


def even_quota(counts: DataFrame, max_recordings: int) -> int:
    """Rows granted to each id by the round-robin fill over per-id counts.

    Every round grants ``max(1, remaining // pending)`` to each id that still has rows, and
    the fill stops when a round exhausts no id. All pending ids receive the same grant, so
    the outcome is a single number; an id with fewer rows simply gives all it has. Only the
    histogram of counts (at most sqrt(2N) rows) comes to the driver.
    """
    histogram = [
        (r["n_recordings"], r["ids"])
        for r in counts.groupBy("n_recordings").agg(F.count(F.lit(1)).alias("ids")).collect()
    ]
    granted, remaining = 0, max_recordings
    while remaining > 0:
        pending = sum(ids for n, ids in histogram if n > granted)
        if pending == 0:
            break
        share = max(1, remaining // pending)
        remaining -= sum(ids * min(share, n - granted) for n, ids in histogram if n > granted)
        granted += share
        if sum(ids for n, ids in histogram if n > granted) == pending:
            break
    return granted


def sample_evenly(
    recs: DataFrame, max_recordings: int, pin_id: bool = False, order: str = "filename"
) -> DataFrame:
    """Up to ``max_recordings`` in path order, spread evenly over machine ids.

    With ``pin_id`` there is one id and this is a plain head. Small caps still give every
    id one row, so the result can exceed the cap when there are more ids than rows asked.
    """
    if pin_id:
        return recs.orderBy(order).limit(max_recordings)
    quota = even_quota(recordings_per_machine_id(recs), max_recordings)
    return first_n(recs, ["machine_id"], [F.col(order)], max(quota, 0), [F.col(order)]).drop("position")


def first_evaluable_machine(recs: DataFrame) -> DataFrame:
    """The first machine, in key order, that has recordings of both labels."""
    both = recs.groupBy(*MACHINE).agg(
        F.count_if(F.col("label") == "normal").alias("n_normal"),
        F.count_if(F.col("label") == "abnormal").alias("n_abnormal"),
    )
    ready = both.where((F.col("n_normal") > 0) & (F.col("n_abnormal") > 0))
    return ready.orderBy(*MACHINE).limit(1)


def lock_to_first_machine(recs: DataFrame) -> DataFrame:
    """Recordings of ``first_evaluable_machine``; the other side is one row by its limit."""
    locked = first_evaluable_machine(recs).select(*MACHINE)
    return recs.join(F.broadcast(locked), MACHINE, "left_semi")


def evaluation_set(normal: DataFrame, abnormal: DataFrame, *columns: str | Column) -> DataFrame:
    """Both classes with y_true 0/1 and the tags healthy/abnormal."""
    picked = columns or ("*",)
    healthy = normal.select(*picked, F.lit(0).alias("y_true"), F.lit("healthy").alias("tag"))
    faulty = abnormal.select(*picked, F.lit(1).alias("y_true"), F.lit("abnormal").alias("tag"))
    return healthy.unionByName(faulty)
