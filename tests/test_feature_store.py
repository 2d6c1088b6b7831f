"""The feature store under concurrent, repeated and broken runs."""

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from steadyhum.functions import bloom, files
from steadyhum.functions.scale import fresh_path
from steadyhum.sources import feature_store as FS
from steadyhum.sources.stores import STORE_KEY

SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in STORE_KEY] + [T.StructField("vector", T.ArrayType(T.FloatType()))]
)


def recordings(spark, numbers):
    rows = [("pump", f"id_{i % 3}", "normal", f"{i:05d}.wav", "x") for i in numbers]
    return spark.createDataFrame(rows, "machine_type string, machine_id string, label string, filename string, _may string")


def computing(value, seen=None):
    def compute(misses):
        if seen is not None:
            seen.append(sorted(r.stem for r in misses.select("stem").collect()))
        return misses.select(*STORE_KEY, F.array(F.lit(float(value)).cast("float")).alias("vector"))

    return compute


def content(spark, path):
    rows = FS.rows_of(spark, path, FS.latest(spark, path).commits, SCHEMA).collect()
    return sorted((r.stem, r.vector[0]) for r in rows)


def names(numbers):
    return [f"{i:05d}" for i in numbers]


def test_only_missing_rows_are_computed_and_wanted_ones_returned(spark):
    path, seen = fresh_path(spark, "store"), []
    first = FS.extend_store(recordings(spark, range(6)), path, computing(1, seen), SCHEMA)
    assert sorted(r.stem for r in first.collect()) == names(range(6)) and first.columns == SCHEMA.names
    again = FS.extend_store(recordings(spark, range(3, 9)), path, computing(2, seen), SCHEMA)
    assert sorted((r.stem, r.vector[0]) for r in again.collect()) == list(zip(names(range(3, 9)), [1.0] * 3 + [2.0] * 3))
    assert seen == [names(range(6)), names(range(6, 9))]
    before = FS.latest(spark, path)
    FS.extend_store(recordings(spark, range(9)), path, computing(3, seen), SCHEMA)
    assert len(seen) == 2 and FS.latest(spark, path) == before  # a repeated run adds nothing


def test_two_writers_at_a_time_leave_one_row_per_key(spark):
    path = fresh_path(spark, "store")
    sets = [range(0, 40), range(20, 60), range(10, 50)]
    with ThreadPoolExecutor(3) as pool:
        got = list(pool.map(lambda k: FS.extend_store(recordings(spark, sets[k]), path, computing(k), SCHEMA).count(), range(3)))
    assert got == [40, 40, 40]
    assert [k for k, _ in content(spark, path)] == names(range(60))


def test_the_second_writer_drops_what_the_first_has_added(spark):
    """Both have seen the empty store; the second commits later."""
    path, empty = fresh_path(spark, "store"), FS.Snapshot()
    rows = {k: computing(k)(recordings(spark, r).withColumn("stem", F.substr("filename", F.lit(1), F.lit(5)))) for k, r in ((1, range(4)), (2, range(2, 7)))}
    FS.add(rows[1], path, empty, SCHEMA)
    after = FS.add(rows[2], path, empty, SCHEMA)
    assert (after.version, [c.rows for c in after.commits]) == (2, [4, 3])
    assert content(spark, path) == list(zip(names(range(7)), [1.0] * 4 + [2.0] * 3))
    assert FS.add(rows[2], path, empty, SCHEMA).version == 2  # nothing left to add


def test_files_of_a_broken_run_and_repeated_keys_do_not_count(spark):
    path = fresh_path(spark, "store")
    keyed = recordings(spark, [1, 1, 2]).withColumn("stem", F.substr("filename", F.lit(1), F.lit(5)))
    FS.write_commit(computing(9)(keyed), path, SCHEMA)  # never committed
    assert FS.latest(spark, path) == FS.Snapshot()
    FS.extend_store(recordings(spark, [1, 1, 2]), path, computing(1), SCHEMA)
    assert content(spark, path) == [("00001", 1.0), ("00002", 1.0)]


def test_compaction_keeps_the_rows(spark):
    path = fresh_path(spark, "store")
    for k in range(3):
        FS.extend_store(recordings(spark, range(5 * k, 5 * k + 5)), path, computing(k), SCHEMA)
    before = content(spark, path)
    made = FS.compact(spark, path, SCHEMA)
    assert len(made.commits) == 1 and content(spark, path) == before
    FS.extend_store(recordings(spark, range(20)), path, computing(7), SCHEMA)
    assert content(spark, path) == before + list(zip(names(range(15, 20)), [7.0] * 5))


def test_new_keys_are_settled_by_the_filters(spark):
    path = fresh_path(spark, "store")
    FS.extend_store(recordings(spark, range(2000)), path, computing(1), SCHEMA)
    commits = FS.latest(spark, path).commits
    keyed = FS.with_store_key(recordings(spark, range(1500, 6000))).select(*STORE_KEY)
    new, maybe = FS.split_by_filters(keyed, path, commits)
    assert 500 <= maybe.count() < 540 and new.count() + maybe.count() == 4500
    assert FS.missing_keys(keyed, path, commits, SCHEMA).count() == 4000
    plan = FS.missing_keys(keyed, path, commits, SCHEMA)._jdf.queryExecution().optimizedPlan().toString()
    assert "_may#" in plan[plan.index("LeftAnti") :]  # below the join, and so before its shuffle


def test_null_keys_are_keys(spark):
    path = fresh_path(spark, "store")
    rows = spark.createDataFrame([("pump", None, "normal", "1.wav", "x")], recordings(spark, [1]).schema)
    for value in (1, 2):
        assert FS.extend_store(rows, path, computing(value), SCHEMA).count() == 1
    assert content(spark, path) == [("1", 1.0)]


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_filters_hold_their_keys(spark, n):
    r = np.random.default_rng(n)
    keys = r.integers(-(2**62), 2**62, n).tolist()
    folder, bits = fresh_path(spark, "filter"), bloom.bits_for(n)
    bloom.write_filter(spark.createDataFrame([(k,) for k in [*keys, None]], "key long").repartition(3), folder, bits)
    tested = spark.createDataFrame([(k,) for k in keys] + [(2**62 + i,) for i in range(3000)], "key long")
    counts = tested.groupBy((F.col("key") < 2**62).alias("held"), bloom.may_contain(F.col("key"), [(folder, bits)]).alias("may")).count()
    got = {(c.held, c.may): c["count"] for c in counts.collect()}
    assert (True, False) not in got and got.get((True, True), 0) == n and got.get((False, True), 0) < 100


def test_a_name_is_taken_once(spark, tmp_path):
    path = f"file:{tmp_path}/a b/x.json"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: files.create_once(spark, path, f"writer {i}"), range(8)))
    assert sum(won) == 1 and (tmp_path / "a b" / "x.json").read_text() == f"writer {won.index(True)}"
    (tmp_path / "source").write_text("other")
    assert not files._renamed(spark, f"file:{tmp_path}/source", path)
    assert files._renamed(spark, f"file:{tmp_path}/source", f"file:{tmp_path}/new")
    assert files.names_in(spark, f"file:{tmp_path}/a b") == ["x.json"] and files.names_in(spark, f"file:{tmp_path}/none") == []
