import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from steadyhum.functions.ranking import first_n, number_rows, quantile_bucket
from steadyhum.operators.evaluate import trend_series
from steadyhum.operators import catalog as C
from steadyhum.sources import recordings as R
from steadyhum.sources import feature_store as FS
from steadyhum.sources import stores as S


def recs_of(spark, counts, label="normal"):
    rows = [("pump", m, label, f"{m}_{i:05d}.wav") for m, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "machine_type string, machine_id string, label string, filename string")


def fill(counts, cap):
    """The round-robin fill, one id at a time."""
    left, taken, pending, remaining = dict(counts), dict.fromkeys(counts, 0), sorted(counts), cap
    while remaining > 0 and pending:
        share, following = max(1, remaining // len(pending)), []
        for m in pending:
            n = min(share, left[m])
            left[m] -= n
            taken[m] += n
            remaining -= n
            if left[m] and remaining > 0:
                following.append(m)
        if len(following) == len(pending):
            break
        pending = following
    return {m: n for m, n in taken.items() if n}


@pytest.mark.parametrize(
    "counts, cap, total",
    [
        ({"a": 100, "b": 100, "c": 100}, 10, 9),
        ({"a": 5, "b": 5, "c": 5, "d": 5}, 2, 4),
        ({"a": 1, "b": 100}, 10, 10),
        ({"a": 1, "b": 3, "c": 40, "d": 200}, 57, None),
        ({"a": 2, "b": 2}, 100, 4),
        ({"a": 2}, 0, 0),
    ],
)
def test_even_sampling(spark, counts, cap, total):
    got = {r["machine_id"]: r["count"] for r in C.sample_evenly(recs_of(spark, counts), cap).groupBy("machine_id").count().collect()}
    assert got == fill(counts, cap)
    if total is not None:
        assert sum(got.values()) == total


def test_pinned_sampling_is_a_head(spark):
    got = C.sample_evenly(recs_of(spark, {"a": 20}), 7, pin_id=True).collect()
    assert sorted(r["filename"] for r in got) == [f"a_{i:05d}.wav" for i in range(7)]


def test_single_normal_is_profile_and_held_out(spark):
    flags = C.hold_out_first_normal(recs_of(spark, {"a": 1, "b": 3})).orderBy("filename").collect()
    assert [(r["is_held_out"], r["in_profile"]) for r in flags] == [(True, True), (True, False), (False, True), (False, True)]


def test_hot_group_ranking_matches_window(spark):
    df = spark.range(5000).select(
        "id", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7).alias("k"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("v")
    )
    ranked = number_rows(df, ["k"], [F.col("v"), F.col("id")], quantile_bucket(df, "v"), "p", total="n")
    from pyspark.sql import Window as W

    w = W.partitionBy("k").orderBy("v", "id")
    direct = df.select("*", F.row_number().over(w).cast("long").alias("p"), F.count("*").over(W.partitionBy("k")).alias("n"))
    assert ranked.select(*direct.columns).exceptAll(direct).count() == 0 and ranked.count() == 5000
    top = first_n(df, ["k"], [F.col("v"), F.col("id")], 4, [F.col("id")])
    assert top.select("id").exceptAll(direct.where("p <= 4").select("id")).count() == 0
    assert top.count() == direct.where("p <= 4").count()


def test_scan_missing_root_raises(spark, tmp_path):
    with pytest.raises(AnalysisException):
        R.scan_files(spark, str(tmp_path / "nothing"))


def test_path_outside_root_is_rejected(spark):
    df = spark.createDataFrame([("file:/data/x/pump/id_00/normal/1.wav",), ("/other/1.wav",)], "path string")
    parsed = R.parse_paths(df.withColumn("relative_path", R.relative_path(F.col("path"), "/data/x")))
    assert sorted((r["reject_reason"] or "") for r in parsed.collect()) == ["", "not under root"]


def test_store_grows_once(spark, tmp_path):
    recs = recs_of(spark, {"a": 3, "b": 2})
    schema = S.with_store_key(recs).select(*S.STORE_KEY).withColumn("value", F.lit(1.0)).schema
    path = str(tmp_path / "store")

    def compute(value):
        return lambda misses: misses.withColumn("value", F.lit(value))

    first = FS.extend_store(recs.where("machine_id = 'a'"), path, compute(1.0), schema)
    assert first.count() == 3
    again = FS.extend_store(recs, path, compute(2.0), schema)
    assert sorted(r["value"] for r in again.collect()) == [1.0, 1.0, 1.0, 2.0, 2.0]
    assert S.store_coverage(recs, again).first().asDict() == {"hits": 5, "misses": 0, "total": 5}


def test_required_columns(spark):
    with pytest.raises(ValueError, match="label"):
        S.require_columns(spark.range(1), ["id", "label"])


@pytest.mark.parametrize("root", ["/data/x", "/data/x/", "file:///data/x", "file:/data/x", "../data/x", "s3a://bucket/x"])
def test_roots_as_paths_and_uris(spark, monkeypatch, root):
    monkeypatch.chdir("/tmp")
    listed = "s3a://bucket/x/fan/a.wav" if root.startswith("s3a") else "file:///data/x/fan/a.wav"
    df = spark.createDataFrame([(listed,), ("file:///data/xy/fan/a.wav",)], "path string")
    got = df.select(R.relative_path(F.col("path"), root).alias("r")).collect()
    assert [r.r for r in got] == ["fan/a.wav", None]


def test_first_rows_of_any_number_match_a_window(spark):
    from pyspark.sql import Window as W

    df = spark.range(20000).select(
        "id", (F.col("id") % 3).alias("k"), F.lpad(F.pmod(F.xxhash64("id"), F.lit(5000)).cast("string"), 5, "0").alias("path")
    )
    order = [F.col("path"), F.col("id")]
    direct = df.withColumn("p", F.row_number().over(W.partitionBy("k").orderBy(*order)))
    for n in (3, 5000):
        top = first_n(df, ["k"], order, n, [F.col("id")], "p").select("id", "k", "path", F.col("p").cast("int"))
        wanted = direct.where(F.col("p") <= n)
        assert top.count() == wanted.count() and top.exceptAll(wanted).count() == 0


def test_trends_follow_paths(spark):
    rows = [("fan", m, f"{m}/{i:03d}.wav", float(i)) for m in ("a", "b") for i in (5, 3, 9, 1)]
    df = spark.createDataFrame(rows, "machine_type string, machine_id string, relative_path string, health_score double")
    out = trend_series(df, "health_score", "relative_path").orderBy("machine_id", "recording_index").collect()
    assert [(r["recording_index"], r["value"]) for r in out] == [(0, 1.0), (1, 3.0), (2, 5.0), (3, 9.0)] * 2
