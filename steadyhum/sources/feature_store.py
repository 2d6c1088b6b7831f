"""A store of feature rows that several runs may extend at a time.

The store is a folder of immutable commits, each the rows of one writer with a Bloom filter of their keys, and of
numbered snapshots, small files that list the commits. A row is in the store when a snapshot lists its commit:

* a writer computes what its snapshot lacks, writes it as a commit, and creates the next snapshot in one
  step that only one writer can take;
* a writer that comes second drops the keys that the first has added, and tries the next number; what it
  computed is not computed again;
* a run that is repeated finds its keys stored, and a run that breaks off leaves files that no snapshot lists.

So every key has one row. Keys that no filter knows are new without a look at the store; only the
others are shuffled, to be compared with it. A filter has 16 bits per row; when all of them together
pass the bound of ``functions.bloom``, all keys are compared. ``compact`` makes many commits one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bloom import bits_for, may_contain, write_filter
from ..functions.files import create_once, names_in
from ..functions.scale import bounded_join, fresh_path, materialize
from .stores import STORE_KEY, with_store_key

DIGITS = 12


@dataclass(frozen=True)
class Commit:
    id: str
    rows: int
    filter_bits: int


@dataclass(frozen=True)
class Snapshot:
    version: int = 0
    commits: tuple[Commit, ...] = ()


def latest(spark: SparkSession, path: str) -> Snapshot:
    """The newest snapshot; an empty one where there is no store yet."""
    names = [n for n in names_in(spark, f"{path}/snapshots") if n.endswith(".json")]
    if not names:
        return Snapshot()
    text = spark.read.text(f"{path}/snapshots/{max(names)}", wholetext=True).first()[0]
    found = json.loads(text)
    return Snapshot(found["version"], tuple(Commit(**c) for c in found["commits"]))


def commit(spark: SparkSession, path: str, snapshot: Snapshot) -> bool:
    """Make ``snapshot`` the newest one, unless there is one of its number."""
    text = json.dumps({"version": snapshot.version, "commits": [asdict(c) for c in snapshot.commits]})
    return create_once(spark, f"{path}/snapshots/{snapshot.version:0{DIGITS}d}.json", text)


def key_hash() -> Column:
    return F.xxhash64(*STORE_KEY)


def same_key(left: DataFrame, right: DataFrame) -> Column:
    """Equality of the store's keys; null equals null."""
    both = F.lit(True)
    for c in STORE_KEY:
        both = both & left[c].eqNullSafe(right[f"_{c}"])
    return both


def marked_keys(df: DataFrame) -> DataFrame:
    """The keys alone, under names that clash with none."""
    return df.select(*[F.col(c).alias(f"_{c}") for c in STORE_KEY])


def rows_of(spark: SparkSession, path: str, commits: tuple[Commit, ...], schema: T.StructType) -> DataFrame:
    if not commits:
        return spark.createDataFrame([], schema)
    folders = [f"{path}/data/_commit={c.id}" for c in commits]
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*folders).select(*schema.names)


def filters_of(path: str, commits: tuple[Commit, ...]) -> list[tuple[str, int]]:
    return [(f"{path}/filters/{c.id}", c.filter_bits) for c in commits]


def split_by_filters(keys: DataFrame, path: str, commits: tuple[Commit, ...]) -> tuple[DataFrame, DataFrame]:
    """``keys`` that are certainly in none of ``commits``, and those that may be."""
    tested = keys.withColumn("_may", may_contain(key_hash(), filters_of(path, commits)))
    return tested.where(~F.col("_may")).drop("_may"), tested.where("_may").drop("_may")


def missing_keys(keys: DataFrame, path: str, commits: tuple[Commit, ...], schema: T.StructType) -> DataFrame:
    """Distinct ``keys`` that have no row in ``commits``. Only those that pass a filter meet the store."""
    new, maybe = split_by_filters(keys, path, commits)
    known = marked_keys(rows_of(keys.sparkSession, path, commits, schema))
    return new.unionByName(maybe.join(known, same_key(maybe, known), "left_anti")).distinct()


def of_keys(df: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Rows of ``df`` with one of the distinct ``keys``, which are written, measured, and broadcast if they are few."""
    text = F.to_json(F.struct(*STORE_KEY), {"ignoreNullFields": "false"})
    listed = materialize(keys.select(text.alias("_store_key")), name)
    keyed = df.withColumn("_store_key", text)
    return bounded_join(keyed, listed, ["_store_key"], [F.col("stem")], F.octet_length("_store_key")).drop("_store_key")


def write_commit(rows: DataFrame, path: str, schema: T.StructType) -> Commit:
    """Write ``rows`` as files that no snapshot lists yet, one row per key."""
    spark, made = rows.sparkSession, uuid.uuid4().hex
    # few files per machine, and several tasks for a machine with most of the recordings
    spread = rows.select(*schema.names).hint("rebalance", "machine_type", "machine_id")
    spread.write.partitionBy("machine_type", "machine_id").parquet(f"{path}/data/_commit={made}")
    stored = rows_of(spark, path, (Commit(made, 0, 0),), schema)
    hashes = stored.select(key_hash().alias("key"))
    n = hashes.count()
    twice = stored.groupBy(*STORE_KEY).count().where("count > 1").limit(1).count()
    if twice:
        return write_commit(stored.dropDuplicates(STORE_KEY), path, schema)
    bits = bits_for(n)
    write_filter(hashes, f"{path}/filters/{made}", bits)
    return Commit(made, n, bits)


def extend_store(
    recordings: DataFrame, path: str, compute: Callable[[DataFrame], DataFrame], schema: T.StructType
) -> DataFrame:
    """Store what is missing of ``recordings``, and return the stored rows of all of them.

    ``compute`` takes the missing recordings and gives rows of ``schema``. The key ignores content and
    parameters, so a changed file under an old name is a hit.
    """
    spark = recordings.sparkSession
    keyed = with_store_key(recordings)
    seen = latest(spark, path)
    wanted = materialize(keyed.select(*STORE_KEY).distinct(), "wanted_keys")
    misses = materialize(missing_keys(wanted, path, seen.commits, schema), "missing_keys")
    if not misses.isEmpty():
        add(compute(of_keys(keyed, misses, "misses")), path, seen, schema)
    return read_store(spark, path, wanted, schema)


def add(rows: DataFrame, path: str, seen: Snapshot, schema: T.StructType) -> Snapshot:
    """Put ``rows``, none of whose keys ``seen`` has, into the store; keys that others add meanwhile stay theirs."""
    spark = rows.sparkSession
    written = write_commit(rows, path, schema)
    while written.rows:
        made = Snapshot(seen.version + 1, (*seen.commits, written))
        if commit(spark, path, made):
            return made
        newest = latest(spark, path)
        others = tuple(c for c in newest.commits if c not in seen.commits)
        own = rows_of(spark, path, (written,), schema)
        left = missing_keys(own.select(*STORE_KEY), path, others, schema)
        written, seen = write_commit(of_keys(own, left, "rows_left"), path, schema), newest
    return seen


def read_store(spark: SparkSession, path: str, wanted: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows of the newest snapshot for ``wanted`` keys; others are filtered out before anything is shuffled."""
    stored = rows_of(spark, path, latest(spark, path).commits, schema)
    n = wanted.count()
    folder, bits = fresh_path(spark, "wanted_filter"), bits_for(n)
    write_filter(wanted.select(key_hash().alias("key")), folder, bits)
    likely = stored.where(may_contain(key_hash(), [(folder, bits)]))
    keys = marked_keys(wanted)
    return likely.join(keys, same_key(likely, keys), "left_semi")


def compact(spark: SparkSession, path: str, schema: T.StructType) -> Snapshot:
    """Rewrite all commits of the newest snapshot as one; commits that others add meanwhile stay beside it."""
    seen = latest(spark, path)
    if len(seen.commits) < 2:
        return seen
    written = write_commit(rows_of(spark, path, seen.commits, schema), path, schema)
    while True:
        newest = latest(spark, path)
        if any(c not in newest.commits for c in seen.commits):
            return newest  # another run has compacted them
        made = Snapshot(newest.version + 1, (written, *[c for c in newest.commits if c not in seen.commits]))
        if commit(spark, path, made):
            return made
