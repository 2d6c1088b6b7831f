"""Exact deduplication with an extendible-hash index kept in shared files.

Texts are hashed to 64 bits, and the index is built from counts per hash:

* the directory starts with one bucket for all hashes and doubles, one leading bit at a time; a
  bucket that holds more distinct hashes than ``capacity`` is split, the others keep their depth. It
  grows with the data: the depth has no bound but the 64 bits;
* the directory routes entries to buckets, contiguous ranges of hashes, and every bucket is owned by one
  task. A hash that occurs once is an entry as it is. Of a hash that occurs more often, the texts come to the
  owner, where equal hashes form a chain: the owner compares their bytes, and derives from what it
  finds equal which id stays and how many rows share it;
* entries lie in the shared files sorted by bucket, hash and place in the chain.

Only texts whose hash is repeated are shuffled. Copies are combined in each map task first, and what is left
of a text is at most ``SHARES`` rows per task, summed to ``SHARES`` rows before the owner: a text that a
third of all rows share is no burden. Documents look their entry up by bucket, hash and digest.
Everything is DataFrame expressions.

Defined results: a null text counts as empty; a null doc_id is smaller than any other; rows
that repeat both the doc_id and the text that stay are all kept; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scale import BROADCAST_LIMIT_BYTES, bounded_join, materialize
from .common import texts, unused

CAPACITY = 65536
SHARES = 8
HASH_BITS = 64
SPARE_BITS = 4  # by which slots are finer than evenly filled buckets


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def prefix_of(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a 64-bit hash."""
    return F.shiftrightunsigned(key, HASH_BITS - depth) if depth else F.lit(0).cast("long")


@dataclass(frozen=True)
class Index:
    """``entries``: bucket, hash, chain, sha256, n_bytes, keep_id, group_size; ``directory``: bucket, depth, prefix, n_entries."""

    entries: DataFrame
    directory: DataFrame


def signed(prefix: int, depth: int) -> int:
    """A prefix as the long that :func:`prefix_of` gives."""
    return prefix - (1 << HASH_BITS) if depth == HASH_BITS and prefix >> (HASH_BITS - 1) else prefix


def grow_directory(hashes: DataFrame, capacity: int) -> DataFrame:
    """Directory over the distinct ``hash`` values of a written table, doubled until no bucket holds more than ``capacity``.

    A doubling counts hashes per slot, of which there are some sixteen per bucket, and the driver sees the
    counts of the buckets that were too full. Slots are made finer where they are not fine enough.
    """
    spark, n = hashes.sparkSession, hashes.count()
    fine = min(HASH_BITS, max(0, (max(0, n - 1) // capacity).bit_length()) + SPARE_BITS)
    slots = materialize(hashes.groupBy(prefix_of(F.col("hash"), fine).alias("slot")).agg(F.count(F.lit(1)).alias("n")), "slots")
    settled, full, depth = [], {0} if n > capacity else set(), 0
    if not full:
        settled.append((0, 0, n))
    while full:
        depth += 1
        if depth > fine:
            parents = spark.createDataFrame([(signed(p, fine),) for p in sorted(full)], "parent long")
            open_hashes = hashes.join(F.broadcast(parents), prefix_of(F.col("hash"), fine) == F.col("parent"), "left_semi")
            fine = min(HASH_BITS, fine + SPARE_BITS)
            slots = open_hashes.groupBy(prefix_of(F.col("hash"), fine).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
            slots = materialize(slots, "finer_slots")
        prefix = F.shiftrightunsigned("slot", fine - depth) if depth < fine else F.col("slot")
        counts = {r.prefix % (1 << HASH_BITS): r.n for r in slots.groupBy(prefix.alias("prefix")).agg(F.sum("n").alias("n")).collect()}
        children = [(2 * p + side, counts.get(2 * p + side, 0)) for p in sorted(full) for side in (0, 1)]
        settled += [(depth, signed(p, depth), k) for p, k in children if k <= capacity]
        full = {p for p, k in children if k > capacity}
    rows = [(i, d, p, k) for i, (d, p, k) in enumerate(sorted(settled))]
    return spark.createDataFrame(rows, "bucket int, depth int, prefix long, n_entries long")


def routed(rows: DataFrame, directory: DataFrame) -> DataFrame:
    """``rows`` (with ``hash``) and the ``bucket`` that the directory sends them to."""
    depths = sorted(r.depth for r in directory.select("depth").distinct().collect())
    places = F.array(*[F.struct(F.lit(d).alias("depth"), prefix_of(F.col("hash"), d).alias("prefix")) for d in depths])
    at_depths = rows.select("*", F.inline(places))
    found = bounded_join(at_depths, directory.drop("n_entries"), ["depth", "prefix"], [F.col("hash")], F.lit(16))
    return found.drop("depth", "prefix")


def build_index(docs: DataFrame, capacity: int = CAPACITY, shares: int = SHARES) -> Index:
    """Index of the distinct texts of ``docs`` (doc_id, text)."""
    keyed = texts(docs).withColumn("hash", text_hash(F.col("text")))
    hashes = keyed.select("hash", "doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("n_bytes"))
    hashes = hashes.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("doc_id").alias("keep_id"),
        F.max("sha256").alias("sha256"),
        F.max("n_bytes").alias("n_bytes"),
    )
    hashes = materialize(hashes, "hashes")
    directory = grow_directory(hashes, capacity)
    once = hashes.where("n = 1").select("hash", "sha256", "n_bytes", "keep_id", F.lit(1).cast("long").alias("group_size"))
    again = hashes.where("n > 1").select("hash")
    share = F.pmod(F.xxhash64("doc_id"), F.lit(shares)).alias("share")
    # Two steps, so that an owner gets ``shares`` rows of a text, however many tasks read it.
    copies = (
        bounded_join(keyed, again, ["hash"], [F.col("doc_id")], F.lit(8))
        .groupBy("hash", "text", share)
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    )
    owned = routed(copies, directory).repartition("bucket")
    compared = owned.groupBy("bucket", "hash", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    compared = compared.select(
        "bucket", "hash", F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("n_bytes"), "keep_id", "group_size"
    )
    every = routed(once, directory).unionByName(materialize(compared, "compared_texts"))
    chain = W.partitionBy("bucket", "hash").orderBy("sha256", "n_bytes")
    entries = (
        every.repartition("bucket")
        .withColumn("chain", F.row_number().over(chain) - 1)
        .sortWithinPartitions("bucket", "hash", "chain")
        .select("bucket", "hash", "chain", "sha256", "n_bytes", "keep_id", "group_size")
    )
    return Index(materialize(entries, "hash_index"), directory)


def look_up(docs: DataFrame, index: Index) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, bucket, chain."""
    keys = texts(docs).select("doc_id", text_hash(F.col("text")).alias("hash"), F.sha2("text", 256).alias("sha256"))
    return routed(keys, index.directory).join(index.entries, ["bucket", "hash", "sha256"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha256").alias("text_sha256"),
        "bucket",
        "chain",
    )


def exact_groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    return look_up(docs, build_index(docs, capacity))


def drop_exact_copies(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``docs`` with all its columns, of equal texts only the row with the largest doc_id.

    Only entries of several rows can send a row away. They are broadcast if their checked size allows, and then no
    text moves; else rows meet them in a hash join.
    """
    entries = build_index(docs, capacity).entries.where("group_size > 1")
    h, s, k = (unused(docs, n) for n in ("hash", "sha256", "keep_id"))
    shared = entries.select(F.col("hash").alias(f"{h}_"), F.col("sha256").alias(f"{s}_"), F.col("keep_id").alias(f"{k}_"))
    if entries.count() * 100 <= BROADCAST_LIMIT_BYTES:
        shared = F.broadcast(shared)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({h: text_hash(text), s: F.sha2(text, 256), k: F.col("doc_id").cast("long")})
    sent_away = (F.col(h) == F.col(f"{h}_")) & (F.col(s) == F.col(f"{s}_")) & ~F.col(k).eqNullSafe(F.col(f"{k}_"))
    return keyed.join(shared, sent_away, "left_anti").drop(h, s, k)
