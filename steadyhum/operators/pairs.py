"""Contrastive pairs as equi-joins on integer positions, never as pair enumeration.

Every recording gets a position inside its machine and a position in the whole set in which
each machine is one contiguous block. A partner is then a computed position, and drawing it
is a join on a unique key: no cross join, no hot key, and the vectors stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranking import (
    bucket_offsets,
    default_buckets,
    hash_bucket,
    number_rows,
    seeded_hash,
)
from ..functions.scale import materialize
from .catalog import MACHINE

NEGATIVES_PER_ANCHOR = 3


def machine_blocks(sizes: DataFrame) -> DataFrame:
    """Add ``block_start`` and ``n_all`` to (machine, n_machine): blocks in md5 order of the key.

    Two-level prefix sum: 256 buckets by the first two hex digits, then inside a bucket.
    """
    order = F.md5(F.concat_ws("/", *MACHINE))
    marked = sizes.withColumn("_md5", order).withColumn("_bucket", F.substring("_md5", 1, 2))
    offsets = bucket_offsets(marked, [], {"n": F.sum("n_machine")})
    earlier = W.partitionBy("_bucket").orderBy("_md5").rowsBetween(W.unboundedPreceding, -1)
    local = marked.withColumn("_local", F.coalesce(F.sum("n_machine").over(earlier), F.lit(0)))
    return local.join(offsets, "_bucket").select(
        *MACHINE, "n_machine", (F.col("n_before") + F.col("_local")).alias("block_start"), F.col("n_total").alias("n_all")
    )


def indexed(recs: DataFrame, seed: int = 42, key: str = "rec_id") -> DataFrame:
    """(machine, key, pos, n_machine, block_start, n_all); positions follow a seeded hash."""
    buckets = default_buckets(recs)
    marked = recs.select(*MACHINE, key, seeded_hash(F.col(key), seed).alias("_h")).withColumn(
        "_bucket", hash_bucket(F.col("_h"), buckets)
    )
    offsets = bucket_offsets(marked, MACHINE, {"rows": F.count(F.lit(1))})
    sizes = recs.groupBy(*MACHINE).agg(F.count(F.lit(1)).alias("n_machine"))
    placed = offsets.join(machine_blocks(sizes), MACHINE)
    local = W.partitionBy(*MACHINE, "_bucket").orderBy("_h", key)
    ranked = marked.withColumn("_local", F.row_number().over(local) - 1)
    return ranked.join(placed, [*MACHINE, "_bucket"]).select(
        *MACHINE, key, (F.col("rows_before") + F.col("_local")).alias("pos"), "n_machine", "block_start", "n_all"
    )


def positive_pairs(index: DataFrame, seed: int = 42, key: str = "rec_id") -> DataFrame:
    """One other recording of the same machine per anchor; machines with one recording skip."""
    draw = F.pmod(seeded_hash(F.col(key), seed + 1), F.col("n_machine") - 1)
    anchors = index.where(F.col("n_machine") >= 2).select(
        *MACHINE,
        F.col(key).alias("anchor_id"),
        F.pmod(F.col("pos") + 1 + draw, F.col("n_machine")).alias("pos"),
    )
    partners = index.select(*MACHINE, "pos", F.col(key).alias("paired_id"))
    return anchors.join(partners, [*MACHINE, "pos"]).select(
        "anchor_id", "paired_id", F.lit(1).alias("label"), F.lit(0).alias("draw")
    )


def negative_pairs(
    index: DataFrame, seed: int = 42, per_anchor: int = NEGATIVES_PER_ANCHOR, key: str = "rec_id"
) -> DataFrame:
    """Up to ``per_anchor`` distinct recordings of other machines per anchor.

    The pool is everything outside the anchor's block; draws are evenly strided from a
    seeded start, so they are distinct.
    """
    pool = F.col("n_all") - F.col("n_machine")
    drawn = index.withColumn("_pool", pool).where(F.col("_pool") > 0).withColumn(
        "_k", F.least(F.lit(per_anchor), F.col("_pool")).cast("int")
    )
    strided = drawn.withColumn("draw", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    start = F.pmod(seeded_hash(F.col(key), seed + 2), F.col("_pool"))
    at = F.pmod(start + F.col("draw") * F.floor(F.col("_pool") / F.col("_k")), F.col("_pool"))
    anchors = strided.withColumn("_at", at).select(
        F.col(key).alias("anchor_id"),
        "draw",
        F.when(F.col("_at") < F.col("block_start"), F.col("_at"))
        .otherwise(F.col("_at") + F.col("n_machine"))
        .alias("_global"),
    )
    partners = index.select((F.col("block_start") + F.col("pos")).alias("_global"), F.col(key).alias("paired_id"))
    return anchors.join(partners, "_global").select("anchor_id", "paired_id", F.lit(0).alias("label"), "draw")


def build_pairs(normal: DataFrame, seed: int = 42, key: str = "rec_id") -> DataFrame:
    """All positive and negative pairs of the normal recordings, as keys."""
    index = materialize(indexed(normal, seed, key), "pair_index")
    return positive_pairs(index, seed, key).unionByName(negative_pairs(index, seed, key=key))


def pair_counts(pairs: DataFrame) -> DataFrame:
    pos, neg = F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)
    return pairs.agg(pos.alias("n_positive"), neg.alias("n_negative"), F.least(pos, neg).alias("n_per_class"))


def _hashed(pairs: DataFrame, seed: int) -> DataFrame:
    return pairs.withColumn("_h", seeded_hash(F.col("anchor_id"), seed))


def balance(pairs: DataFrame, seed: int = 42) -> DataFrame:
    """As many pairs of one class as of the other: first draws first, then by seeded hash.

    ``shuffle_key`` orders the mixed result.
    """
    buckets = default_buckets(pairs)
    hashed = _hashed(pairs, seed + 3)
    bucket = F.col("draw") * buckets + hash_bucket(F.col("_h"), buckets)
    ranked = number_rows(hashed, ["label"], [F.col("draw"), F.col("_h"), F.col("anchor_id")], bucket)
    n = pair_counts(pairs).select("n_per_class").scalar()
    mixed = seeded_hash(F.col("anchor_id") * 8 + F.col("draw") * 2 + F.col("label"), seed + 4)
    return ranked.where(F.col("position") <= n).select(
        "anchor_id", "paired_id", "label", "draw", mixed.alias("shuffle_key")
    )


def ordered(pairs: DataFrame, seed: int, keys: list[str] | None = None) -> DataFrame:
    """Add 1-based ``position`` in seeded order and ``n_pairs``."""
    buckets = default_buckets(pairs)
    hashed = _hashed(pairs, seed)
    bucket = hash_bucket(F.col("_h"), buckets)
    return number_rows(hashed, keys or [], [F.col("_h"), F.col("anchor_id")], bucket, total="n_pairs").drop("_h")


def split_validation(positives: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_validation``: at least one pair, otherwise ``share`` of all, in seeded order."""
    n_val = F.greatest(F.lit(1), F.floor(F.col("n_pairs") * share))
    ranked = ordered(positives, seed + 5)
    return ranked.withColumn("is_validation", F.col("position") <= n_val).drop("position", "n_pairs")


def split_violations(positives: DataFrame, share: float = 0.2, keys: list[str] | None = None) -> DataFrame:
    """Why a set of positive pairs, or the set of each of ``keys``, cannot be trained on; empty if it can."""
    n = F.col("n_positive")
    left = n - F.greatest(F.lit(1), F.floor(n * share))
    counted = positives.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("n_positive"))
    reason = F.when(n < 2, "fewer than two positive pairs").when(left < 2, "fewer than two training pairs")
    return counted.withColumn("violation", reason).where(F.col("violation").isNotNull())


def batches(pairs: DataFrame, batch_size: int, seed: int) -> DataFrame:
    """Add ``batch`` and ``batch_position`` in seeded order; a last batch of one is dropped."""
    ranked = ordered(pairs, seed)
    zero_based = F.col("position") - 1
    batch = F.floor(zero_based / batch_size)
    size = F.least(F.lit(batch_size), F.col("n_pairs") - batch * batch_size)
    return (
        ranked.withColumns({"batch": batch, "batch_position": F.pmod(zero_based, F.lit(batch_size)), "_size": size})
        .where(F.col("_size") >= 2)
        .drop("_size", "position", "n_pairs")
    )


def pair_summary(normal: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: numbers of machine types, machine ids and recordings, pairs by class, balanced pairs."""
    catalogued = normal.agg(
        F.count_distinct("machine_type").alias("n_machine_types"),
        F.count_distinct("machine_id").alias("n_machine_ids"),
        F.count(F.lit(1)).alias("n_recordings"),
    )
    counted = pair_counts(pairs).select("n_positive", "n_negative", (2 * F.col("n_per_class")).alias("n_balanced"))
    return catalogued.withColumns({c: counted.select(c).scalar() for c in counted.columns})


def batch_violations(
    paired: DataFrame, a: str = "a", b: str = "b", temperature: float | Column = 0.1
) -> DataFrame:
    """Batches the loss cannot take: under two pairs, unequal lengths, non-finite values,
    temperature not above zero."""

    def bad(c: str) -> Column:
        return F.exists(c, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))

    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    checked = paired.groupBy("batch").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.size(a) != F.size(b)).alias("shape"),
        F.bool_or(bad(a) | bad(b)).alias("values"),
        F.min(t).alias("t"),
    )
    reasons = F.array(
        F.when(F.col("n") < 2, "fewer than two pairs"),
        F.when(F.col("shape"), "lengths differ"),
        F.when(F.col("values"), "NaN or infinite values"),
        F.when(F.col("t") <= 0, "temperature not positive"),
    )
    return checked.select("batch", F.explode(F.array_compact(reasons)).alias("violation"))
