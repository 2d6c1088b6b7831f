"""Ranking that never puts one whole group into one task.

``Window.partitionBy(machine)`` sorts every recording of a machine in a single task. Here
a group is cut into order-preserving buckets: rows are ranked inside (group, bucket) and
the bucket's offset comes from a prefix sum over the small table of bucket counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scale import materialize

HASH_MODULUS = 2147483647
BUCKET_ROWS = 1 << 20
BOUNDS_HELD = 256
THINNED_ROWS = 1000  # up to here Spark limits groups before the shuffle, and one task holds salts times as many rows


def seeded_hash(key: Column, seed: int) -> Column:
    """Draw in [0, HASH_MODULUS) from an id and a seed; another seed gives an unrelated order.

    The first 15 hex digits of the MD5 of ``id:seed``, which any SQL dialect can compute.
    """
    text = F.concat(key.cast("bigint").cast("string"), F.lit(f":{seed}"))
    drawn = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    return F.pmod(drawn, F.lit(HASH_MODULUS))


def default_buckets(df: DataFrame, rows: int = 0) -> int:
    """As many as shuffle partitions, at least 16, and at least one for every ``BUCKET_ROWS`` rows."""
    return max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // BUCKET_ROWS)


def hash_bucket(h: Column, buckets: int) -> Column:
    """Order-preserving bucket of a uniform hash value."""
    return F.floor(h * F.lit(buckets) / F.lit(HASH_MODULUS)).cast("int")


def quantile_bucket(df: DataFrame, column: str, buckets: int | None = None) -> Column:
    """Order-preserving, evenly filled bucket of a numeric column.

    Only the bucket bounds come to the driver, never more than ``buckets`` numbers.
    """
    n = buckets or default_buckets(df)
    marks = df.approxQuantile(column, [i / n for i in range(1, n)], 0.25 / n)
    bounds = sorted(set(marks))
    if not bounds:
        return F.lit(0)
    value = F.col(column).cast("double")

    def search(low: int, high: int) -> Column:
        """How many bounds are at most the value, known to lie in [low, high]: a binary search."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(float(bounds[middle])), search(low, middle)).otherwise(search(middle + 1, high))

    return F.when(value.isNull(), 0).otherwise(search(0, len(bounds)))


def value_buckets(df: DataFrame, column: str) -> DataFrame:
    """``df``, which should be written, with the order-preserving ``_bucket`` of a numeric column.

    Up to ``BOUNDS_HELD`` buckets their bounds are an expression; more of them are ranges that Spark writes.
    """
    n = default_buckets(df, df.count())
    if n <= BOUNDS_HELD:
        return df.withColumn("_bucket", quantile_bucket(df, column, n))
    return in_ordered_buckets(df, [F.col(column)], n)


def in_ordered_buckets(df: DataFrame, order: list[Column], buckets: int | None = None) -> DataFrame:
    """``df`` written in ranges of any sortable columns, with the range as ``_bucket``.

    Rows of equal order share a bucket. The table is written because sampled bounds differ
    from one evaluation to the next.
    """
    n = buckets or default_buckets(df)
    return materialize(df.repartitionByRange(n, *order).withColumn("_bucket", F.spark_partition_id()), "ordered")


def bucket_offsets(
    df: DataFrame,
    keys: list[str],
    amounts: dict[str, Column],
    bucket: str = "_bucket",
) -> DataFrame:
    """Per (keys, bucket): each amount summed over earlier buckets and over the whole group."""
    sums = df.groupBy(*keys, bucket).agg(*[a.alias(f"_n_{k}") for k, a in amounts.items()])
    group = W.partitionBy(*keys)
    before = group.orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    picked = []
    for k in amounts:
        picked.append(F.coalesce(F.sum(f"_n_{k}").over(before), F.lit(0)).alias(f"{k}_before"))
        picked.append(F.sum(f"_n_{k}").over(group).alias(f"{k}_total"))
    return sums.select(*keys, bucket, *picked)


def number_rows(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    bucket: Column,
    position: str = "position",
    total: str | None = None,
) -> DataFrame:
    """1-based row number inside ``keys`` by ``order``; ``bucket`` must not decrease along it."""
    marked = df.withColumn("_bucket", bucket)
    offsets = bucket_offsets(marked, keys, {"rows": F.count(F.lit(1))})
    local = W.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = marked.withColumn("_local", F.row_number().over(local))
    out = ranked.join(offsets, [*keys, "_bucket"]).withColumn(
        position, F.col("rows_before") + F.col("_local")
    )
    if total:
        out = out.withColumn(total, F.col("rows_total"))
    return out.drop("_bucket", "_local", "rows_before", "rows_total")


def first_n(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    n: int,
    salt_by: list[Column],
    position: str = "position",
    salts: int = 16,
) -> DataFrame:
    """First ``n`` rows per group.

    A small ``n`` is thinned inside salted sub-groups before the group meets; for a large one
    rows are numbered in ordered buckets, so that no task ever holds ``n`` rows of a group.
    """
    if n > THINNED_ROWS:
        ranges = in_ordered_buckets(df, order)
        return number_rows(ranges, keys, order, F.col("_bucket"), position).where(F.col(position) <= n)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)))
    thin = W.partitionBy(*keys, "_salt").orderBy(*order)
    thinned = salted.withColumn("_r", F.row_number().over(thin)).where(F.col("_r") <= n)
    final = W.partitionBy(*keys).orderBy(*order)
    return (
        thinned.withColumn(position, F.row_number().over(final))
        .where(F.col(position) <= n)
        .drop("_salt", "_r")
    )
