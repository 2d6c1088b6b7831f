"""Helpers that keep joins and intermediate tables safe at cluster scale."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 64 << 20
DEFAULT_SALTS = 32


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir`` or ``setCheckpointDir``, seen by every executor."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    return named


def scratch_dir(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables."""
    return f"{shared_dir(spark).rstrip('/')}/steadyhum/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex}/{name}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder through the file system that Spark itself uses for it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application.

    Results are lazy, so this belongs after the last of them has been written or read.
    """
    delete_path(spark, scratch_dir(spark))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, survives the loss of executors, and gives the planner true file sizes.
    :func:`clear` deletes it.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def salted_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    salt_by: list[Column],
    how: str = "inner",
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """Equi-join that spreads one hot key of ``big`` over ``salts`` tasks.

    ``small`` holds few rows per key; each is repeated once per salt.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def bounded_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    salt_by: list[Column],
    row_bytes: Column,
    how: str = "inner",
    limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Broadcast ``small`` if its measured size fits ``limit``; otherwise join with salts.

    ``small`` should be materialized: it is measured here and read again by the join.
    """
    measured = small.agg(F.sum(row_bytes.cast("bigint"))).first()[0] or 0
    if measured <= limit:
        return big.join(F.broadcast(small), on, how)
    return salted_join(big, small, on, salt_by, how)
