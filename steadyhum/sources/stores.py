"""Result tables as JSON and Parquet, schema contracts, and lookups in a store of features; ``feature_store`` has its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STORE_KEY = ["machine_type", "machine_id", "label", "stem"]


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def load_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def save_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("machine_type", "machine_id")) -> None:
    """Vectors and scalar metadata as Parquet, partitioned so one machine is one folder."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def load_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def round_trip_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows on one side only, tagged with the side; empty means the store is faithful."""
    lost = before.exceptAll(after).withColumn("side", F.lit("lost"))
    gained = after.exceptAll(before).withColumn("side", F.lit("gained"))
    return lost.unionByName(gained)


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"missing required fields: {missing}")
    return df


def contract_violations(
    df: DataFrame,
    json_column: str,
    required: dict[str, str],
    keep: list[str],
    same_length: tuple[str, str] | None = None,
) -> DataFrame:
    """Documents that break the contract: one row per document and missing field.

    ``required`` maps field name to Spark type. ``same_length`` names two array fields
    (such as names and vector) that must agree in length.
    """
    schema = ", ".join(f"`{n}` {t}" for n, t in required.items())
    doc = F.from_json(F.col(json_column), schema)
    checks: list[Column] = [
        F.when(doc[n].isNull(), F.concat(F.lit("missing "), F.lit(n))) for n in required
    ]
    if same_length:
        a, b = same_length
        checks.append(
            F.when(F.size(doc[a]) != F.size(doc[b]), F.lit(f"length of {a} differs from {b}"))
        )
    found = df.select(*keep, F.explode(F.array_compact(F.array(*checks))).alias("violation"))
    return found


def stem(filename: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(filename, r"(?<=.)\.[^.]+$", "")


def with_store_key(df: DataFrame) -> DataFrame:
    return df.withColumn("stem", stem(F.col("filename")))


def store_misses(recordings: DataFrame, store: DataFrame) -> DataFrame:
    """Recordings whose key is not in the store yet."""
    return with_store_key(recordings).join(store.select(*STORE_KEY), STORE_KEY, "left_anti")


def load_or_create(recordings: DataFrame, store: DataFrame, compute) -> DataFrame:
    """Stored rows for known recordings, ``compute(misses)`` for the rest.

    ``compute`` takes and returns a DataFrame and yields the store's columns. The key
    ignores content and parameters, so a changed file under an old name is a hit.
    """
    wanted = with_store_key(recordings).select(*STORE_KEY)
    hits = store.join(wanted, STORE_KEY, "left_semi")
    fresh = compute(store_misses(recordings, store)).select(*store.columns)
    return hits.unionByName(fresh)


def store_coverage(recordings: DataFrame, store: DataFrame) -> DataFrame:
    """One row: hits, misses, total."""
    known = store.select(*STORE_KEY).distinct().withColumn("_hit", F.lit(True))
    seen = with_store_key(recordings).join(known, STORE_KEY, "left")
    return seen.agg(
        F.count_if(F.col("_hit").isNotNull()).alias("hits"),
        F.count_if(F.col("_hit").isNull()).alias("misses"),
        F.count(F.lit(1)).alias("total"),
    )
