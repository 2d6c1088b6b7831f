"""The corpus pipeline: documents to packed training sequences in five stages.

Every stage takes (spark, docs, sf_dir), is written as Parquet and read again for the next one,
so a lost executor costs at most the tasks it ran. All but the last return the columns of
``documents``:

1. language: documents whose language is rejected go;
2. exact copies: of equal texts the document with the largest id stays;
3. near copies: of documents linked by a similarity of 0.8 or more the one with the smallest id stays;
4. personal data: spans are replaced by their kind in brackets, ``n_chars`` is counted anew;
5. packing: pieces of token ids in sequences, with a checksum of the ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from steadyhum.functions.scale import materialize
from steadyhum.llm import exactdup, language, neardup, packing, pii

NEAR_PERCENT = 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exactdup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one_of_each(docs, NEAR_PERCENT)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(docs)


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

# Compression, MinHash and byte-pair encoding have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
