"""Small helpers shared by the text operators."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text`` of ``docs``; a null text becomes the empty text.

    Dropping every other column here keeps scans narrow and keeps clashing names out.
    """
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def releasing(run: Callable) -> Callable:
    """``run`` over a task's batches, which gives back what Arrow's pool keeps at its end: workers stay, idle, for later stages."""

    @functools.wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return whole


def text_slices(
    batches: Iterable[pa.RecordBatch], columns: list[int], most: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """``batches`` cut so that the texts in ``columns`` have some ``most`` bytes together, or are one row."""
    for batch in batches:
        ends = sum(np.cumsum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy()) for c in columns)
        at = 0
        while at < batch.num_rows:
            base = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def is_same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
