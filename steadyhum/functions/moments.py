"""Element-wise statistics of vectors per key, combined in three bounded steps.

Every task folds its Arrow batches into one partial (count, mean, squared deviations, min,
max) per key; partials meet per share of the tasks and then per key. A key with any number of
rows therefore sends one small row per task, or, where a task meets more than ``KEYS_HELD``
keys, one whenever the task has collected that many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TASKS_PER_MERGE = 1024  # partials that meet in the first merge; a million tasks leave as many for the second
KEYS_HELD = 2000  # partials a task holds before it passes them on

_ARRAYS = ("mean", "m2", "lo", "hi")


def _merge(a: list, b: list) -> list:
    """Exact combination of two partials [n, mean, m2, lo, hi]."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    mean = a[1] + gap * (b[0] / n)
    m2 = a[2] + b[2] + gap * gap * (a[0] * b[0] / n)
    return [n, mean, m2, np.minimum(a[3], b[3]), np.maximum(a[4], b[4])]


def _partial(x: np.ndarray) -> list:
    mean = x.mean(axis=0)
    return [len(x), mean, ((x - mean) ** 2).sum(axis=0), x.min(axis=0), x.max(axis=0)]


def _matrix(column: pa.Array, key: object) -> np.ndarray:
    lengths = np.diff(column.offsets.to_numpy())
    if len(set(lengths)) > 1:
        raise ValueError(f"vectors of different length under key {key}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def partial_moments(vectors: DataFrame, keys: list[str], vector: str) -> DataFrame:
    key_fields = [vectors.schema[k] for k in keys]
    schema = T.StructType(
        [*key_fields, T.StructField("n", T.LongType())]
        + [T.StructField(a, T.ArrayType(T.DoubleType())) for a in _ARRAYS]
    )

    def emit(held: dict) -> pa.RecordBatch:
        names = list(zip(*held)) if held else [()] * len(keys)
        parts = list(held.values())
        columns = [pa.array(list(c)) for c in names]
        columns.append(pa.array([p[0] for p in parts], pa.int64()))
        columns += [pa.array([p[i] for p in parts], pa.list_(pa.float64())) for i in range(1, 5)]
        return pa.RecordBatch.from_arrays(columns, names=[*keys, "n", *_ARRAYS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            frame = batch.select(keys).to_pandas()
            column = batch.column(vector)
            for key, rows in frame.groupby(keys, sort=False, dropna=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                part = _partial(_matrix(column.take(pa.array(rows)), key))
                held[key] = _merge(held[key], part) if key in held else part
            if len(held) > KEYS_HELD:
                yield emit(held)
                held = {}
        if held:
            yield emit(held)

    return vectors.select(*keys, vector).mapInArrow(run, schema)


def merged_moments(partials: DataFrame, by: list[str]) -> DataFrame:
    kept = [c for c in partials.columns if c in by or c in ("n", *_ARRAYS)]
    schema = T.StructType([partials.schema[c] for c in kept])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = zip(pdf["n"], *[pdf[a] for a in _ARRAYS])
        total = None
        for n, *arrays in rows:
            part = [n, *[np.asarray(a) for a in arrays]]
            total = part if total is None else _merge(total, part)
        head = {c: [pdf[c].iloc[0]] for c in by}
        return pd.DataFrame({**head, "n": [total[0]], **{a: [v] for a, v in zip(_ARRAYS, total[1:])}})[kept]

    return partials.groupBy(*by).applyInPandas(run, schema)


def element_moments(vectors: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """(keys, n, mean, m2, lo, hi)."""
    share = F.floor(F.spark_partition_id() / TASKS_PER_MERGE).cast("int")
    partials = partial_moments(vectors, keys, vector).withColumn("_share", share)
    halfway = merged_moments(partials, [*keys, "_share"])
    return merged_moments(halfway.drop("_share"), keys)
