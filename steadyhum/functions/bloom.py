"""Bloom filters of 64-bit keys, built and tested by tasks, kept as small Parquet tables.

A filter says of a key that it is certainly not there, or that it may be. It is written in segments, which
are built where their marks meet, so no task and no driver needs the whole of it to build it. Testing
loads filters once per Python worker, up to a total of ``MOST_BITS``; beyond that every key may be there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import file_system

BITS_PER_KEY = 16
PROBES = 4
SEGMENT_BITS = 1 << 19
MOST_BITS = 1 << 30  # 128 MB per worker
MIX = np.uint64(0xD6E8FEB86659FD93)

MARKS = "segment int, marks binary"
MARKS_ARROW = pa.schema([("segment", pa.int32()), ("marks", pa.binary())])


def bits_for(n: int) -> int:
    """A power of two with some ``BITS_PER_KEY`` bits per key."""
    return 1 << max(10, min(MOST_BITS.bit_length() - 1, (BITS_PER_KEY * n).bit_length()))


def probes(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The places of keys among ``bits``, an array per probe."""
    keys = keys.view(np.uint64)
    step = (keys ^ (keys >> np.uint64(32))) * MIX
    step = (step ^ (step >> np.uint64(29))) | np.uint64(1)
    for k in range(PROBES):
        yield (keys + np.uint64(k) * step) & np.uint64(bits - 1)


def write_filter(keys: DataFrame, folder: str, bits: int) -> None:
    """Write the filter of the single long column of ``keys`` to ``folder``."""
    size = min(bits, SEGMENT_BITS)

    def rows(segments: list[int], marks: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(segments, pa.int32()), pa.array(marks, pa.binary())], schema=MARKS_ARROW)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = np.unique(np.concatenate(list(probes(batch.column(0).to_numpy(zero_copy_only=False), bits))))
            segment = (spots // np.uint64(size)).astype(np.int64)
            inner = (spots % np.uint64(size)).astype(np.uint32)
            edges = [*np.flatnonzero(np.diff(segment, prepend=-1)).tolist(), len(segment)]
            own = [(int(segment[a]), inner[a:b].tobytes()) for a, b in zip(edges, edges[1:], strict=False)]
            yield rows([s for s, _ in own], [m for _, m in own])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, marks = None, np.zeros(size, np.uint8)
        for batch in batches:
            for s, spots in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != segment:
                    if segment is not None:
                        yield rows([segment], [np.packbits(marks, bitorder="little").tobytes()])
                    segment, marks = s, np.zeros(size, np.uint8)
                marks[np.frombuffer(spots, np.uint32)] = 1
        if segment is not None:
            yield rows([segment], [np.packbits(marks, bitorder="little").tobytes()])

    spots = keys.where(F.col(keys.columns[0]).isNotNull()).mapInArrow(mark, MARKS)
    spots.repartition("segment").sortWithinPartitions("segment").mapInArrow(gather, MARKS).write.parquet(folder)


class Filter:
    """A filter in memory."""

    def __init__(self, folder: str, bits: int):
        self.bits, self.marks = bits, np.zeros(bits // 8, np.uint8)
        system, inner = file_system(folder)
        for info in system.get_file_info(pafs.FileSelector(inner)):
            if info.path.endswith(".parquet"):
                table = pq.read_table(info.path, filesystem=system, use_threads=False)
                for segment, marks in zip(table["segment"].to_pylist(), table["marks"].to_pylist(), strict=True):
                    at = segment * min(bits, SEGMENT_BITS) // 8
                    self.marks[at : at + len(marks)] = np.frombuffer(marks, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for spots in probes(keys, self.bits):
            out &= (self.marks[spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


_HELD: dict[tuple[str, int], Filter] = {}


def _held(filters: tuple[tuple[str, int], ...]) -> list[Filter]:
    """The worker's copies of exactly these filters."""
    for gone in set(_HELD) - set(filters):
        del _HELD[gone]
    for one in filters:
        if one not in _HELD:
            _HELD[one] = Filter(*one)
    return [_HELD[f] for f in filters]


def may_contain(key: Column, filters: list[tuple[str, int]]) -> Column:
    """Whether a long key may be in one of ``filters`` (folder, bits)."""
    if not filters:
        return F.lit(False)
    if sum(bits for _, bits in filters) > MOST_BITS:
        return F.lit(True)
    wanted = tuple(filters)

    @F.arrow_udf("boolean")
    def run(column: pa.Array) -> pa.Array:
        keys = column.to_numpy(zero_copy_only=False)
        out = np.zeros(len(keys), bool)
        for one in _held(wanted):
            out |= one.has(keys)
        return pa.array(out)

    return run(key)
