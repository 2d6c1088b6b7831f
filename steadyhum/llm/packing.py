"""Packing documents into sequences of a fixed number of tokens by Karmarkar-Karp differencing.

Documents are encoded and closed with the end id. Whole sequences are cut off a long document;
what is left is cut into pieces of at most ``piece_tokens``, and batches of such pieces are
partitioned into near-equal windows (see ``differencing``), whose count rises whenever a window
would exceed the capacity. Batches lie within a task, so nothing is shuffled and memory is
bounded by a batch; each batch pads by well under one percent.

A sequence is padded to the capacity unless its length is a power of two.

Defined results: a null text counts as empty and gives one piece, the end id; null ids and
repeated rows are packed like any other row; an empty table gives no rows. Sequence ids are
unique, not consecutive; they follow the order of the rows within the input's partitions, so
give it a table that lies in files (as the query and the pipeline do).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import releasing, texts
from .differencing import pack
from .encoding import default_path, encoder

SEQUENCE_TOKENS = 2048
PIECE_TOKENS = 512
BATCH_PIECES = 2048
BATCH_TOKENS = 8 << 20
END_ID = 1
SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
    "sequence_tokens long"
)
ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("sequence_tokens", pa.int64()),
    ]
)
ROWS_AT_ONCE = 4096


class Packer:
    """Collects the documents of a task and gives out packed pieces."""

    def __init__(self, capacity: int, piece_tokens: int, first_sequence: int):
        self.capacity, self.piece_tokens, self.sequence = capacity, piece_tokens, first_sequence
        self.ready: list[tuple] = []
        self.waiting: list[tuple] = []  # doc_id, start, ids, doc_tokens
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        n, size = len(ids), self.capacity
        whole = n - n % size
        for start in range(0, whole, size):
            self.ready.append((doc_id, start, size, ids[start : start + size].tobytes(), n, self.sequence, 0, size))
            self.sequence += 1
        for start in range(whole, n, self.piece_tokens):
            self.waiting.append((doc_id, start, ids[start : start + self.piece_tokens], n))
        self.tokens += n - whole

    def close_batch(self) -> None:
        sizes = np.array([len(w[2]) for w in self.waiting], np.int64)
        owner, loads = pack(sizes, self.capacity)
        filled = np.zeros(len(loads), np.int64)
        for i in np.argsort(owner, kind="stable").tolist():
            (doc_id, start, ids, n), w = self.waiting[i], int(owner[i])
            self.ready.append(
                (doc_id, start, len(ids), ids.tobytes(), n, self.sequence + w, int(filled[w]), int(loads[w]))
            )
            filled[w] += len(ids)
        self.sequence += len(loads)
        self.waiting, self.tokens = [], 0

    def batches(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        while len(self.ready) >= ROWS_AT_ONCE or (last and self.ready):
            rows, self.ready = self.ready[:ROWS_AT_ONCE], self.ready[ROWS_AT_ONCE:]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW
            )


def pack_documents(
    docs: DataFrame,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    capacity: int = SEQUENCE_TOKENS,
    piece_tokens: int = PIECE_TOKENS,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids, doc_tokens, sequence_id, offset, sequence_tokens.

    ``ids`` are little-endian unsigned 32-bit integers; ``start`` counts a document's ids before
    the piece, ``offset`` the sequence's. ``tokenizer`` is a tokenizer file that every worker can open.
    """
    path = tokenizer or default_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).encode, np.array([end_id], "<u4")
        packer = Packer(capacity, piece_tokens, TaskContext.get().partitionId() << 40)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, np.concatenate([encode(text.as_py()), end]))
                if len(packer.waiting) >= BATCH_PIECES or packer.tokens >= BATCH_TOKENS:
                    packer.close_batch()
                yield from packer.batches()
        if packer.waiting:
            packer.close_batch()
        yield from packer.batches(last=True)

    return texts(docs).mapInArrow(releasing(run), SCHEMA)


def packed_pieces(docs: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids, and the padded length of their sequence."""
    power = F.pow(F.lit(2.0), F.round(F.log2("sequence_tokens"))).cast("long")
    padded = F.when(F.col("sequence_tokens") == power, power).otherwise(F.lit(SEQUENCE_TOKENS))
    return pack_documents(docs).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
        "sequence_tokens",
        padded.cast("long").alias("padded_tokens"),
    )
