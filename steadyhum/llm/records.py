"""Token ids as length-delimited binary records, with a separate offset index.

A file begins with ``IDS1``, the bytes per id, and three zero bytes. A record is

    length    unsigned 64-bit, of the payload
    checksum  unsigned 32-bit, masked CRC-32 of the eight length bytes
    payload   one byte whether there is a document id, the id (64-bit, 0 if none), the token ids
    checksum  unsigned 32-bit, masked CRC-32 of the payload

all little-endian; masking rotates a CRC right by 15 bits and adds a constant, so that a CRC of
data that holds CRCs stays sound. Ids take two bytes where the vocabulary allows, else four.

The index has a row per record: file, offset, length, doc_id, n_tokens and the ids before it in
its file. Any selection of it, in any order, can be read: ranges are sorted and merged per task.

Tasks write files under names of their own that the index holds, so lost or repeated tasks do no harm.

Defined results: a null text counts as empty and has only the end id; null ids come first, equal
ids in the order of a hash of their text; an empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scale import fresh_path
from .common import texts
from .encoding import default_path, encoder
from .files import TaskFile, read_ranges

MAGIC = b"IDS1"
# Fixed value: the constant by which masked record checksums are commonly offset.
MASK_DELTA = 0xA282EAD8
END_ID = 2
INDEX = "file string, part int, offset long, length long, doc_id long, n_tokens long, before long"
INDEX_ARROW = pa.schema(
    [
        ("file", pa.string()),
        ("part", pa.int32()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("before", pa.int64()),
    ]
)
READ = "file string, part int, offset long, doc_id long, before long, ids binary"
READ_ARROW = pa.schema(
    [
        ("file", pa.string()),
        ("part", pa.int32()),
        ("offset", pa.int64()),
        ("doc_id", pa.int64()),
        ("before", pa.int64()),
        ("ids", pa.binary()),
    ]
)
IDS_AT_ONCE = 4 << 20


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return b"".join(
        (length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload)))
    )


def unframe(record: bytes) -> bytes:
    """Payload of one whole record; raises if a checksum or length is wrong."""
    length, crc = struct.unpack_from("<QI", record)
    payload = record[12 : 12 + length]
    if crc != masked_crc(record[:8]) or len(record) != length + 16:
        raise ValueError("broken record length")
    if struct.unpack_from("<I", record, 12 + length)[0] != masked_crc(payload):
        raise ValueError("broken record payload")
    return payload


def write_records(
    docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID
) -> DataFrame:
    """Write the ids of all documents, ascending by doc_id over the files; returns the index, itself in files."""
    path = tokenizer or default_path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc, out = TaskContext.get().partitionId(), encoder(path), None
        width = 2 if max(end_id, enc.library.get_vocab_size()) <= 0xFFFF else 4
        end, before, name = np.array([end_id], "<u4"), 0, f"part-{part:06d}"
        try:
            for batch in batches:
                if out is None and batch.num_rows:
                    out = TaskFile(folder, name, ".ids")
                    out.write(MAGIC + bytes([width, 0, 0, 0]))
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    ids = np.concatenate([enc.encode(text.as_py()), end])
                    head = struct.pack("<?q", doc_id is not None, doc_id or 0)
                    record = frame(head + ids.astype(f"<u{width}").tobytes())
                    rows.append((out.path, part, out.write(record), len(record), doc_id, len(ids), before))
                    before += len(ids)
                if rows:
                    columns = zip(zip(*rows, strict=True), INDEX_ARROW.types, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], schema=INDEX_ARROW)
        except BaseException:
            if out:
                out.abort()
            raise
        if out:
            out.close()

    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text").asc()]
    ordered = texts(docs).repartitionByRange(F.asc_nulls_first("doc_id")).sortWithinPartitions(*order)
    place = f"{folder}/index"
    ordered.mapInArrow(run, INDEX).write.mode("overwrite").parquet(place)
    return docs.sparkSession.read.schema(INDEX).parquet(place)


def read_records(index: DataFrame) -> DataFrame:
    """Records of the selected ``index`` rows: file, part, offset, doc_id, before, ids (unsigned 32-bit).

    Within an Arrow batch rows are read in file order, whatever order they come in; lengths,
    checksums and the ids' width are verified against the files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths: dict[str, int] = {}
        for batch in batches:
            rows = sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=lambda r: (r[0], r[2]))
            out, held, at = [], 0, 0
            while at < len(rows):
                file, upto = rows[at][0], at
                while upto < len(rows) and rows[upto][0] == file:
                    upto += 1
                if file not in widths:
                    (head,) = read_ranges(file, [(0, 8)])
                    if head[:4] != MAGIC:
                        raise ValueError(f"{file} is no file of ids")
                    widths[file] = head[4]
                records = read_ranges(file, [(r[2], r[3]) for r in rows[at:upto]])
                for (_, part, offset, _, _, _, before), record in zip(rows[at:upto], records, strict=True):
                    payload = unframe(record)
                    has, doc_id = struct.unpack_from("<?q", payload)
                    ids = np.frombuffer(payload, f"<u{widths[file]}", offset=9).astype("<u4")
                    out.append((file, part, offset, doc_id if has else None, before, ids.tobytes()))
                    held += len(ids)
                    if held >= IDS_AT_ONCE:
                        yield _batch(out)
                        out, held = [], 0
                at = upto
            if out:
                yield _batch(out)

    return index.select("file", "part", "offset", "length", "doc_id", "n_tokens", "before").mapInArrow(run, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(zip(*rows, strict=True), READ_ARROW.types, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], schema=READ_ARROW)


def file_starts(index: DataFrame) -> DataFrame:
    """Per file: part and the ids in all earlier files. One row per file."""
    totals = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("file_start"))


def round_trip(docs: DataFrame) -> DataFrame:
    """Write the ids of ``docs``, read them back, and give doc_id, start, n_tokens, ids_crc32 of each."""
    index = write_records(docs, fresh_path(docs.sparkSession, "token_records"))
    back = read_records(index).join(F.broadcast(file_starts(index)), "part")  # as many rows as files
    return back.select(
        "doc_id",
        (F.col("file_start") + F.col("before")).alias("start"),
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
