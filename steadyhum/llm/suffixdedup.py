"""Removal of passages that start earlier elsewhere, by blockwise suffix sorting with a difference cover.

A byte goes if it lies in a string of ``length`` bytes (100) that also starts earlier: in a document
with a smaller id, or further left in the same one. Strings never cross documents and are judged
on the input.

Suffixes of a whole corpus are far too many to sort at once. A difference cover of period v (8 of 57
offsets) has, for any two suffixes, an offset below v at which both have a cover sample, so two
equal strings of 100 bytes hold equal sample strings of 44. That bounds the work in three steps,
each of which sorts suffix buckets one at a time:

1. Cover samples are sorted by their first 44 bytes. Only suffixes near a sample that occurs twice
   can repeat; the rest, most of a corpus, is settled.
2. Ranks of the samples in repeats, by the 156 bytes around each, settle long ties: a string inside
   a context that has an earlier equal is known to start earlier and is never sorted itself.
3. The suffixes that are left, the first of their kind and those at the ends of repeats, are sorted
   by their first 100 bytes; in each run of equals all but the first start earlier.

Buckets are ranges of fingerprints of these heads, not of the heads, so that common beginnings do not
crowd one bucket; removal needs to know which suffixes are equal, not their alphabetical order. A
map task sends each distinct fingerprint of a block of documents once, so a passage that
occurs in a third of all documents is one entry per block. The number of buckets grows with the
data. Steps 2 and 3 and the comparison of whole texts tell strings apart by 96 bits; the chance that
any two of n distinct ones meet is about n * n / 2^97. Step 1 uses fewer bits, since an
accidental match there only keeps a suffix in play.

Texts are written once, compressed, as blocks in the shared folder, and read by range in every step;
only fingerprints and the answers, a bit each, are shuffled. Files carry names of their own per
attempt of a task, and every step ends in a written table, so lost executors cost single tasks.

Defined results: a null text counts as empty; texts shorter than ``length`` lose nothing; null ids
count as the smallest id, and rows with equal ids follow one another in the order in which they
were written to blocks; the later copies of a text lose all of it; an empty table gives no
rows. Whole texts are used. A document is held by one task, at some 60 bytes a byte.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scale import fresh_path, materialize
from .common import texts
from .files import TaskFile, read_ranges

LENGTH = 100
BLOCK_BYTES = 4 << 20
DIGEST = 12
SLICE = 1 << 14
BUCKETS_PER_PARTITION = 4
BUCKET_ENTRIES = 1 << 20
BLOCKS_PER_TASK = 16

# Perfect difference sets, by period.
COVERS = {
    1: (0,),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
}
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = np.uint64(0xD6E8FEB86659FD93)
BYTE_VALUES = np.random.default_rng(100).integers(0, 2**64, (2, 256), dtype=np.uint64)

BLOCKS = "block long, file string, offset long, length long, n_bytes long"
BLOCKS_ARROW = pa.schema(
    [
        ("block", pa.int64()),
        ("file", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
        ("n_bytes", pa.int64()),
    ]
)
ENTRIES = "bucket long, block long, entries binary"
ENTRIES_ARROW = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("entries", pa.binary())])
ANSWERS = "block long, bucket long, bits binary"
ANSWERS_ARROW = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
KEPT = "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
KEPT_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("spans", pa.list_(SPAN)),
        ("kept", pa.binary()),
    ]
)


def cover_for(length: int) -> tuple[int, tuple[int, ...]]:
    """Period and offsets of the cover for strings of ``length`` bytes; sample strings keep 2/5 of it."""
    period = max(v for v in COVERS if v == 1 or length - v + 1 >= max(16, 2 * length // 5))
    return period, COVERS[period]


def fingerprints(data: np.ndarray, size: int, starts: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit fingerprint of the ``size`` bytes from each of ``starts``, which must ascend.

    Polynomials in 64-bit arithmetic over random byte values, built by doubling for all positions of
    a slice at once; slices without a start are skipped.
    """
    out = np.empty(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        factors = [np.uint64(MULTIPLIERS[seed])]
        while 2 << len(factors) <= 2 * size:
            factors.append(factors[-1] * factors[-1])
        done = 0
        while done < len(starts):
            at = int(starts[done])
            upto = int(np.searchsorted(starts, at + SLICE))
            own = starts[done:upto] - at
            count = int(own[-1]) + 1
            power, place, total = BYTE_VALUES[seed][data[at : at + count + size - 1]], 0, None
            for k, factor in enumerate(factors):
                width = 1 << k
                if size & width:  # the parts of ``size``, short ones first
                    part = power[place : place + count][own]
                    total = part if total is None else total * factor + part
                    place += width
                if 2 * width <= size:
                    power = power[:-width] * factor + power[width:]
            total ^= total >> np.uint64(32)
            total *= MIX
            total ^= total >> np.uint64(29)
            out[done:upto] = total
            done = upto
    return out


class Spread:
    """Marks over positions, set for whole ranges at a time."""

    def __init__(self, size: int):
        self.steps = np.zeros(size + 1, np.int32)

    def add(self, starts: np.ndarray, ends: np.ndarray) -> None:
        np.add.at(self.steps, starts, 1)
        np.add.at(self.steps, ends, -1)

    def marks(self) -> np.ndarray:
        return np.cumsum(self.steps[:-1]) > 0


class Block:
    """Whole documents, ascending by id, one after another."""

    def __init__(self, doc_ids: list[int | None], ends: np.ndarray, digests: np.ndarray, data: np.ndarray):
        self.doc_ids, self.ends, self.digests, self.data = doc_ids, ends, digests, data
        self.sizes = np.diff(ends, prepend=0)
        self.starts = ends - self.sizes

    @classmethod
    def of(cls, docs: list[tuple[int | None, bytes]]) -> Block:
        docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
        ends = np.cumsum([len(t) for _, t in docs], dtype=np.int64)
        digests = b"".join(hashlib.sha256(t).digest()[:DIGEST] for _, t in docs)
        data = b"".join(t for _, t in docs)
        return cls(
            [i for i, _ in docs], ends, np.frombuffer(digests, np.uint8).reshape(-1, DIGEST), np.frombuffer(data, np.uint8)
        )

    def to_bytes(self) -> bytes:
        head = np.array([len(self.doc_ids)], "<i8").tobytes()
        null = np.array([i is None for i in self.doc_ids], np.uint8).tobytes()
        ids = np.array([i or 0 for i in self.doc_ids], "<i8").tobytes()
        rest = (self.ends.astype("<i8"), self.digests, self.data)
        return zstandard.ZstdCompressor(level=1).compress(head + null + ids + b"".join(a.tobytes() for a in rest))

    @classmethod
    def from_bytes(cls, packed: bytes) -> Block:
        raw = zstandard.ZstdDecompressor().decompress(packed)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        null = np.frombuffer(raw, np.uint8, n, 8)
        ids = np.frombuffer(raw, "<i8", n, 8 + n).tolist()
        ends = np.frombuffer(raw, "<i8", n, 8 + 9 * n)
        doc_ids = [None if gone else i for i, gone in zip(ids, null.tolist(), strict=True)]
        digests = np.frombuffer(raw, np.uint8, DIGEST * n, 8 + 17 * n).reshape(-1, DIGEST)
        return cls(doc_ids, ends, digests, np.frombuffer(raw, np.uint8, offset=8 + (17 + DIGEST) * n))


@dataclass
class Found:
    """Distinct keys of a block, ascending by bucket, and where each string belongs."""

    buckets: np.ndarray  # of each distinct key, ascending
    records: np.ndarray  # what is sent of each distinct key: (keys, bytes)
    groups: np.ndarray  # of each string, the place of its key
    again: np.ndarray  # of each string, whether the block has an equal one (samples) or an earlier one

    def rows(self, block: int) -> Iterator[tuple[int, int, bytes]]:
        """(bucket, block, entries) for the exchange."""
        edges = [*np.flatnonzero(np.diff(self.buckets, prepend=-1)).tolist(), len(self.buckets)]
        for a, b in itertools.pairwise(edges):
            yield int(self.buckets[a]), block, self.records[a:b].tobytes()

    def settled(self, answers: list | None) -> np.ndarray:
        """Of each string, whether this block or the answers of the buckets say yes."""
        bits = np.zeros(len(self.buckets), bool)
        for answer in answers or ():
            a, b = np.searchsorted(self.buckets, [answer["bucket"], answer["bucket"] + 1])
            bits[a:b] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=b - a).astype(bool)
        return self.again | bits[self.groups]


def bucket_of(high: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of 64-bit fingerprints, by their upper half, so that ascending keys have ascending buckets."""
    return ((high >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def as_bytes(column: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` low bytes of each number, least significant first."""
    return np.ascontiguousarray(column.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]


def from_bytes(columns: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(columns), 8), np.uint8)
    wide[:, : columns.shape[1]] = columns
    return wide.view("<u8").ravel()


def repeated_keys(keys: np.ndarray, buckets: int) -> Found:
    """For samples: each distinct key by its lower half, which a bucket compares."""
    distinct, groups, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return Found(
        bucket_of(distinct, buckets).astype(np.int64), as_bytes(distinct, 4), groups, (counts > 1)[groups]
    )


def first_keys(high: np.ndarray, low: np.ndarray, order: np.ndarray, width: int, buckets: int) -> Found:
    """For strings in ascending order: each distinct key with the order of its first string."""
    n = len(high)
    by = np.lexsort((low, high))
    high, low = high[by], low[by]
    new = np.ones(n, bool)
    new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    groups, again = np.empty(n, np.int64), np.empty(n, bool)
    groups[by], again[by] = np.cumsum(new) - 1, ~new
    records = np.hstack([as_bytes(high[new], 8), as_bytes(low[new], 4), as_bytes(order[by][new], width)])
    return Found(bucket_of(high[new], buckets).astype(np.int64), records, groups, again)


@dataclass(frozen=True)
class Plan:
    """What all tasks of a run agree on."""

    length: int
    buckets: int
    least_id: int  # the smallest document id
    id_bytes: int  # bytes that hold any id's distance from it

    @property
    def period(self) -> int:
        return cover_for(self.length)[0]

    def order(self, doc_ids: list[int | None]) -> np.ndarray:
        """Ascending with the ids; null, as the smallest, is 0."""
        most = (1 << 64) - 1  # only ids 2^64 - 1 apart could reach it
        return np.array([0 if i is None else min(most, i - self.least_id + 1) for i in doc_ids], np.uint64)


class Search:
    """The steps over one block; each needs the answers to those before it."""

    def __init__(self, block: Block, plan: Plan):
        self.block, self.plan = block, plan
        self.order = plan.order(block.doc_ids)
        self.long = np.flatnonzero(block.sizes >= plan.length)

    def copies(self) -> Found:
        """Whole texts."""
        digests = self.block.digests[self.long]
        high, low = from_bytes(digests[:, :8]), from_bytes(digests[:, 8:])
        return first_keys(high, low, self.order[self.long], self.plan.id_bytes, self.plan.buckets)

    def drop(self, answers: list | None) -> None:
        """From here on without the copies of earlier texts."""
        later = self.copies().settled(answers)
        self.copied, self.live = self.long[later], self.long[~later]
        b, size = self.block, len(self.block.data)
        self.left = np.zeros(size, np.int32)  # bytes from a position to its document's end
        self.at = np.zeros(size, np.int32)  # bytes before it
        self.doc = np.zeros(size, np.int32)
        for d in self.live.tolist():
            n, place = int(b.sizes[d]), slice(int(b.starts[d]), int(b.ends[d]))
            self.at[place] = np.arange(n, dtype=np.int32)
            self.left[place] = n - self.at[place]
            self.doc[place] = d

    def samples(self) -> Found:
        length, (period, offsets) = self.plan.length, cover_for(self.plan.length)
        self.size = length - period + 1
        in_cover = np.isin(np.arange(period), offsets)
        self.spots = np.flatnonzero((self.left >= self.size) & in_cover[self.at % period])
        return repeated_keys(fingerprints(self.block.data, self.size, self.spots), self.plan.buckets)

    def keys_at(self, starts: np.ndarray, size: int) -> Found:
        high = fingerprints(self.block.data, size, starts)
        low = fingerprints(self.block.data, size, starts, 1) >> np.uint64(32)
        return first_keys(high, low, self.order[self.doc[starts]], self.plan.id_bytes, self.plan.buckets)

    def contexts(self, answers: list | None) -> Found:
        """Of repeated samples, the longest surroundings that every string on the sample lies in."""
        length, before = self.plan.length, self.plan.period - 1
        self.spots = self.spots[self.samples().settled(answers)]
        self.inner = self.spots[(self.at[self.spots] >= before) & (self.left[self.spots] >= length)]
        return self.keys_at(self.inner - before, length + before)

    def strings(self, answers: list | None) -> Found:
        """Strings near repeated samples that no context has settled."""
        length, before, size = self.plan.length, self.plan.period - 1, len(self.block.data)
        later = self.inner[self.contexts_found.settled(answers)]
        settled, near = Spread(size), Spread(size)
        settled.add(later - before, later + 1)
        near.add(self.spots - np.minimum(before, self.at[self.spots]), self.spots + 1)
        self.settled = settled.marks()
        self.open = np.flatnonzero(near.marks() & ~self.settled & (self.left >= length))
        return self.keys_at(self.open, length)

    def run(self, upto: str, answers: dict[str, list | None]) -> Found | None:
        """What step ``upto`` asks, or None after all steps."""
        if upto == "copies":
            return self.copies()
        self.drop(answers["copies"])
        found = self.samples()
        if upto == "samples":
            return found
        self.contexts_found = self.contexts(answers["samples"])
        if upto == "contexts":
            return self.contexts_found
        found = self.strings(answers["contexts"])
        if upto == "strings":
            return found
        self.starts = np.union1d(np.flatnonzero(self.settled), self.open[found.settled(answers["strings"])])
        return None

    def results(self) -> Iterator[tuple[int | None, int, int, list[dict], bytes]]:
        """doc_id, bytes, removed bytes, removed spans and kept bytes of every document."""
        b, gone = self.block, Spread(len(self.block.data))
        gone.add(self.starts, self.starts + self.plan.length)
        gone.add(b.starts[self.copied], b.ends[self.copied])
        marks = gone.marks()
        for doc_id, start, end in zip(b.doc_ids, b.starts.tolist(), b.ends.tolist(), strict=True):
            own = marks[start:end]
            edges = np.flatnonzero(np.diff(own, prepend=False, append=False)).tolist() if own.any() else []
            spans = [{"start": s, "end": e} for s, e in zip(edges[::2], edges[1::2], strict=True)]
            kept = b.data[start:end]
            yield doc_id, end - start, int(own.sum()), spans, (kept[~own] if spans else kept).tobytes()


STEPS = ("copies", "samples", "contexts", "strings")


def write_blocks(docs: DataFrame, folder: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write the texts as compressed blocks; returns their index, itself in files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, number = TaskContext.get().partitionId(), None, 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def write() -> pa.RecordBatch:
            nonlocal out, number, held, size
            out = out or TaskFile(folder, f"part-{part:06d}", ".blocks")
            packed = Block.of(held).to_bytes()
            row = [part << 32 | number, out.path, out.write(packed), len(packed), size]
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, BLOCKS_ARROW.types, strict=True)], schema=BLOCKS_ARROW
            )

        try:
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    data = text.as_buffer().to_pybytes()
                    if held and size + len(data) > block_bytes:
                        yield write()
                    held.append((doc_id, data))
                    size += len(data)
            if held:
                yield write()
        except BaseException:
            if out:
                out.abort()
            raise
        if out:
            out.close()

    texts(docs).mapInArrow(run, BLOCKS).write.parquet(f"{folder}/index")
    return docs.sparkSession.read.schema(BLOCKS).parquet(f"{folder}/index")


def ask(index: DataFrame, answers: dict[str, DataFrame], plan: Plan, tasks: int, step: str) -> DataFrame:
    """bucket, block, entries: what every block asks in ``step``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, search, known in opened(batches, plan):
            rows = list(search.run(step, known).rows(block))
            if rows:
                yield columns(rows, ENTRIES_ARROW)

    return with_answers(index, answers, tasks).mapInArrow(run, ENTRIES)


def with_answers(index: DataFrame, answers: dict[str, DataFrame], tasks: int) -> DataFrame:
    """``index`` with a column of answers per step, dealt to ``tasks`` tasks by block."""
    for name, df in answers.items():
        gathered = df.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias(name))
        index = index.join(gathered, "block", "left")
    return index.repartition(tasks, F.xxhash64("block"))  # by block alone, the join's few partitions would be kept


def opened(batches: Iterable[pa.RecordBatch], plan: Plan) -> Iterator[tuple[int, Search, dict[str, list | None]]]:
    """(block, its search, answers by step) of rows of :func:`with_answers`; one block at a time is held."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            (packed,) = read_ranges(row["file"], [(row["offset"], row["length"])])
            yield row["block"], Search(Block.from_bytes(packed), plan), row


def columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema
    )


def bucketwise(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(bucket, [(block, entries)]) of rows sorted by bucket."""
    bucket, held = None, []
    for batch in batches:
        for b, block, entries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and b != bucket:
                yield bucket, held
                held = []
            bucket = b
            held.append((block, entries))
    if held:
        yield bucket, held


def occurs_again(entries: list[np.ndarray]) -> np.ndarray:
    """Of all four-byte keys, one after another, whether it is there twice."""
    keys = from_bytes(np.concatenate(entries)).astype(np.uint32)
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    at = np.minimum(np.searchsorted(twice, keys), max(0, len(twice) - 1))
    return twice[at] == keys if len(twice) else np.zeros(len(keys), bool)


def starts_earlier(entries: list[np.ndarray]) -> np.ndarray:
    """Of all strings, one block's after another's, whether an equal one is before it in the order of documents."""
    every = np.concatenate(entries)
    high, low, order = from_bytes(every[:, :8]), from_bytes(every[:, 8:12]), from_bytes(every[:, 12:])
    by = np.lexsort((order, low, high))  # stable, so equal ids stay in the order of blocks
    out = np.zeros(len(by), bool)
    out[by[1:]] = (high[by[1:]] == high[by[:-1]]) & (low[by[1:]] == low[by[:-1]])
    return out


def answer(asked: DataFrame, plan: Plan, partitions: int, step: str) -> DataFrame:
    """block, bucket, bits: the answers to ``asked``, one sorted bucket at a time."""
    width, decide = (4, occurs_again) if step == "samples" else (12 + plan.id_bytes, starts_earlier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in bucketwise(batches):
            entries = [np.frombuffer(e, np.uint8).reshape(-1, width) for _, e in rows]
            said, at, out = decide(entries), 0, []
            for (block, _), own in zip(rows, entries, strict=True):
                bits = said[at : at + len(own)]
                at += len(own)
                if bits.any():
                    out.append((block, bucket, np.packbits(bits).tobytes()))
            if out:
                yield columns(out, ANSWERS_ARROW)

    dealt = asked.repartition(partitions, "bucket").sortWithinPartitions("bucket", "block")
    return dealt.mapInArrow(run, ANSWERS)


def make_plan(spark: SparkSession, docs: DataFrame, index: DataFrame, length: int) -> tuple[Plan, int, int]:
    """The plan, and the numbers of tasks over blocks and over buckets, both growing with the data."""
    ids = docs.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).first()
    size = index.agg(F.count(F.lit(1)).alias("blocks"), F.sum("n_bytes").alias("bytes")).first()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    period, offsets = cover_for(length)
    samples = (size["bytes"] or 0) * len(offsets) // period
    buckets = min(1 << 31, max(BUCKETS_PER_PARTITION * partitions, samples // BUCKET_ENTRIES))
    least, most = (ids.least or 0, ids.most or 0)
    plan = Plan(length, buckets, least, min(8, -(-(most - least + 1).bit_length() // 8)))
    return plan, max(partitions, size["blocks"] // BLOCKS_PER_TASK), max(partitions, buckets // BUCKETS_PER_PARTITION)


def remove_repeats(docs: DataFrame, length: int = LENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed byte ranges) and kept (bytes) of every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    index = write_blocks(docs, fresh_path(spark, "suffix_blocks"), block_bytes)
    plan, tasks, partitions = make_plan(spark, texts(docs).select("doc_id"), index, length)
    answers: dict[str, DataFrame] = {}
    for step in STEPS:
        asked = ask(index, answers, plan, tasks, step)
        answers[step] = materialize(answer(asked, plan, partitions, step), f"suffix_{step}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, search, known in opened(batches, plan):
            search.run("results", known)
            yield columns(list(search.results()), KEPT_ARROW)

    return with_answers(index, answers, tasks).mapInArrow(run, KEPT)


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, sizes before and of what goes, removed runs, and a digest of what stays, of every document."""
    return remove_repeats(docs).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
