"""Byte-pair encoding through a table of distinct words, and decoding through a table of pieces.

Spark splits texts into words with the tokenizer's expression. A task sends every distinct word of
a chunk of documents once; a chunk is some thousand neighbouring rows of a file, so that both passes over the
documents know it. Words meet by hash, where every distinct word is encoded once, by the tokenizers library, and
the table of words, ids and chunks is written to the shared folder. The ids are then joined back by position:

* The words of the most chunks, at most ``table_words`` of them (a bound of some 25 bytes each),
  are held by every worker as sorted arrays.
* The ids of all others, which are in few chunks each, are dealt to those chunks, as a folder of
  the shared folder for each chunk, and read by the task that has the chunk's documents.

Neither texts nor occurrences are shuffled, however many words there are: what moves is a row for each
word and chunk, and back for the rarer words only. Documents that are not read from Parquet files have no rows of a
file, and are written to the shared folder first.

Words are told apart by hash. Those that share one, which is next to never, are told apart by themselves.

Decoding joins ids to the pieces of the vocabulary, some 50,000 rows, inside each task.

Texts that hold a special token's string, or characters outside ``encoding.SETTLED``, are encoded
whole by the library, since their words could be split differently.

Defined results: a null text counts as empty and has no ids; null ids and repeated rows are
encoded like any other row; decoding turns invalid bytes into U+FFFD and fails on ids outside the
vocabulary; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scale import fresh_path, materialize
from .common import releasing, texts
from .encoding import SETTLED, byte_of_symbol, default_path, encoder
from .files import file_system

TABLE_WORDS = 1_000_000
WORDS_AT_ONCE = 20_000
ITEMS_AT_ONCE = 500_000

# A chunk's words are held together: rows of a chunk, and how many of those whose texts are longer than LONG_TEXT.
CHUNK_ROWS, CHUNK_LONG_ROWS, LONG_TEXT = 4096, 64, 1 << 16
HASH_SEED = 42  # of Spark's xxhash64
TABLE_SCHEMA = "hash long, word string, ids array<int>, n_chunks int, chunks array<long>"

# The word expression of byte-level tokenizer files in Java's syntax; \s there is ASCII only.
BLANK = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
JAVA_WORDS = (
    r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^" + BLANK + r"\p{L}\p{N}]+|["
    + BLANK + "]+(?![^" + BLANK + "])|[" + BLANK + "]+"
)
FIRST_RANGE = rf"[^\x{{{SETTLED[0][0]:x}}}-\x{{{SETTLED[0][1]:x}}}]"
JAVA_UNSETTLED = "[^" + "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in SETTLED) + "]"

IDS = pa.list_(pa.int32())


def special_strings(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def in_chunks(docs: DataFrame) -> DataFrame:
    """``texts(docs)`` with ``chunk``, which is the same for neighbouring rows of a file whenever they are read."""
    rows = texts(docs)
    try:
        place = rows.metadataColumn("_metadata")
        long_text = F.length("text") > LONG_TEXT
        part = F.floor(place.getField("row_index") / F.when(long_text, CHUNK_LONG_ROWS).otherwise(CHUNK_ROWS))
        return rows.select("doc_id", "text", F.xxhash64(place.getField("file_path"), part, long_text).alias("chunk"))
    except AnalysisException:  # no Parquet files, or rows that are not theirs
        return in_chunks(materialize(rows, "texts"))


def split_words(keyed: DataFrame, path: str) -> DataFrame:
    """``keyed`` with words (null for texts to be encoded whole) and whole (the text of those, else null) for ``text``."""
    # Most texts stay within the first range, which is quick to see; all ranges are slow in Java.
    odd: Column = F.when(F.col("text").rlike(FIRST_RANGE), F.col("text").rlike(JAVA_UNSETTLED)).otherwise(False)
    for mark in special_strings(path):
        odd = odd | F.col("text").contains(mark)
    others = [c for c in keyed.columns if c != "text"]
    return keyed.select(*others, "text", odd.alias("odd")).select(
        *others,
        F.when(~F.col("odd"), F.regexp_extract_all("text", F.lit(JAVA_WORDS), F.lit(0))).alias("words"),
        F.when(F.col("odd"), F.col("text")).alias("whole"),
    )


def hash_mask(bits: int) -> int:
    return (1 << bits) - 1


def word_hashes(words: list[str], bits: int) -> np.ndarray:
    """As Spark's xxhash64 gives them, the lowest ``bits`` of them."""
    found = (xxhash.xxh64_intdigest(w.encode(), HASH_SEED) for w in words)
    return np.fromiter(found, np.uint64, len(words)) & np.uint64(hash_mask(bits))


def chunk_words(split: DataFrame) -> DataFrame:
    """(word, chunk) of ``split`` (chunk, words); a task gives the words of a chunk once, unless it returns to the chunk later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set[str]] = {}
        for part in slices(batches):
            of, lists = part.column(0).to_numpy(), part.column(1)
            here = np.unique(of)
            seen = {c: seen.get(c, set()) for c in here.tolist()}
            for c, known in seen.items():
                own = lists if len(here) == 1 else lists.filter(pa.array(of == c))
                new = [w for w in own.flatten().unique().to_pylist() if w not in known]
                known.update(new)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(new, pa.string()), pa.array(np.full(len(new), c, np.int64))], names=["word", "chunk"]
                )

    return split.select("chunk", "words").mapInArrow(releasing(run), "word string, chunk long")


def whole_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, sorted by their first column, cut only between its values."""
    held: list[pa.RecordBatch] = []
    last = None

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(0).to_numpy()
        cut = int(np.searchsorted(values, values[-1]))
        if held and (cut or values[0] != last):
            yield joined([*held, batch.slice(0, cut)])
            held = []
        elif cut:
            yield batch.slice(0, cut)
        held.append(batch.slice(cut))
        last = values[-1]
    if held:
        yield joined(held)


def word_table(split: DataFrame, path: str, hash_bits: int = 64) -> str:
    """Encode every distinct word of ``split`` (chunk, words) once; returns the folder of the table.

    ``word`` is null unless another word has the same hash; ``chunks`` may name a chunk twice.
    """
    by_hash = F.xxhash64("word").bitwiseAND(F.lit(-1 if hash_bits == 64 else hash_mask(hash_bits)).cast("long"))
    met = chunk_words(split).repartition(by_hash).select(by_hash.alias("hash"), "word", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(path).library
        for batch in whole_runs(batches):
            runs = pc.run_end_encode(batch.column(1))
            words, ends = runs.values.to_pylist(), runs.run_ends.to_numpy()
            hashes = batch.column(0).to_numpy()[ends - 1]
            shared = np.zeros(len(words), bool)
            shared[1:] = hashes[1:] == hashes[:-1]
            shared[:-1] |= shared[1:]
            ids = []
            for at in range(0, len(words), WORDS_AT_ONCE):
                some = library.encode_batch_fast(words[at : at + WORDS_AT_ONCE], add_special_tokens=False)
                ids += [e.ids for e in some]
            edges = np.concatenate([[0], ends]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes),
                    pa.array(words, pa.string(), mask=~shared),
                    pa.array(ids, IDS),
                    pa.array(np.diff(edges)),
                    pa.ListArray.from_arrays(edges, batch.column(2)),
                ],
                names=["hash", "word", "ids", "n_chunks", "chunks"],
            )

    folder = fresh_path(split.sparkSession, "word_table")
    met.sortWithinPartitions("hash", "word").mapInArrow(releasing(run), TABLE_SCHEMA).write.parquet(folder)
    return folder


class Table:
    """Hashes of words and their ids as arrays sorted by hash, from the Parquet files of a folder, which may be missing."""

    def __init__(self, folder: str):
        system, inner = file_system(folder)
        found = system.get_file_info(pafs.FileSelector(inner, allow_not_found=True))
        hashes, counts, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.uint16)]
        for info in sorted(found, key=lambda i: i.path):  # one by one, to hold no second copy
            if not info.path.endswith(".parquet"):
                continue
            with system.open_input_file(info.path) as f:
                data = pq.read_table(f, columns=["hash", "ids"], use_threads=False)
            lists = data.column("ids").combine_chunks()
            lengths, values = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()
            hashes.append(data.column("hash").to_numpy().view(np.uint64))
            counts.append(lengths.astype(np.min_scalar_type(int(lengths.max(initial=0)))))
            ids.append(values.astype(np.min_scalar_type(int(values.max(initial=0)))))
        del found
        counts = np.concatenate(counts)
        starts = np.concatenate([[0], np.cumsum(counts[:-1], dtype=np.uint32)]).astype(np.uint32)[: len(counts)]
        self.ids = np.concatenate(ids)
        # A row that finds nothing closes the hashes, so that every search lands inside them.
        self.hashes = np.concatenate([*hashes, [np.uint64(0xFFFFFFFFFFFFFFFF)]])
        hashes.clear()
        order = np.argsort(self.hashes[:-1])
        self.hashes[:-1] = self.hashes[:-1][order]
        self.starts, self.counts = starts[order], counts[order]
        pa.default_memory_pool().release_unused()

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the hashes ``wanted`` are here, and the rows of those."""
        at = np.searchsorted(self.hashes, wanted)
        here = (at < len(self.counts)) & (self.hashes[at] == wanted)
        return here, at[here]

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of ids of ``rows``, and these ids in one array."""
        counts = self.counts[rows].astype(np.int64)
        return counts, self.ids[spread(self.starts[rows], counts)]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions of stretches that begin at ``starts`` and have ``counts`` items, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts.astype(np.int64) - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


def ids_of(
    words: list[str], tables: Iterable[Table], shared: dict[str, list[int]], hash_bits: int = 64
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the ids of each word begin, how many they are, and the ids, from the first of ``tables`` that has the word."""
    starts, counts, found, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0

    def add(rows: np.ndarray, numbers: np.ndarray, ids: np.ndarray) -> None:
        nonlocal size
        starts[rows], counts[rows] = size + np.cumsum(numbers) - numbers, numbers
        found.append(ids)
        size += len(ids)

    left, wanted = np.arange(len(words)), word_hashes(words, hash_bits)
    if shared:
        known = np.array([w in shared for w in words], bool)
        lists = [shared[words[i]] for i in np.flatnonzero(known)]
        add(left[known], np.array([len(x) for x in lists], np.int64), np.array([i for x in lists for i in x], np.uint32))
        left = left[~known]
    for held in tables if len(left) else ():
        here, rows = held.find(wanted[left])
        add(left[here], *held.gather(rows))
        left = left[~here]
        if not len(left):
            break
    if len(left):
        raise ValueError("a word is missing from the table")
    return starts, counts, np.concatenate([np.zeros(0, np.uint16), *found])


def join(
    words: pa.ListArray, tables: Iterable[Table], shared: dict[str, list[int]], hash_bits: int = 64
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all lists in one array, and where each list begins in it (one more at the end)."""
    coded = words.flatten().dictionary_encode()
    starts, counts, ids = ids_of(coded.dictionary.to_pylist(), tables, shared, hash_bits)
    each = coded.indices.to_numpy() if len(coded) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(counts[each])])
    lengths = words.value_lengths().fill_null(0).to_numpy()
    return ids[spread(starts[each], counts[each])], ends[np.concatenate([[0], np.cumsum(lengths)])]


def slices(batches: Iterator[pa.RecordBatch], items: int = ITEMS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """``batches`` cut so that the lists in column 1 of each hold about ``items`` items together."""
    for batch in batches:
        ends = np.cumsum(batch.column(1).value_lengths().fill_null(0).to_numpy())
        at = 0
        while at < batch.num_rows:
            base = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, base + items, side="right")))
            yield batch.slice(at, upto - at)
            at = upto


_TABLES: dict[str, Table] = {}


def table(folder: str) -> Table:
    """The worker's copy of a table that all chunks need; only the last one is kept."""
    if folder not in _TABLES:
        _TABLES.clear()
        _TABLES[folder] = Table(folder)
    return _TABLES[folder]


def divide(folder: str, spark: SparkSession, table_words: int) -> tuple[str, str | None, dict[str, list[int]]]:
    """Of the word table in ``folder``: the folder of the words that every worker holds, at most ``table_words``,
    that of the others by chunk (None if there are none), and the ids of words that share a hash."""
    entries = spark.read.schema(TABLE_SCHEMA).parquet(folder)
    shared = {r.word: r.ids for r in entries.where(F.col("word").isNotNull()).select("word", "ids").collect()}
    alone = entries.where(F.col("word").isNull())
    total, least = 0, None  # the words of most chunks first
    for n_chunks, n_words in sorted(alone.groupBy("n_chunks").count().collect(), reverse=True):
        if total + n_words > table_words:
            break
        total, least = total + n_words, n_chunks
    else:
        if not shared:
            return folder, None, shared
    common, rest = fresh_path(spark, "common_words"), fresh_path(spark, "chunk_words")
    held = F.lit(False) if least is None else F.col("n_chunks") >= least
    alone.where(held).select("hash", "ids").write.parquet(common)
    dealt = alone.where(~held).select(F.explode("chunks").alias("chunk"), "hash", "ids")
    dealt.repartition("chunk").write.partitionBy("chunk").parquet(rest)
    return common, rest, shared


def look_up(
    split: DataFrame, folders: tuple[str, str | None, dict[str, list[int]]], path: str, decoded: bool, hash_bits: int
) -> DataFrame:
    """doc_id, ids and, if asked for, the decoded text of split documents (doc_id, words, whole, chunk)."""
    common, rest, shared = folders

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_table(path) if decoded else []
        near: dict[int, Table] = {}  # of the chunks that the last rows were of

        def tables(chunks: list[int]) -> Iterator[Table]:
            yield table(common)
            for c in chunks if rest else ():
                if c not in near:
                    near[c] = Table(f"{rest}/chunk={c}")
                yield near[c]

        for part in slices(batches):
            doc_id, words, whole, chunk = part.columns
            chunks = np.unique(chunk.to_numpy()).tolist()
            near = {c: t for c, t in near.items() if c in chunks}
            ids, starts = join(words, tables(chunks), shared, hash_bits)
            odd = {i: encoder(path).encode(t) for i, t in enumerate(whole.to_pylist()) if t is not None}
            if odd:
                parts = [odd.get(i, ids[starts[i] : starts[i + 1]]) for i in range(len(words))]
                starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                ids = np.concatenate(parts)
            lists = pa.ListArray.from_arrays(starts.astype(np.int32), pa.array(ids.astype(np.int32)))
            columns = [doc_id, lists, *([joined_pieces(lists, pieces)] if decoded else [])]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded"][: len(columns)])

    rows = split.select("doc_id", "words", "whole", "chunk")
    return rows.mapInArrow(run, "doc_id long, ids array<int>" + (", decoded string" if decoded else ""))


def encode(
    docs: DataFrame,
    tokenizer: str | None = None,
    table_words: int = TABLE_WORDS,
    decoded: bool = False,
    hash_bits: int = 64,
) -> DataFrame:
    """doc_id and ids (array of int) of every row of ``docs`` (doc_id, text); with ``decoded``, what they decode to."""
    path = tokenizer or default_path("byte_bpe_50k.json")
    split = split_words(in_chunks(docs), path)
    folder = word_table(split, path, hash_bits)
    return look_up(split, divide(folder, docs.sparkSession, table_words), path, decoded, hash_bits)


def piece_table(path: str) -> list[bytes]:
    """Bytes of every id of a byte-level tokenizer file."""
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    symbols = byte_of_symbol()
    pieces = {i: bytes(symbols[c] for c in t) for t, i in config["model"]["vocab"].items() if all(c in symbols for c in t)}
    pieces |= {t["id"]: t["content"].encode() for t in config["added_tokens"]}
    return [pieces[i] for i in range(max(pieces) + 1)]


def joined_pieces(ids: pa.ListArray, pieces: list[bytes]) -> pa.Array:
    """The text of every list of ids."""
    flat, ends = ids.flatten().to_numpy(zero_copy_only=False), ids.offsets.to_numpy() - ids.offsets[0].as_py()
    said = [
        b"".join(map(pieces.__getitem__, flat[a:b].tolist())).decode("utf-8", "replace")
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
    ]
    return pa.array(said, pa.string())


def decode(encoded: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids) with column ``decoded``: the ids' pieces joined, as text."""
    path = tokenizer or default_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_table(path)
        for batch in slices(batches):
            doc_id, ids = batch.columns
            yield pa.RecordBatch.from_arrays(
                [doc_id, ids, joined_pieces(ids, pieces)], names=["doc_id", "ids", "decoded"]
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text of every row."""
    back = encode(docs, decoded=True)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
