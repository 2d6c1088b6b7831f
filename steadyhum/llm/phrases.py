"""Collocations: frequent phrases of two to four words, scored by their weakest cut.

Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and pieces into words
at blanks and tabs. Everything is counted per language; f is the count of a phrase. A phrase scores
``floor(2 * 10^6 * f(phrase) / (f(first part) + f(rest)))`` at its worst cut, the shortest first part
winning ties; phrases that mostly occur inside a longer frequent one are dropped.

Counting is a HAT-trie in every map task. Inner nodes branch on word ids, one word a level, and leaves
are hash containers of whole phrases, which burst into an inner node when they are full. When a
task's trie holds too many phrases, its largest subtrees are spilled whole, as sorted runs dealt by prefix
partition (the first words of the phrases); one task merges the runs of a partition. Word ids are 64-bit
hashes of the words; equal ids of different words are looked for among all words of a
language, and other hashes are taken if there are any.

A phrase cannot be more frequent than its parts, so words are counted first, pairs of frequent words
next, and then longer phrases whose pairs are all frequent. Tasks know the frequent ones from a Bloom filter in
the shared folder, of 16 bits per entry and at most ``FILTER_BITS``: a false hit costs a little
counting, and nothing is lost. Partitions grow with the number of words. All that meets in one place is the count of a
phrase per task, so frequent words, phrases and languages crowd no task.

Scores come from joins between frequent phrases and their parts, in decimals, which hold products of
more than 64 bits. Intermediate tables are written to the shared folder.

Defined results: null and empty texts have no words; a null language is ``und``, as is that name itself;
null ids and repeated rows count like any other; an empty table gives no rows. Whole texts are
counted; a text is cut at its pieces, so it may be of any length, and only one piece must fit in
a task's memory, some 40 times over.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scale import fresh_path, materialize
from .files import file_system

MIN_COUNT = 30
LONGEST = 4
TOP = 2000
SHARES = 32
SHARE = 80
UNKNOWN = "und"
ENDS = b".,;:!?\n\x0b\x0c\r"
BLANKS = b" \t"

SLICE_BYTES = 2 << 20
WORDS_HELD = 300_000
BURST = 4096
PHRASES_HELD = 400_000
ENTRIES_PER_PART = 1 << 20
PARTS_PER_PARTITION = 4
FILTER_BITS = 1 << 30
SEGMENT_BITS = 1 << 19
PROBES = 3

FACTOR = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
KIND = np.zeros(256, np.uint8)  # 0 in a word, 1 between words, 2 between pieces
KIND[list(BLANKS)] = 1
KIND[list(ENDS)] = 2
ENDS_OF_PIECES = re.compile(b"[" + re.escape(ENDS) + b"]")

WORDS = "lang string, id long, word string, n long"
WORDS_ARROW = pa.schema([("lang", pa.string()), ("id", pa.int64()), ("word", pa.string()), ("n", pa.int64())])
RUNS = "lang string, size int, part long, ids binary, counts binary"
RUNS_ARROW = pa.schema(
    [("lang", pa.string()), ("size", pa.int32()), ("part", pa.int64()), ("ids", pa.binary()), ("counts", pa.binary())]
)
COUNTS = "lang string, size int, ids array<long>, n long"
COUNTS_ARROW = pa.schema(
    [("lang", pa.string()), ("size", pa.int32()), ("ids", pa.list_(pa.int64())), ("n", pa.int64())]
)
MARKS = "segment int, spots binary"
MARKS_ARROW = pa.schema([("segment", pa.int32()), ("spots", pa.binary())])


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * MIX
    return x ^ (x >> np.uint64(29))


class Words:
    """Splits bytes into pieces and words, and gives each word its id, for many words at once."""

    def __init__(self, seed: int):
        self.values = np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def reach(self, size: int) -> None:
        if len(self.powers) <= size:
            factors = np.full(size + 1, np.uint64(FACTOR))
            inverses = np.full(size + 1, np.uint64(pow(FACTOR, -1, 1 << 64)))
            factors[0] = inverses[0] = 1
            self.powers = np.multiply.accumulate(factors)
            self.inverses = np.multiply.accumulate(inverses)

    def split(self, data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(lower-cased bytes, starts, ends, ids and pieces of the words); a piece begins at each of ``firsts`` too."""
        data = LOWER[data]
        kind = KIND[data]
        inside, new = kind == 0, np.zeros(len(data) + 1, bool)
        new[firsts] = True
        starts = np.flatnonzero(inside & (new[:-1] | ~np.concatenate([[False], inside[:-1]])))
        ends = np.flatnonzero(inside & (new[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
        pieces = np.cumsum((kind == 2) | new[:-1], dtype=np.int32)[starts]
        self.reach(len(data))
        # A word's id is a polynomial of its bytes: a difference of running sums, brought back to power 0.
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        return data, starts, ends, mixed((sums[ends] - sums[starts]) * self.inverses[starts]), pieces


def cut(text: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """``text`` in parts of ``size`` bytes or more that end with pieces."""
    at = 0
    while len(text) - at > size:
        end = ENDS_OF_PIECES.search(text, at + size)
        if not end:
            break
        yield text[at : end.end()]
        at = end.end()
    yield text[at:]


def by_language(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """(language, bytes of some texts, where each begins) of batches of (lang, text)."""
    for batch in batches:
        lang = batch.column(0).dictionary_encode()
        for code, name in enumerate(lang.dictionary.to_pylist()):
            held, size = [], 0
            for text in batch.column(1).filter(pc.equal(lang.indices, code)):
                for part in cut(text.as_buffer().to_pybytes()):
                    held.append(part)
                    size += len(part)
                    if size >= SLICE_BYTES:
                        yield name, *joined(held)
                        held, size = [], 0
            if size:
                yield name, *joined(held)


def joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *map(len, parts)])[:-1]
    return np.frombuffer(b"".join(parts), np.uint8), starts


def rows(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*found, strict=True) if found else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def spoken(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang and text only, without null."""
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang")
    return docs.select(lang, F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def count_words(docs: DataFrame, seed: int) -> DataFrame:
    """lang, id, word and n of distinct words as each task counts them; a null id has the count of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, totals = Words(seed), Counter()
        counts: dict[str, Counter] = {}
        names: dict[str, dict[int, str]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in counts.items():
                signed = np.array(list(own), np.uint64).view(np.int64).tolist()
                said = [names[lang][i] for i in own]
                yield rows([(lang, i, w, n) for i, w, n in zip(signed, said, own.values(), strict=True)], WORDS_ARROW)
            counts.clear()
            names.clear()

        for lang, data, firsts in by_language(batches):
            data, starts, ends, ids, _ = words.split(data, firsts)
            totals[lang] += len(ids)
            distinct, first, n = np.unique(ids, return_index=True, return_counts=True)
            own, said, text = counts.setdefault(lang, Counter()), names.setdefault(lang, {}), data.tobytes()
            for i, a, b, k in zip(distinct.tolist(), starts[first].tolist(), ends[first].tolist(), n.tolist(), strict=True):
                if i not in said:
                    said[i] = text[a:b].decode()
                own[i] += k
            if sum(map(len, counts.values())) > WORDS_HELD:
                yield from flush()
        yield from flush()
        if totals:
            yield rows([(lang, None, None, n) for lang, n in totals.items()], WORDS_ARROW)

    return docs.mapInArrow(run, WORDS)


def vocabulary(docs: DataFrame, min_count: int, seeds: Iterable[int] = range(8)) -> tuple[DataFrame, int]:
    """lang, id, word, n of frequent words and, with null ids, of all words together; and the seed of the ids."""
    for seed in seeds:
        found = count_words(docs, seed).groupBy("lang", "id").agg(
            F.sum("n").alias("n"), F.min("word").alias("word"), F.max("word").alias("last")
        )
        mixed_up = F.col("word") != F.col("last")
        kept = materialize(found.where((F.col("n") >= min_count) | F.col("id").isNull() | mixed_up), "words")
        if not kept.where(mixed_up).limit(1).count():
            return kept.drop("last"), seed
    raise ValueError("different words have equal ids under every seed")


class Trie:
    """Counts of phrases, given as rows of word ids.

    An inner node is a list of 256 children, chosen by the upper byte of the id of the word at its level;
    a leaf is a hash container of whole phrases. Containers of more than ``burst`` phrases become
    inner nodes, as long as there are words to branch on.
    """

    def __init__(self, size: int, burst: int = BURST):
        self.size, self.burst = size, burst
        self.root: Counter | list = Counter()

    def add(self, phrases: np.ndarray) -> None:
        if len(phrases):
            self.root = self._add(self.root, np.ascontiguousarray(phrases), 0)

    def _add(self, node: Counter | list, phrases: np.ndarray, level: int) -> Counter | list:
        if isinstance(node, Counter):
            node.update(phrases.view(f"V{8 * self.size}").ravel().tolist())
            if len(node) <= self.burst or level == self.size:
                return node
            return self._burst(node, level)
        branch = (phrases[:, level] >> np.uint64(56)).astype(np.uint8)
        order = np.argsort(branch, kind="stable")
        phrases, edges = phrases[order], np.searchsorted(branch[order], np.arange(257))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            node[b] = self._add(node[b], phrases[edges[b] : edges[b + 1]], level + 1)
        return node

    def _burst(self, full: Counter, level: int) -> list:
        node: list = [Counter() for _ in range(256)]
        at = 8 * level + 7  # ids are little-endian
        for phrase, n in full.items():
            node[phrase[at]][phrase] = n
        if level + 1 < self.size:
            return [self._burst(c, level + 1) if len(c) > self.burst else c for c in node]
        return node

    def __len__(self) -> int:
        return self._length(self.root)

    def _length(self, node: Counter | list) -> int:
        return len(node) if isinstance(node, Counter) else sum(map(self._length, node))

    def spill(self, down_to: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(phrases, counts) of the largest subtrees, which are emptied until ``down_to`` phrases are left."""
        if isinstance(self.root, Counter):
            subtrees, self.root = [self.root], Counter()
            left = 0
        else:
            sizes = [self._length(c) for c in self.root]
            left, subtrees = sum(sizes), []
            for b in sorted(range(256), key=sizes.__getitem__, reverse=True):
                if left <= down_to:
                    break
                subtrees.append(self.root[b])
                self.root[b] = Counter()
                left -= sizes[b]
        leaves: list[Counter] = []
        while subtrees:
            node = subtrees.pop()
            if isinstance(node, Counter):
                leaves.append(node)
            else:
                subtrees.extend(node)
        keys = b"".join(k for leaf in leaves for k in leaf)
        counts = np.fromiter((n for leaf in leaves for n in leaf.values()), np.uint64)
        if len(counts):
            yield np.frombuffer(keys, np.uint64).reshape(-1, self.size), counts


def prefix_part(phrases: np.ndarray, parts: int) -> np.ndarray:
    """Prefix partition of phrases: by their first words, two at least and the last only if it is one of these."""
    total = phrases[:, 0]
    for k in range(1, max(2, phrases.shape[1] - 1)):
        total = mixed(total) + phrases[:, k]
    return ((mixed(total) >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def runs(lang: str, phrases: np.ndarray, counts: np.ndarray, parts: int) -> Iterator[tuple]:
    """Rows of ``RUNS``: a sorted run per prefix partition."""
    part = prefix_part(phrases, parts)
    order = np.lexsort([*phrases.T[::-1], part])
    part, phrases, counts = part[order], phrases[order], counts[order]
    edges = [*np.flatnonzero(np.diff(part.astype(np.int64), prepend=-1)).tolist(), len(part)]
    for a, b in zip(edges, edges[1:], strict=False):
        yield lang, phrases.shape[1], int(part[a]), phrases[a:b].tobytes(), counts[a:b].tobytes()


def merged(phrases: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases and their counts together, those of ``least`` or more."""
    order = np.lexsort(phrases.T[::-1])
    phrases = phrases[order]
    new = np.ones(len(phrases), bool)
    new[1:] = (phrases[1:] != phrases[:-1]).any(axis=1)
    firsts = np.flatnonzero(new)
    totals = np.add.reduceat(counts[order], firsts)
    often = totals >= np.uint64(least)
    return phrases[firsts[often]], totals[often]


def language_key(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode()))


def filter_keys(lang: str, phrases: np.ndarray) -> np.ndarray:
    """What a Bloom filter holds of phrases (rows of word ids)."""
    total = mixed(phrases[:, 0] + language_key(lang))
    for k in range(1, phrases.shape[1]):
        total = mixed(total * np.uint64(FACTOR) + phrases[:, k])
    return total


def probes(keys: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The places of keys among ``bits`` (a power of two), a column per probe."""
    step = mixed(keys + MIX) | np.uint64(1)
    for k in range(PROBES):
        yield (keys + np.uint64(k) * step) & np.uint64(bits - 1)


class Filter:
    """A Bloom filter read from the folder that :func:`write_filter` wrote."""

    def __init__(self, folder: str, bits: int):
        self.bits, self.marks = bits, np.zeros(bits // 8, np.uint8)
        system, inner = file_system(folder)
        for info in system.get_file_info(pafs.FileSelector(inner)):
            if info.path.endswith(".parquet"):
                table = pq.read_table(info.path, filesystem=system, use_threads=False)
                for segment, marks in zip(table["segment"].to_pylist(), table["spots"].to_pylist(), strict=True):
                    at = segment * SEGMENT_BITS // 8
                    self.marks[at : at + len(marks)] = np.frombuffer(marks, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for spots in probes(keys, self.bits):
            out &= (self.marks[spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return out


_FILTERS: dict[str, Filter] = {}


def filter_of(where: tuple[str, int]) -> Filter:
    """The worker's copy of a filter; only the last two are kept."""
    if where[0] not in _FILTERS:
        while len(_FILTERS) > 1:
            _FILTERS.pop(next(iter(_FILTERS)))
        _FILTERS[where[0]] = Filter(*where)
    return _FILTERS[where[0]]


def write_filter(frequent: DataFrame, size: int) -> tuple[str, int]:
    """Write a Bloom filter of ``frequent`` (lang, ids of ``size`` words); returns its folder and bits."""
    spark = frequent.sparkSession
    bits = 1 << max(10, min(FILTER_BITS.bit_length() - 1, (16 * frequent.count()).bit_length()))
    segment_bits = min(bits, SEGMENT_BITS)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            lang = batch.column(0).dictionary_encode()
            for code, name in enumerate(lang.dictionary.to_pylist()):
                ids = batch.column(1).filter(pc.equal(lang.indices, code)).flatten().to_numpy(zero_copy_only=False)
                found += probes(filter_keys(name, ids.view(np.uint64).reshape(-1, size)), bits)
            spots = np.unique(np.concatenate(found))
            segment = (spots // np.uint64(segment_bits)).astype(np.int64)
            edges = [*np.flatnonzero(np.diff(segment, prepend=-1)).tolist(), len(segment)]
            inner = (spots % np.uint64(segment_bits)).astype(np.uint32)
            yield rows(
                [(int(segment[a]), inner[a:b].tobytes()) for a, b in zip(edges, edges[1:], strict=False)], MARKS_ARROW
            )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, marks = None, None
        for batch in batches:
            for s, spots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != segment:
                    if marks is not None:
                        yield rows([(segment, np.packbits(marks, bitorder="little").tobytes())], MARKS_ARROW)
                    segment, marks = s, np.zeros(segment_bits, np.uint8)
                marks[np.frombuffer(spots, np.uint32)] = 1
        if marks is not None:
            yield rows([(segment, np.packbits(marks, bitorder="little").tobytes())], MARKS_ARROW)

    folder = fresh_path(spark, f"filter_{size}")
    spots = frequent.select("lang", "ids").mapInArrow(mark, MARKS)
    spots.repartition("segment").sortWithinPartitions("segment").mapInArrow(gather, MARKS).write.parquet(folder)
    return folder, bits


def phrases_at(ids: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` word ids from each of ``places``, a row each."""
    return np.stack([ids[places + k] for k in range(size)], axis=1)


def count_phrases(
    docs: DataFrame, sizes: tuple[int, ...], inner: int, known: tuple[str, int], seed: int, least: int, parts: int, tasks: int
) -> DataFrame:
    """lang, size, ids, n of the phrases of ``sizes`` words that occur ``least`` times.

    Only phrases are counted whose every run of ``inner`` words is in the filter ``known``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tries = Words(seed), {}

        def spilled(down_to: int) -> Iterator[pa.RecordBatch]:
            for (lang, _), trie in tries.items():
                for phrases, counts in trie.spill(down_to * len(trie) // max(1, held)):
                    yield rows(list(runs(lang, phrases, counts, parts)), RUNS_ARROW)

        held = 0
        for lang, data, firsts in by_language(batches):
            _, _, _, ids, pieces = words.split(data, firsts)
            some = np.arange(max(0, len(ids) - inner + 1))
            some = some[pieces[some] == pieces[some + inner - 1]]
            often = np.zeros(len(ids), bool)
            often[some] = filter_of(known).has(filter_keys(lang, phrases_at(ids, some, inner)))
            for size in sizes:
                places = np.arange(max(0, len(ids) - size + 1))
                right = pieces[places] == pieces[places + size - 1]
                for k in range(size - inner + 1):
                    right &= often[places + k]
                trie = tries.setdefault((lang, size), Trie(size))
                trie.add(phrases_at(ids, places[right], size))
            held = sum(map(len, tries.values()))
            if held > PHRASES_HELD:
                yield from spilled(PHRASES_HELD // 2)
        yield from spilled(0)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, size, _), phrases, counts in partwise(batches):
            phrases, counts = merged(phrases, counts, least)
            if len(counts):
                lists = pa.ListArray.from_arrays(
                    np.arange(0, phrases.size + 1, size, dtype=np.int32), pa.array(phrases.ravel().view(np.int64))
                )
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n), pa.array([size] * n, pa.int32()), lists, pa.array(counts.astype(np.int64))],
                    schema=COUNTS_ARROW,
                )

    order = ["lang", "size", "part"]
    dealt = docs.mapInArrow(count, RUNS).repartition(tasks, *order).sortWithinPartitions(*order)
    return dealt.mapInArrow(merge, COUNTS)


def partwise(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], np.ndarray, np.ndarray]]:
    """((lang, size, part), phrases, counts) of rows of runs sorted by these."""
    key, ids, counts = None, [], []

    def whole():
        phrases = np.frombuffer(b"".join(ids), np.uint64).reshape(-1, key[1])
        return key, phrases, np.frombuffer(b"".join(counts), np.uint64)

    for batch in batches:
        for lang, size, part, own, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != (lang, size, part):
                if ids:
                    yield whole()
                key, ids, counts = (lang, size, part), [], []
            ids.append(own)
            counts.append(n)
    if ids:
        yield whole()


def count_frequent(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases of 1 to ``longest`` words (lang, size, ids, n), frequent words (lang, id, word) and totals (lang, total)."""
    spark = docs.sparkSession
    docs = spoken(docs)
    words, seed = vocabulary(docs, min_count)
    frequent = words.where(F.col("id").isNotNull())
    totals = words.where(F.col("id").isNull()).select("lang", F.col("n").alias("total"))
    counts = frequent.select("lang", F.lit(1).alias("size"), F.array("id").alias("ids"), "n")
    every = totals.agg(F.sum("total")).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(1 << 31, max(PARTS_PER_PARTITION * tasks, every // ENTRIES_PER_PART))
    tasks = max(tasks, parts // PARTS_PER_PARTITION)
    found = counts
    for inner, sizes in ((1, (2,)), (2, tuple(range(3, longest + 1)))):
        if sizes and sizes[-1] <= longest:
            known = write_filter(found, inner)
            found = materialize(
                count_phrases(docs, sizes, inner, known, seed, min_count, parts, tasks), f"phrases_{sizes[-1]}"
            )
            counts = counts.unionByName(found)
    return counts, frequent.select("lang", "id", "word"), totals


def scored(counts: DataFrame) -> DataFrame:
    """lang, size, ids, a, l, r, score of phrases of two words and more, at their worst cut."""
    candidates = counts.where("size > 1").select("lang", "size", "ids", F.col("n").alias("a"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    left = counts.select("lang", F.col("ids").alias("first"), F.col("n").alias("l"))
    right = counts.select("lang", F.col("ids").alias("rest"), F.col("n").alias("r"))
    cuts = cuts.select(
        "*", F.slice("ids", 1, F.col("k")).alias("first"), F.slice("ids", F.col("k") + 1, F.col("size") - F.col("k")).alias("rest")
    )
    score = F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + r)")
    return (
        cuts.join(left, ["lang", "first"])
        .join(right, ["lang", "rest"])
        .select("lang", "size", "ids", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut"))
        .groupBy("lang", "size", "ids", "a")
        .agg(F.min("cut").alias("cut"))
        .select("lang", "size", "ids", "a", "cut.l", "cut.r", "cut.score")
    )


def not_inside_longer(candidates: DataFrame, counts: DataFrame, share: int, longest: int) -> DataFrame:
    """``candidates`` without those of which a longer phrase holds ``share`` percent or more."""
    longer = counts.where("size > 2")

    def inner(size: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.col("size") - size + 1, F.lit(1)))
        return F.when(F.col("size") > size, F.transform(places, lambda i: F.slice("ids", i, size)))

    if longest < 3:
        return candidates
    every = F.flatten(F.array_compact(F.array(*map(inner, range(2, longest)))))
    most = (
        longer.select("lang", F.explode(F.array_distinct(every)).alias("ids"), "n")
        .groupBy("lang", "ids")
        .agg(F.max("n").alias("inside"))
    )
    held = F.col("inside").isNotNull() & (
        F.col("inside").cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * share
    )
    return candidates.join(most, ["lang", "ids"], "left").where(~held).drop("inside")


def spelled(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``phrases`` with their words, joined by blanks, as ``phrase``."""
    said = (
        phrases.select("lang", "ids", F.posexplode("ids").alias("place", "id"))
        .join(words, ["lang", "id"])
        .groupBy("lang", "ids")
        .agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("said"))
        .select("lang", "ids", F.array_join(F.transform("said", lambda s: s["word"]), " ").alias("phrase"))
    )
    return phrases.join(said, ["lang", "ids"])


def collocations(
    docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, share: int = SHARE, top: int | None = TOP
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of every language, or all with ``top`` None."""
    counts, words, totals = count_frequent(docs, min_count, longest)
    found = not_inside_longer(scored(counts), counts, share, longest)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = spelled(found, words).withColumn("share", F.pmod(F.xxhash64("ids"), F.lit(SHARES)))
    if top is not None:  # the best of each share first, so that no task ranks all phrases of a language
        best = F.row_number().over(W.partitionBy("lang", "share").orderBy(*order))
        ranked = ranked.withColumn("rank", best).where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang",
        F.col("rank").cast("long").alias("rank"),
        "phrase",
        "a",
        "l",
        "r",
        F.col("total").alias("n"),
        F.col("score").cast("long").alias("score"),
    )
