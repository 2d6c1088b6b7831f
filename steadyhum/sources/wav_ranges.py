"""WAV files of any size, read by byte ranges.

The header of a file says where its samples lie, so a range of samples is a range of bytes. Tasks read
the headers, ranges of a bounded number of samples are dealt over the cluster, and each is read and
decoded by itself: a file of a day is as many rows as it has ranges, and a task holds one range at a time.
Rows are the chunks of ``operators.chunked``: ``start`` counts the samples before them.

Files are opened by Arrow's file systems, from the paths that Spark lists. A file that cannot be decoded
is one row with the reason in ``error``, the same files as for ``sources.wav.decode_wav``. RF64, the
form for files over 4 GB, is read too.

``read_wav_chunks`` works on a table of paths, which may be as long as it likes. The data source
``wav_chunks`` does the same for a folder: its partitions are ranges, planned by the driver from the headers.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.files import file_system
from ..functions.scale import materialize
from .wav import pcm_to_float

RANGE_FRAMES = 1 << 20
RANGES_PER_TASK = 16
ROWS_PER_TASK = 1 << 14  # of ranges, however short
PLANNING_THREADS = 32

# The format codes of integer samples, plain and extensible, and the latter's sub-format.
PCM, EXTENSIBLE = 0x0001, 0xFFFE
PCM_GUID = bytes.fromhex("0100000000001000800000aa00389b71")

HEADER = "struct<sample_rate: int, channels: int, width: int, offset: long, n_frames: long, error: string>"
HEADER_ARROW = pa.struct(
    [
        ("sample_rate", pa.int32()),
        ("channels", pa.int32()),
        ("width", pa.int32()),
        ("offset", pa.int64()),
        ("n_frames", pa.int64()),
        ("error", pa.string()),
    ]
)


@dataclass(frozen=True)
class Header:
    sample_rate: int | None = None
    channels: int | None = None
    width: int | None = None
    offset: int | None = None
    n_frames: int | None = None
    error: str | None = None


def opened(path: str) -> pa.NativeFile:
    system, inner = file_system(path)
    return system.open_input_file(inner)


def parse_header(f: pa.NativeFile) -> Header:
    """Where the samples of a WAV file lie; raises ValueError if it is none."""
    size = f.size()
    if not size:
        return Header(error="empty file")
    head = f.read_at(min(12, size), 0)
    if len(head) < 12 or head[:4] not in (b"RIFF", b"RF64") or head[8:] != b"WAVE":
        raise ValueError("no RIFF header")
    at, form, long_size = 12, None, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", f.read_at(8, at))
        at += 8
        if name == b"ds64":
            long_size = struct.unpack("<QQ", f.read_at(16, at))[1]
        elif name == b"fmt ":
            body = f.read_at(min(length, 40), at)
            if len(body) < 16:
                raise ValueError("short format chunk")
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            if code == EXTENSIBLE:
                if len(body) < 40 or body[24:40] != PCM_GUID:
                    raise ValueError("unknown extended format")
            elif code != PCM:
                raise ValueError(f"unknown format: {code}")
            form = rate, channels, (bits + 7) // 8
        elif name == b"data":
            if form is None:
                raise ValueError("samples before their format")
            rate, channels, width = form
            if not channels or width not in (1, 2, 3, 4):
                raise ValueError(f"{channels} channels of {width} bytes")
            frame = channels * width
            length = long_size if long_size is not None and length == 0xFFFFFFFF else length
            there = min(length // frame * frame, size - at)
            if there % frame:
                raise ValueError("the last frame is cut off")
            error = None if there else "no samples"
            return Header(rate, channels, width, at, there // frame, error)
        at += length + length % 2
    raise ValueError("no samples chunk")


def header_of(path: str) -> Header:
    try:
        with opened(path) as f:
            return parse_header(f)
    except (OSError, ValueError, struct.error) as exc:
        return Header(error=f"not a readable wav: {exc}")


def read_range(f: pa.NativeFile, h: Header, start: int, n: int) -> np.ndarray:
    """Samples ``start`` to ``start + n``, mixed down to mono."""
    frame = h.channels * h.width
    raw = f.read_at(n * frame, h.offset + start * frame)
    if len(raw) != n * frame:
        raise OSError(f"the file ends before sample {start + n}")
    return pcm_to_float(raw, h.width).reshape(-1, h.channels).mean(axis=1).astype(np.float32)


def wav_headers(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with the columns of their headers; a few small reads per file, by tasks."""

    @F.arrow_udf(HEADER)
    def run(paths: pa.Array) -> pa.Array:
        return pa.array([vars(header_of(p)) for p in paths.to_pylist()], HEADER_ARROW)

    return files.withColumn("_h", run(F.col(path))).select("*", "_h.*").drop("_h")


def wav_ranges(files: DataFrame, path: str = "path", range_frames: int = RANGE_FRAMES) -> DataFrame:
    """A row per range of at most ``range_frames`` samples (``start``, ``n``), one with n = 0 for files with an error."""
    starts = F.sequence(F.lit(0), F.greatest(F.col("n_frames") - 1, F.lit(0)), F.lit(range_frames))
    starts = F.when(F.col("error").isNull(), starts).otherwise(F.array(F.lit(0).cast("long")))
    ranged = wav_headers(files, path).withColumn("start", F.explode(starts))
    n = F.least(F.lit(range_frames), F.col("n_frames") - F.col("start"))
    return ranged.withColumn("n", F.when(F.col("error").isNull(), n).otherwise(F.lit(0)).cast("long"))


def reading_tasks(ranges: DataFrame) -> int:
    """As many as shuffle partitions, and more where a task would have too many samples or too many ranges."""
    n, samples = ranges.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    partitions = int(ranges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(partitions, samples // (RANGES_PER_TASK * RANGE_FRAMES), n // ROWS_PER_TASK)


def runs_of(spots: list[tuple], order: list[int]) -> Iterator[list[int]]:
    """``order``, of (path, start, n, error), cut where ranges of a file do not adjoin or pass ``RANGE_FRAMES`` samples."""
    run, held = [], 0
    for i in order:
        path, start, n, error = spots[i]
        if run:
            before = spots[run[-1]]
            adjoins = error is None and before[3] is None and before[0] == path and before[1] + before[2] == start
            if not adjoins or held + n > RANGE_FRAMES:
                yield run
                run, held = [], 0
        run.append(i)
        held += n
    if run:
        yield run


def read_wav_chunks(files: DataFrame, path: str = "path", range_frames: int = RANGE_FRAMES) -> DataFrame:
    """``files`` with sample_rate, channels, start, samples (mono) and error, a row per range.

    The ranges, small rows, are written once and dealt over tasks in stretches of ``RANGE_FRAMES`` samples of a file,
    so neighbours among small ones are read at once; samples are not shuffled. A task holds one stretch or range at a time.
    """
    ranges = materialize(wav_ranges(files, path, range_frames), "wav_ranges")
    stretch = F.floor(F.col("start") / RANGE_FRAMES)
    dealt = ranges.repartition(reading_tasks(ranges), path, stretch).sortWithinPartitions(path, "start")
    kept = [*files.columns, "sample_rate", "channels", "start", "error"]
    schema = T.StructType([dealt.schema[c] for c in kept] + [T.StructField("samples", T.ArrayType(T.FloatType()))])

    def rows_of(batch: pa.RecordBatch, rows: list[int], lengths: list[int | None], parts: list[np.ndarray]) -> pa.RecordBatch:
        offsets = np.cumsum([0, *[n or 0 for n in lengths]]).astype(np.int32)
        gone = pa.array([n is None for n in lengths], pa.bool_())
        values = pa.array(np.concatenate([np.empty(0, np.float32), *parts]))
        samples = pa.ListArray.from_arrays(pa.array(offsets), values, mask=gone)
        picked = batch.take(pa.array(rows, pa.int64()))
        return pa.RecordBatch.from_arrays([*[picked.column(c) for c in kept], samples], names=[*kept, "samples"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, last = None, None
        for batch in batches:
            told = {c: batch.column(c).to_pylist() for c in (path, "start", "n", "error", "sample_rate", "channels", "width", "offset")}
            spots = list(zip(told[path], told["start"], told["n"], told["error"], strict=True))
            rows, lengths, parts, held = [], [], [], 0
            for stretch in runs_of(spots, sorted(range(len(spots)), key=lambda i: spots[i][:2])):
                i = stretch[0]
                name, start, _, error = spots[i]
                sizes = [spots[k][2] for k in stretch]
                if error is None:
                    if name != last:
                        if f is not None:
                            f.close()
                        f, last = opened(name), name
                    h = Header(*[told[c][i] for c in ("sample_rate", "channels", "width", "offset")])
                    if rows and held + sum(sizes) > RANGE_FRAMES:
                        yield rows_of(batch, rows, lengths, parts)
                        rows, lengths, parts, held = [], [], [], 0
                    parts.append(read_range(f, h, start, sum(sizes)))
                    held += sum(sizes)
                rows += stretch
                lengths += sizes if error is None else [None] * len(stretch)
            if rows:
                yield rows_of(batch, rows, lengths, parts)
        if f is not None:
            f.close()

    return dealt.mapInArrow(run, schema)


def write_wavs(files: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Write the bytes of every row below ``folder``, by tasks; returns ``files`` with ``path`` for ``content``.

    ``name`` may hold folders. Equal names must have equal bytes, as tasks that run twice do.
    """
    kept = [c for c in files.columns if c != content]
    schema = T.StructType([files.schema[c] for c in kept] + [T.StructField("path", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = file_system(folder)
        for batch in batches:
            paths = []
            for file, data in zip(batch.column(name).to_pylist(), batch.column(content), strict=True):
                system.create_dir(f"{inner}/{file}".rpartition("/")[0], recursive=True)
                with system.open_output_stream(f"{inner}/{file}", compression=None) as out:
                    out.write(data.as_buffer() if data.is_valid else b"")
                paths.append(f"{folder}/{file}")
            columns = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(paths, pa.string())], names=[*kept, "path"])

    return materialize(files.mapInArrow(run, schema), "written_files")


@dataclass
class WavRange(InputPartition):
    path: str
    header: Header
    start: int
    n: int


class WavChunks(DataSource):
    """``spark.read.format("wav_chunks")``: option ``path``, a folder or file; ``rangeFrames``, samples per row.

    Register it by ``register(spark)``. The driver lists the folder and reads the headers; for
    collections too large for that there is ``read_wav_chunks`` over an inventory table.
    """

    @classmethod
    def name(cls) -> str:
        return "wav_chunks"

    def schema(self) -> str:
        return "path string, sample_rate int, channels int, start long, samples array<float>, error string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return WavChunksReader(self.options, schema)


class WavChunksReader(DataSourceReader):
    def __init__(self, options, schema):
        self.root = options["path"]
        self.range_frames = int(options.get("rangeFrames", RANGE_FRAMES))

    def partitions(self) -> list[WavRange]:
        system, inner = file_system(self.root)
        prefix = self.root[: len(self.root) - len(inner)] if self.root.endswith(inner) else ""
        info = system.get_file_info(inner)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = system.get_file_info(pafs.FileSelector(inner, recursive=True)) if info.type == pafs.FileType.Directory else [info]
        paths = sorted(prefix + i.path for i in found if i.type == pafs.FileType.File and i.path.endswith(".wav"))
        with ThreadPoolExecutor(PLANNING_THREADS) as pool:
            headers = list(pool.map(header_of, paths))
        out = []
        for path, h in zip(paths, headers, strict=True):
            for start in [0] if h.error else range(0, h.n_frames, self.range_frames):
                out.append(WavRange(path, h, start, 0 if h.error else min(self.range_frames, h.n_frames - start)))
        return out or [WavRange("", Header(), 0, 0)]

    def read(self, partition: WavRange) -> Iterator[tuple]:
        h = partition.header
        if not partition.path:
            return
        data = None
        if h.error is None:
            with opened(partition.path) as f:
                data = read_range(f, h, partition.start, partition.n).tolist()
        yield partition.path, h.sample_rate, h.channels, partition.start, data, h.error


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavChunks)
