"""Recording catalog: file scan, path parsing, reject report."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import file_system
from ..functions.scale import materialize

# The two recording conditions, and the metadata of loose files.
VALID_LABELS = ("normal", "abnormal")
LOOSE_MACHINE = "unknown"
LOOSE_LABEL = "normal"

CATALOG_COLUMNS = ["machine_type", "machine_id", "label", "filename", "relative_path"]


def scan_files(
    spark: SparkSession, root: str, extension: str = ".wav", with_content: bool = False
) -> DataFrame:
    """Every file below ``root`` with ``extension``: path, length, modificationTime[, content].

    A missing root raises when the plan is built. Without ``content`` no file is opened.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{extension}")
        .load(root)
    )
    return files if with_content else files.drop("content")


def list_files(spark: SparkSession, root: str, extension: str = ".wav") -> DataFrame:
    """The rows of ``scan_files``, listed by tasks: path, length, modificationTime.

    Directories are rows, too: each round lists those of one level, and what it finds is written, so the
    driver holds no path and a lost task lists its directories again. For trees too large for the driver.
    """
    schema = "path string, length long, modificationTime timestamp, is_folder boolean"
    fields = pa.schema(
        [("path", pa.string()), ("length", pa.int64()), ("modificationTime", pa.timestamp("us", "UTC")), ("is_folder", pa.bool_())]
    )
    system, inner = file_system(root)
    if system.get_file_info(inner).type == pafs.FileType.NotFound:
        raise FileNotFoundError(root)
    prefix = root[: len(root) - len(inner)] if root.endswith(inner) else ""
    prefix = prefix or "file:"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                system, inner = file_system(folder)
                found = [i for i in system.get_file_info(pafs.FileSelector(inner)) if not i.base_name.startswith((".", "_")) or "=" in i.base_name]
                folders = [i.type == pafs.FileType.Directory for i in found]
                kept = [(i, f) for i, f in zip(found, folders, strict=True) if f or i.base_name.endswith(extension)]
                columns = [[prefix + i.path for i, _ in kept], [None if f else i.size for i, f in kept], [i.mtime for i, _ in kept], [f for _, f in kept]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.types, strict=True)], schema=fields)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level, found = spark.createDataFrame([(root,)], "path string"), []
    while True:
        listed = materialize(level.repartition(tasks, "path").mapInArrow(run, schema), f"level_{len(found)}")
        found.append(listed.where(~F.col("is_folder")).drop("is_folder"))
        level = listed.where("is_folder").select("path")
        if level.isEmpty():
            return reduce(DataFrame.unionByName, found)


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``, or null when ``path`` is not below it.

    ``root`` may be a URI, a local path or relative to the working folder; ``.`` and ``..`` are resolved.
    """
    scheme, rest = re.match(r"([a-z][a-z0-9+.-]*:(?://[^/]*)?)?(.*)", root, re.S).groups()
    if scheme is None or scheme.startswith("file:"):
        scheme, rest = "", os.path.abspath(rest)
    base = scheme + "/" + os.path.normpath("/" + rest.lstrip("/")).strip("/") + "/"
    base = base.replace("//", "/") if not scheme else base
    local = F.regexp_replace(path, "^file:/+", "/")
    return F.when(F.startswith(local, F.lit(base)), F.substr(local, F.lit(len(base) + 1)))


def listed_files(manifest: DataFrame, root: str, extension: str = ".wav", path: str = "path") -> DataFrame:
    """The rows of a manifest below ``root`` with ``extension``, plus ``relative_path``.

    For collections too large to list from the driver: an inventory table takes the place of the scan.
    """
    below = manifest.withColumn("relative_path", relative_path(F.col(path), root))
    return below.where(F.col("relative_path").isNotNull() & F.endswith(F.col(path), F.lit(extension)))


def parse_paths(files: DataFrame, path: str = "relative_path") -> DataFrame:
    """Add machine_type, machine_id, label, filename and ``reject_reason`` (null = accepted).

    Convention: ``<machine_type>/<machine_id>/<label>/.../<filename>``.
    """
    parts = F.split(F.col(path), "/")
    reason = (
        F.when(F.col(path).isNull(), "not under root")
        .when(F.size(parts) < 4, "too few segments")
        .when(~F.get(parts, F.lit(2)).isin(*VALID_LABELS), "unknown label")
    )
    return files.select(
        "*",
        F.get(parts, F.lit(0)).alias("machine_type"),
        F.get(parts, F.lit(1)).alias("machine_id"),
        F.get(parts, F.lit(2)).alias("label"),
        F.element_at(parts, -1).alias("filename"),
        reason.alias("reject_reason"),
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("reject_reason").isNull()).drop("reject_reason")


def accepted_or_loose(parsed: DataFrame) -> DataFrame:
    """Keep rejected files too, as recordings of an unknown machine in normal condition."""
    loose = F.col("reject_reason").isNotNull()

    def pick(name: str, fallback: str) -> Column:
        return F.when(loose, F.lit(fallback)).otherwise(F.col(name)).alias(name)

    kept = [c for c in parsed.columns if c not in ("machine_type", "machine_id", "label", "reject_reason")]
    return parsed.select(
        *kept,
        pick("machine_type", LOOSE_MACHINE),
        pick("machine_id", LOOSE_MACHINE),
        pick("label", LOOSE_LABEL),
    )


def reject_report(parsed: DataFrame) -> DataFrame:
    """Skipped files counted by reason."""
    return (
        parsed.where(F.col("reject_reason").isNotNull())
        .groupBy(F.col("reject_reason").alias("reason"))
        .agg(F.count(F.lit(1)).alias("n_files"))
    )
