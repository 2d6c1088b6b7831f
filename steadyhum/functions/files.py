"""Files on whatever file system Spark's paths name."""

from __future__ import annotations

import os
import re
import uuid

from py4j.protocol import Py4JJavaError
from pyarrow import fs as pafs
from pyspark.sql import SparkSession


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system and inner path of what Spark calls ``path``: no escapes, ``file:/x`` and ``s3a:`` included."""
    scheme, authority, inner = re.match(r"(?:([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?)?(.*)", path, re.S).groups()
    if scheme in (None, "file"):
        return pafs.LocalFileSystem(), inner
    system, base = pafs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}://{authority or ''}/")
    return system, base.rstrip("/") + inner


def hadoop(spark: SparkSession, path: str):
    """Hadoop's file system and path object of ``path``."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of the entries of ``folder``; none if it does not exist."""
    system, target = hadoop(spark, folder)
    return [s.getPath().getName() for s in system.listStatus(target)] if system.exists(target) else []


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create ``path`` with ``text`` unless it exists; of several writers at a time one gets True.

    The text is written aside and moved in one step that fails if the name is taken: a link on local
    file systems, else Hadoop's rename without overwriting.
    """
    aside = f"{path}.{uuid.uuid4().hex}"
    system, target = hadoop(spark, aside)
    out = system.create(target)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        if system.getScheme() == "file":
            local, source = file_system(path)[1], file_system(aside)[1]
            try:
                os.link(source, local)
            except FileExistsError:
                return False
            return True
        return _renamed(spark, aside, path)
    finally:
        if system.exists(target):
            system.delete(target, False)


def _renamed(spark: SparkSession, source: str, to: str) -> bool:
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(to), none)
    except Py4JJavaError as exc:
        if "FileAlreadyExistsException" in str(exc.java_exception):
            return False
        raise
    return True
