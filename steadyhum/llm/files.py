"""Binary files on whatever file system the shared folder is on, written by tasks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

from pyarrow import fs as pafs

GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a URI or absolute path, Hadoop's ``file:/x`` included."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


class TaskFile:
    """A file of one attempt of a task, under a name of its own.

    ``path`` belongs into the rows that the task returns. Spark keeps the rows of one attempt only, so
    an index never names a file of another attempt, whatever order rows came in or however often a
    task ran; files of other attempts are never read.
    """

    def __init__(self, folder: str, stem: str, suffix: str = ""):
        name = f"{stem}-{uuid.uuid4().hex}{suffix}"
        self.path = f"{folder}/{name}"
        self.fs, inner = file_system(folder)
        self.fs.create_dir(inner, recursive=True)
        self.inner = f"{inner}/{name}"
        self.stream = self.fs.open_output_stream(self.inner, compression=None)  # else a name in .gz compresses
        self.position = 0

    def write(self, data: bytes) -> int:
        """Append ``data``; returns where it begins."""
        at = self.position
        self.stream.write(data)
        self.position += len(data)
        return at

    def close(self) -> None:
        self.stream.close()

    def abort(self) -> None:
        self.stream.close()
        self.fs.delete_file(self.inner)


def read_ranges(
    path: str, ranges: Iterable[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES
) -> Iterator[bytes]:
    """Bytes of every (offset, length), which must ascend.

    Neighbouring ranges, up to ``gap`` bytes apart, are fetched by one read of up to ``most`` bytes.
    """
    system, inner = file_system(path)
    with system.open_input_file(inner) as f:

        def fetch(group: list[tuple[int, int]]) -> Iterator[bytes]:
            low = group[0][0]
            high = max(o + n for o, n in group)
            data = f.read_at(high - low, low)
            if len(data) != high - low:
                raise ValueError(f"{path} ends before byte {high}")
            for o, n in group:
                yield data[o - low : o - low + n]

        group: list[tuple[int, int]] = []
        end = 0
        for offset, length in ranges:
            if group and (offset > end + gap or max(end, offset + length) - group[0][0] > most):
                yield from fetch(group)
                group = []
            end = max(end, offset + length) if group else offset + length
            group.append((offset, length))
        if group:
            yield from fetch(group)
