"""Web archives: records written by tasks, an index first, then coalesced reads of byte ranges.

Every record is a gzip member of its own, so a record can be read by its byte range alone. The
index has a row per record: file, offset, length, url, digest, page_id and type. Reading takes
any selection of index rows, sorts them by file and offset within the task, and fetches
neighbouring records by one read each.

Of pages with equal payloads (of ``least_bytes`` bytes or more) the one with the smallest id is
a response and the others are revisits that name it and carry no payload. Payload digests are
SHA-1 in base 32; responses are verified against them when read.

Defined results: null html is an empty payload; a null url gives a ``urn:page:`` target; null ids
are larger than any other and never the page referred to unless all are null, when all are
responses; rows that repeat the smallest id are all responses; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scale import fresh_path
from .files import TaskFile, read_ranges

DATE = "2000-01-01T00:00:00Z"
GZIP_LEVEL = 5
LEAST_BYTES = 0
CRLF = b"\r\n"
INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
INDEX_ARROW = pa.schema(
    [
        ("file", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
        ("url", pa.string()),
        ("digest", pa.string()),
        ("page_id", pa.int64()),
        ("record_type", pa.string()),
    ]
)
READ = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "target_uri string, payload binary"
)
READ_ARROW = pa.schema(
    [
        ("page_id", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("target_uri", pa.string()),
        ("payload", pa.binary()),
    ]
)
BYTES_AT_ONCE = 16 << 20


def base32_digest(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def build_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC record, not compressed."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + CRLF + CRLF


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and block of one record."""
    head, _, rest = record.partition(CRLF + CRLF)
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    n = int(headers["content-length"])
    if rest[n:] != CRLF + CRLF:
        raise ValueError("broken WARC record length")
    return headers, rest[:n]


def gzip_member(data: bytes, level: int = GZIP_LEVEL) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def gunzip_member(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """The record of a page; a revisit if ``refers_to`` is given."""
    target = quote(url, safe="%/:=&?~#+!$,;'@()*[]|{}^`\\\"<>") if url else f"urn:page:{page_id}"
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Page-Id", "" if page_id is None else str(page_id)),
        ("Payload-Length", str(len(payload))),
    ]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode()
    if refers_to is None:
        block += payload
    else:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("Refers-To-Page", str(refers_to)),
        ]
    return build_record([*headers, ("Content-Type", "application/http;msgtype=response")], block)


def with_references(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, payload, digest (hex) and refers_to, the page whose payload this one repeats.

    Digests are counted first, combined map-side; only repeated ones meet the pages again, in a
    join whose hot keys adaptive execution splits.
    """
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    repeated = (
        keyed.where(F.octet_length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & F.col("first_id").isNotNull())
        .select("digest", "first_id")
    )
    other = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return keyed.join(repeated, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(other, F.col("first_id")).alias("refers_to")
    )


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html); returns the index, itself in files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out = f"part-{TaskContext.get().partitionId():06d}", None
        try:
            for batch in batches:
                rows = []
                if out is None and batch.num_rows:
                    out = TaskFile(folder, name, ".warc.gz")
                    head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, name)), ("WARC-Date", DATE)]
                    out.write(gzip_member(build_record([*head, ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")))
                for page_id, url, payload, digest, refers_to in zip(*batch.columns, strict=True):
                    page_id, url, refers_to = page_id.as_py(), url.as_py(), refers_to.as_py()
                    digest = base32_digest(digest.as_py())
                    record = gzip_member(page_record(page_id, url, payload.as_py(), digest, refers_to))
                    kind = "response" if refers_to is None else "revisit"
                    rows.append((out.path, out.write(record), len(record), url, digest, page_id, kind))
                if rows:
                    columns = zip(zip(*rows, strict=True), INDEX_ARROW.types, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], schema=INDEX_ARROW)
        except BaseException:
            if out:
                out.abort()
            raise
        if out:
            out.close()

    place = f"{folder}/index"
    with_references(pages, least_bytes).mapInArrow(run, INDEX).write.mode("overwrite").parquet(place)
    return pages.sparkSession.read.schema(INDEX).parquet(place)


def read_archives(index: DataFrame) -> DataFrame:
    """Records of the selected ``index`` rows, parsed from the archives; see ``READ`` for the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spots = sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            out, held, at = [], 0, 0
            while at < len(spots):
                file, upto = spots[at][0], at
                while upto < len(spots) and spots[upto][0] == file:
                    upto += 1
                for member in read_ranges(file, [(o, n) for _, o, n in spots[at:upto]]):
                    out.append(parse_page(gunzip_member(member)))
                    held += len(out[-1][-1] or b"")
                    if held >= BYTES_AT_ONCE:
                        yield _batch(out)
                        out, held = [], 0
                at = upto
            if out:
                yield _batch(out)

    return index.select("file", "offset", "length").mapInArrow(run, READ)


def parse_page(record: bytes) -> tuple:
    """A row of ``READ``: the payload is null for revisits."""
    headers, block = parse_record(record)
    kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
    page = headers["page-id"]
    payload = None
    if kind == "response":
        payload = block.partition(CRLF + CRLF)[2]
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"page {page}: the payload does not match its digest")
    refers_to = headers.get("refers-to-page")
    return (
        int(page) if page else None,
        int(headers["payload-length"]),
        digest,
        kind,
        int(refers_to) if refers_to else None,
        headers["warc-target-uri"],
        payload,
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(zip(*rows, strict=True), READ_ARROW.types, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], schema=READ_ARROW)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives, read all records back, and give what they say of each page."""
    index = write_archives(pages, fresh_path(pages.sparkSession, "warc"))
    return read_archives(index).drop("payload", "target_uri")
