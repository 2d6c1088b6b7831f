"""Vector codes by product quantization, exact in integers.

Components become integers ``floor(scale * x)``; a vector is cut into equal consecutive parts, and
every part position has a codebook. Codebooks start as the parts of the vectors with the smallest
ids and move in rounds: each part is assigned to its nearest entry, then each entry becomes the
componentwise floor of its parts' mean.

Distances come from matrix products of float64 that are exact: integers are split into limbs so
short that no sum of products reaches 2^53, every pair of limbs is multiplied by BLAS, and the
products are put together in int64. The nearest entry is the first smallest. Batches whose
distances could pass int64 (components from about 2^29 for parts of 8) are computed with Python's
integers instead, with the same results; an error that does not fit a long raises.

Spark reads the vectors once per round; a task gives one row of sums per part position and entry,
exact up to 38 digits. The driver holds the codebooks and nothing else.

Defined results: rows whose vector is null, or holds null, NaN or infinite components, are
dropped; so are rows whose length is no positive multiple of the number of parts, or differs from
that of the kept row with the smallest id. Null ids come last, equal ids in the order of their
vectors. Repeated rows each count. With fewer rows than entries codebooks are smaller; an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scale import bounded_join, materialize

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
EXACT_BITS = 53
SAFE = 1 << 62
SUMS = "part int, entry int, count long, sums array<decimal(38,0)>"
SUMS_ARROW = pa.schema(
    [
        ("part", pa.int32()),
        ("entry", pa.int32()),
        ("count", pa.int64()),
        ("sums", pa.list_(pa.decimal128(38, 0))),
    ]
)


def to_integers(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): int64, or Python integers where int64 is too small."""
    scaled = np.floor(values.astype(np.float64) * scale)
    power_of_two = scale & (scale - 1) == 0  # else the product itself would be rounded
    if power_of_two and (not scaled.size or np.abs(scaled).max() < SAFE):
        return scaled.astype(np.int64)
    flat = [math.floor(scale * Fraction(float(x))) for x in values.ravel()]
    return np.array(flat, dtype=object).reshape(values.shape)


def limbs(x: np.ndarray, bits: int, count: int) -> list[np.ndarray]:
    """Float64 arrays whose sum, each shifted by its place times ``bits``, is ``x``; only the last is signed."""
    out = []
    for _ in range(count - 1):
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x = x >> bits
    return [*out, x.astype(np.float64)]


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def dot_products(a: np.ndarray, b: np.ndarray, bits: int | None = None) -> np.ndarray:
    """Exact ``a @ b`` of int64 arrays (the last two axes), if the results fit int64.

    ``bits`` is the length of a limb; by default the longest that keeps every sum of products
    below 2^53.
    """
    longest = (EXACT_BITS - max(1, a.shape[-1]).bit_length()) // 2
    bits = min(bits or longest, longest)
    na, nb = (max(1, -(-(largest(x).bit_length() + 1) // bits)) for x in (a, b))
    total = 0
    for i, x in enumerate(limbs(a, bits, na)):
        for j, y in enumerate(limbs(b, bits, nb)):
            total = total + ((x @ y).astype(np.int64) << (bits * (i + j)))
    return total


def nearest(parts: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, first of equals, and its squared distance.

    ``parts`` is (positions, rows, width), ``books`` (positions, entries, width).
    """
    width = parts.shape[-1]
    if parts.dtype == object or books.dtype == object or width * (largest(parts) + largest(books)) ** 2 >= SAFE:
        parts, books = parts.astype(object), books.astype(object)
        each = ((parts[:, :, None, :] - books[:, None, :, :]) ** 2).sum(axis=3)
    else:
        own, entry = (parts * parts).sum(axis=2), (books * books).sum(axis=2)
        each = own[:, :, None] - 2 * dot_products(parts, books.transpose(0, 2, 1)) + entry[:, None, :]
    codes = each.argmin(axis=2)
    return codes, np.take_along_axis(each, codes[:, :, None], axis=2)[:, :, 0]


def moved(parts: np.ndarray, codes: np.ndarray, entries: int) -> list[tuple[int, int, int, list[int]]]:
    """(position, entry, number of parts, componentwise sums) of every entry in use."""
    out = []
    exact = parts.astype(object) if largest(parts) * max(1, parts.shape[1]) >= SAFE else parts
    for p in range(parts.shape[0]):
        counts = np.bincount(codes[p], minlength=entries)
        order = np.argsort(codes[p], kind="stable")
        starts = np.cumsum(counts) - counts
        for e in np.flatnonzero(counts).tolist():
            rows = exact[p][order[starts[e] : starts[e] + counts[e]]]
            out.append((p, e, int(counts[e]), [int(s) for s in rows.sum(axis=0)]))
    return out


def in_parts(column: pa.Array, width: int, parts: int, scale: int) -> np.ndarray:
    """(positions, rows, width of a part) of a list column whose rows have ``width`` components each."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), parts, width // parts)
    return np.ascontiguousarray(to_integers(values, scale).transpose(1, 0, 2))


def usable(df: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> tuple[DataFrame, int]:
    """vec_id, vector and label of the rows to code, and the length of their vectors."""
    finite = F.forall(
        "vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")).cast("double"))
    )
    whole = (
        df.select(
            F.col(id_col).cast("long").alias("vec_id"),
            F.col(vector_col).alias("vector"),
            F.col(label_col).alias("label"),
        )
        .where((F.size("vector") > 0) & (F.size("vector") % parts == 0))
        .where(finite)
    )
    first = whole.orderBy(F.asc_nulls_last("vec_id"), "vector").select(F.size("vector").alias("n")).first()
    width = first.n if first else parts
    return whole.where(F.size("vector") == width), width


def first_books(kept: DataFrame, width: int, parts: int, entries: int, scale: int) -> np.ndarray:
    """Codebooks of the parts of the ``entries`` smallest ids: (positions, entries, width of a part)."""
    rows = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").collect()
    values = np.array([r.vector for r in rows], dtype=np.float64).reshape(len(rows), parts, width // parts)
    return np.ascontiguousarray(to_integers(values, scale).transpose(1, 0, 2))


def next_books(kept: DataFrame, books: np.ndarray, width: int, scale: int) -> np.ndarray:
    """Codebooks after one round over all rows; an entry that no part is assigned to stays."""
    parts, entries = books.shape[0], books.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], tuple[int, list[int]]] = {}
        for batch in batches:
            own = in_parts(batch.column(0), width, parts, scale)
            codes, _ = nearest(own, books)
            for p, e, n, sums in moved(own, codes, entries):
                m, before = total.get((p, e), (0, [0] * len(sums)))
                total[p, e] = (m + n, [a + b for a, b in zip(before, sums, strict=True)])
        rows = [(p, e, n, sums) for (p, e), (n, sums) in sorted(total.items())]
        columns = zip(zip(*rows, strict=True) if rows else [[]] * 4, SUMS_ARROW.types, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in columns], schema=SUMS_ARROW)

    found = (
        kept.select("vector")
        .mapInArrow(run, SUMS)
        .select("part", "entry", "count", F.posexplode("sums").alias("at", "value"))
        .groupBy("part", "entry", "at")
        .agg(F.sum("count").alias("n"), F.sum("value").alias("total"))
        .collect()  # a row per part position, entry and component, whatever the number of vectors
    )
    new = books.astype(object)
    for r in found:
        new[r.part, r.entry, r["at"]] = int(r.total) // r.n
    return new.astype(np.int64) if largest(new) < SAFE else new


def fit_books(
    kept: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> np.ndarray:
    books = first_books(kept, width, parts, entries, scale)
    for _ in range(rounds if books.shape[1] else 0):
        books = next_books(kept, books, width, scale)
    return books


def assign(kept: DataFrame, books: np.ndarray, width: int, scale: int = SCALE) -> DataFrame:
    """vec_id, label, code (array of entry numbers in part order) and error of every row."""
    parts = books.shape[0]
    label = kept.schema["label"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, errors = nearest(in_parts(batch.column(1), width, parts, scale), books)
            total = [int(e) for e in errors.sum(axis=0)]
            lists = pa.ListArray.from_arrays(
                np.arange(0, codes.size + 1, parts, dtype=np.int32), pa.array(codes.T.ravel().astype(np.int32))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), lists, pa.array(total, pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    return kept.select("vec_id", "vector", "label").mapInArrow(
        run, f"vec_id long, label {label.simpleString()}, code array<int>, error long"
    )


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components in order of part, entry and component."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def compress(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> tuple[DataFrame, np.ndarray]:
    """Codes (vec_id, label, code, error) of the usable rows of ``df``, and the fitted codebooks."""
    kept, width = usable(df, id_col, vector_col, label_col, parts)
    books = fit_books(kept, width, parts, entries, rounds, scale)
    return assign(kept, books, width, scale), books


def decompress(codes: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``codes`` with column ``vector``: the coded entries joined and divided by ``scale``."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(int(x) / scale) for x in e]) for e in book]) for book in books])
    return codes.withColumn(
        "vector", F.flatten(F.transform("code", lambda c, i: F.get(F.get(entries, i), c)))
    )


def code_report(df: DataFrame) -> DataFrame:
    """vec_id, code as hex, error, the errors of the row's label together, and a digest of the codebooks."""
    codes, books = compress(df)
    coded = materialize(
        codes.select(
            "vec_id",
            F.concat_ws("", F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))).alias("code"),
            "error",
            F.col("label").isNull().alias("no_label"),
            F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label_key"),
        ),
        "vector_codes",
    )
    keys = ["no_label", "label_key"]
    sums = materialize(coded.groupBy(*keys).agg(F.sum("error").alias("label_error")), "label_errors")
    size = F.octet_length("label_key") + 17
    joined = bounded_join(coded, sums, keys, [F.col("vec_id"), F.col("code")], size)
    return joined.select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )
