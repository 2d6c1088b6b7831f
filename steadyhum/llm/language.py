"""Language identification by compression.

A text is lower-cased and compressed once per language with zstandard, each time with that
language's raw-content dictionary: labelled text that the compressor may refer back to. The
language whose dictionary gives the fewest bytes is the prediction; when the runner-up needs
nearly as few the prediction is marked as rejected. A text is compressed in windows of 4096
bytes, all of them, so that a long text's own repetitions do not drown the dictionary.

Learning sees a bounded sample of labelled rows: of each language the ``rows_per_language`` rows that
come first by a hash of id and text, over the whole table, ``sample_chars`` code points from the
middle of each, and ``dictionary_bytes`` in all. Every language with a text has a dictionary, up to
``most_languages``, the most frequent ones. Predicting uses whole texts and only texts.

Defined results: a text that is null or has no letter is ``und`` with score 0 and is rejected;
ties go to the first language by name; without any labelled row all documents are ``und``;
repeated rows and null ids are learned from and predicted like any other row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import releasing, unused

ROWS_PER_LANGUAGE = 400
SAMPLE_CHARS = 300
DICTIONARY_BYTES = 110_000
MOST_LANGUAGES = 256
BIN_BITS = 12
LEVEL = 5
WINDOW_BYTES = 4096
MIN_MARGIN = 0.002
LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    """One raw-content dictionary per language, in the order of the names."""

    dictionaries: tuple[tuple[str, bytes], ...]
    level: int = LEVEL


def held_out(doc_id: Column) -> Column:
    """Every fourth document by the CRC of its id is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def draw_bin(draw: Column) -> Column:
    """The draw's bin, ascending with the draw."""
    return F.shiftright(draw, 64 - BIN_BITS) + (1 << (BIN_BITS - 1))


def learn(
    labelled: DataFrame,
    rows_per_language: int = ROWS_PER_LANGUAGE,
    sample_chars: int = SAMPLE_CHARS,
    dictionary_bytes: int = DICTIONARY_BYTES,
    most_languages: int = MOST_LANGUAGES,
) -> Model:
    """Model from ``labelled`` (doc_id, text, lang).

    The driver gets at most ``most_languages * rows_per_language`` samples of ``sample_chars``. Tasks cut
    each language to its first rows before they are shuffled, so a language of any size is no burden.
    """
    usable = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0))
    common = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not common:
        return Model(())
    middle = F.greatest(F.lit(1), F.floor((F.length("text") - sample_chars) / 2)).cast("int")
    drawn = usable.select(
        "lang",
        F.xxhash64("doc_id", "text").alias("draw"),
        F.substr("text", middle, F.lit(sample_chars)).alias("text"),
    )
    # The draws of a language are counted in bins, and only bins that hold its first rows are sorted.
    binned = usable.where(F.col("lang").isin([r.lang for r in common])).withColumn("bin", draw_bin(F.xxhash64("doc_id", "text")))
    counts = binned.groupBy("lang", "bin").count()
    before = F.sum("count").over(W.partitionBy("lang").orderBy("bin")) - F.col("count")
    last = counts.withColumn("before", before).where(F.col("before") < rows_per_language).groupBy("lang").agg(F.max("bin").alias("last"))
    reach = F.lit(-1)
    for r in last.collect():
        reach = F.when(F.col("lang") == r.lang, F.lit(r["last"])).otherwise(reach)
    place = F.row_number().over(W.partitionBy("lang").orderBy("draw", "text"))
    sample = (
        drawn.where(draw_bin(F.col("draw")) <= reach)
        .withColumn("place", place)
        .where(F.col("place") <= rows_per_language)
        .orderBy("lang", "place")
        .collect()
    )
    parts: dict[str, list[bytes]] = {}
    for r in sample:
        parts.setdefault(r.lang, []).append(r.text.lower().encode("utf-8", "replace"))
    return Model(tuple((lang, b"\n".join(own)[:dictionary_bytes]) for lang, own in sorted(parts.items())))


def predictor(model: Model):
    """A function from text to (language, score, relative margin)."""
    names = [lang for lang, _ in model.dictionaries]
    packers = []
    for _, data in model.dictionaries:
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=model.level)
        packers.append(
            zstandard.ZstdCompressor(
                dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False
            )
        )

    def predict(text: str | None) -> tuple[str, float, float]:
        if not names or not text or not LETTER.search(text):
            return "und", 0.0, 0.0
        data = text.lower().encode("utf-8", "replace")
        windows = [data[i : i + WINDOW_BYTES] for i in range(0, len(data), WINDOW_BYTES)]
        sizes = [sum(len(p.compress(w)) for w in windows) for p in packers]
        best = min(range(len(names)), key=sizes.__getitem__)
        if len(names) == 1:
            return names[0], 1.0, 1.0
        second = min(s for i, s in enumerate(sizes) if i != best)
        margin = (second - sizes[best]) / second
        # 0.5 for a tie, towards 1 as the runner-up needs more bytes than the winner
        return names[best], 0.5 + 0.5 * margin, margin

    return predict


def predict_language(docs: DataFrame, model: Model, min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with struct column ``language`` (lang_pred, score, margin, rejected), no shuffle.

    Only the text crosses to Python, where one at a time is a string; the model, some 110 kB per language, goes with the task.
    """
    out = "lang_pred string, score double, margin double, rejected boolean"

    @F.arrow_udf(out)
    @releasing
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predict = predictor(model)
        for batch in batches:
            rows = [predict(t.as_py()) for t in batch]
            langs, scores, margins = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [])
            rejected = [lang == "und" or margin < min_margin for lang, margin in zip(langs, margins, strict=True)]
            columns = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.StructArray.from_arrays(columns, names=["lang_pred", "score", "margin", "rejected"])

    return docs.withColumn(unused(docs, "language"), predicted(F.col("text")))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, margin, rejected of every row of ``docs``."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = learn(narrow.where(~held_out(F.col("doc_id"))))
    told = predict_language(narrow.select("doc_id", "text"), model)
    return told.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "language.lang_pred",
        "language.score",
        "language.margin",
        "language.rejected",
    )


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose language is rejected; all columns as they were."""
    model = learn(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where(~held_out(F.col("doc_id")))
    )
    name = unused(docs, "language")
    return predict_language(docs, model).where(~F.col(f"{name}.rejected")).drop(name)
