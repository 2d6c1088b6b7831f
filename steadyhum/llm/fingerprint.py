"""Document fingerprints: a Merkle tree over sections, paragraphs, sentences and pieces.

A paragraph is a line, a sentence ends at ``.``, ``!`` or ``?`` before a blank. A sentence of up
to ``LONG`` characters is one piece. Longer ones (code, lists, scripts without these marks) are
cut into pieces by content: they are read as units (a word with the character after it, any
other single character), and a piece ends after a unit where a hash of it and the three before
says so, every 32nd on average, at ``MOST_UNITS`` units at the latest. Pieces are hashed, a sentence
hashes its piece hashes, a paragraph its sentence hashes, a section its paragraph hashes, the root
the section hashes. Sections too end where a paragraph's hash says so, not after a fixed count,
so an inserted paragraph disturbs its own section only.

The fingerprint is one string, ``root:tree``. The root (64 hex digits) is equal exactly when
the texts are. In the tree, a piece is the first 8 hex digits of its hash, ``,`` closes a
paragraph and ``;`` a section, so two fingerprints alone show which branches differ.
Everything is column expressions; a row never leaves its task for its fingerprint.

Defined results: a null text counts as empty; the empty text is one empty sentence; equal
texts have equal fingerprints, however often they repeat. For neighbours, ids repeated in the
table are one document (the neighbour sees the smallest of their texts) and null ids come
first; in a table of one id a document is its own neighbour. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scale import materialize
from .common import texts

SENTENCE_END = r"(?<=[.!?]) "
SECTION_CLOSERS = "0123"  # a paragraph whose hash begins so closes its section: every fourth
LEAF_DIGITS = 8
LONG = 256
PIECE_UNITS = 32
MOST_UNITS = 256
# Runs of more than 24 letters are no words; they are cut after vowels, or without these after 24 letters.
UNIT = r"(?s)[A-Za-z]{1,24}+(?![A-Za-z])[^A-Za-z]?|[A-Za-z]{0,23}?[AEIOUaeiou]|[A-Za-z]{1,24}+|[^A-Za-z]"


def pieces(sentence: Column) -> Column:
    """The pieces of a sentence, in order; joined they are the sentence."""

    def cut(units: Column) -> Column:
        n = F.size(units)

        def closes(i: Column) -> Column:  # the units of a window are told apart by their place
            return F.pmod(F.xxhash64(*[F.get(units, i - k) for k in (1, 2, 3, 4)]), F.lit(PIECE_UNITS)) == 0

        def capped(ends: Column) -> Column:
            def steps(end: Column, j: Column) -> Column:
                begin = F.coalesce(F.get(ends, j - 1), F.lit(0))
                forced = F.sequence(begin + MOST_UNITS, end, F.lit(MOST_UNITS))
                return F.when(end - begin > MOST_UNITS, F.array_union(forced, F.array(end))).otherwise(F.array(end))

            return F.flatten(F.transform(ends, steps))

        def joined(ends: Column) -> Column:
            def piece(end: Column, j: Column) -> Column:
                begin = F.coalesce(F.get(ends, j - 1), F.lit(0))
                return F.array_join(F.slice(units, begin + 1, end - begin), "")

            return F.transform(ends, piece)

        natural = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | closes(i))
        # The arrays keep what they hold from being computed again for every element.
        ends = F.transform(F.array(natural), capped)[0]
        return F.transform(F.array(ends), joined)[0]

    units = F.regexp_extract_all(sentence, F.lit(UNIT), F.lit(0))
    return F.when(F.length(sentence) > LONG, F.transform(F.array(units), cut)[0]).otherwise(F.array(sentence))


def fingerprint(text: Column) -> Column:
    """The fingerprint string of a non-null text."""

    def paragraph(line: Column) -> Column:
        hashes = F.transform(
            F.split(line, SENTENCE_END, -1), lambda s: F.transform(pieces(s), lambda p: F.sha2(p, 256))
        )
        return F.transform(
            F.array(hashes),
            lambda of: F.struct(
                F.sha2(F.array_join(F.transform(of, lambda h: F.sha2(F.array_join(h, ""), 256)), ""), 256).alias("hash"),
                F.array_join(F.transform(F.flatten(of), lambda h: F.left(h, F.lit(LEAF_DIGITS))), "").alias("leaves"),
            ),
        )[0]

    def closed(p: Column, field: str) -> Column:
        closes = F.lit(SECTION_CLOSERS).contains(F.left(p["hash"], F.lit(1)))
        return F.concat(p[field], F.when(closes, ";").otherwise(","))

    # The struct keeps the paragraphs from being hashed once for the root and once for the tree.
    tree = F.transform(F.array(F.transform(F.split(text, "\n", -1), paragraph)), lambda ps: _joined(ps, closed))[0]
    return tree


def _joined(paragraphs: Column, closed) -> Column:
    nodes = F.array_join(F.transform(paragraphs, lambda p: closed(p, "hash")), "")
    leaves = F.array_join(F.transform(paragraphs, lambda p: closed(p, "leaves")), "")
    sections = F.transform(F.split(nodes, ";", -1), lambda s: F.sha2(s, 256))
    return F.concat(F.sha2(F.array_join(sections, ""), 256), F.lit(":"), leaves)


def root(print_: Column) -> Column:
    return F.substring_index(print_, ":", 1)


def leaves(print_: Column) -> Column:
    """The distinct leaves of a fingerprint."""
    found = F.regexp_extract_all(F.substring_index(print_, ":", -1), F.lit(f"[0-9a-f]{{{LEAF_DIGITS}}}"), F.lit(0))
    return F.array_distinct(found)


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints: 1 for equal roots, else twice the shared leaves over all leaves."""
    x, y = leaves(a), leaves(b)
    shared = F.size(F.array_intersect(x, y))
    return F.when(root(a) == root(b), F.lit(1.0)).otherwise(2.0 * shared / (F.size(x) + F.size(y)))


def changed_branches(a: Column, b: Column) -> Column:
    """Where two fingerprints differ: (section, paragraph) of ``a``, counted from 0, that ``b`` lacks."""
    other = F.split(F.translate(F.substring_index(b, ":", -1), ";", ","), ",", -1)
    parts = F.split(F.substring_index(a, ":", -1), ";", -1)
    numbered = F.transform(
        parts,
        lambda s, i: F.transform(
            F.split(F.rtrim(s, F.lit(",")), ",", -1),
            lambda p, j: F.struct(i.alias("section"), j.alias("paragraph"), p.alias("leaves")),
        ),
    )
    lacking = F.filter(F.flatten(numbered), lambda n: (n["leaves"] != "") & ~F.array_contains(other, n["leaves"]))
    return F.transform(lacking, lambda n: F.struct(n["section"], n["paragraph"]))


def changed_pieces(a: Column, b: Column) -> Column:
    """Where two fingerprints differ: (section, paragraph, piece) of ``a``, counted from 0, whose leaf ``b`` lacks."""
    sections = F.split(F.substring_index(a, ":", -1), ";", -1)

    def found(section: Column, i: Column) -> Column:
        def inside(paragraph: Column, j: Column) -> Column:
            cut = F.regexp_extract_all(paragraph, F.lit(f"[0-9a-f]{{{LEAF_DIGITS}}}"), F.lit(0))
            return F.transform(
                cut,
                lambda leaf, k: F.struct(i.alias("section"), j.alias("paragraph"), k.alias("piece"), leaf.alias("leaf")),
            )

        return F.flatten(F.transform(F.split(F.rtrim(section, F.lit(",")), ",", -1), inside))

    numbered = F.flatten(F.transform(sections, found))
    lacking = F.transform(
        F.array(leaves(b)), lambda other: F.filter(numbered, lambda n: ~F.array_contains(other, n["leaf"]))
    )[0]
    return F.transform(lacking, lambda n: F.struct(n["section"], n["paragraph"], n["piece"]))


def neighbours(docs: DataFrame) -> DataFrame:
    """Per distinct doc_id: doc_id, next_id (ascending, the last is followed by the first), n_chars.

    Only ids and lengths move. Ids are cut into ranges, each range finds its successors by
    itself, and the last id of a range takes the first of the following one.
    """
    ids = texts(docs).groupBy("doc_id").agg(F.max(F.length("text")).alias("n_chars"))
    ranged = materialize(
        ids.repartitionByRange(F.asc_nulls_first("doc_id")).withColumn("part", F.spark_partition_id()), "id_ranges"
    )
    inside = W.partitionBy("part").orderBy(F.asc_nulls_first("doc_id"))
    first = ranged.groupBy("part").agg(
        F.min("doc_id").alias("low"), F.max(F.col("doc_id").isNull()).alias("has_null")
    )  # one row per range
    first = first.select("part", F.when(~F.col("has_null"), F.col("low")).alias("first_id"))
    order = W.orderBy("part")
    following = first.select(
        "part",
        F.lead("part").over(order).alias("next_part"),
        F.first("part").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("first_part"),
    ).select("part", F.coalesce("next_part", "first_part").alias("next_part"))
    jump = following.join(
        first.select(F.col("part").alias("next_part"), F.col("first_id").alias("jump_id")), "next_part"
    ).select("part", "jump_id")
    placed = ranged.select(
        "part",
        "doc_id",
        "n_chars",
        F.lead("doc_id").over(inside).alias("next_id"),
        F.lead(F.lit(True)).over(inside).isNull().alias("is_last"),
    )
    return placed.join(F.broadcast(jump), "part").select(  # as many rows as ranges
        "doc_id", F.when(F.col("is_last"), F.col("jump_id")).otherwise(F.col("next_id")).alias("next_id"), "n_chars"
    )


def edited_prints(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text ends in the beginning of the next document instead of its own last quarter.
    A document sends its predecessor only as much text as that one needs, and its fingerprint.
    """
    near = materialize(neighbours(docs), "neighbours")
    back = near.select(
        F.col("next_id").alias("doc_id"), F.col("doc_id").alias("prev_id"), F.floor(F.col("n_chars") / 4).alias("need")
    )
    prints = texts(docs).withColumn("fingerprint", fingerprint(F.col("text")))
    asked = back.select(F.col("doc_id").alias("own_id"), "prev_id", "need")
    sent = (
        prints.join(asked, prints.doc_id.eqNullSafe(asked.own_id))
        .groupBy("prev_id")
        .agg(F.min(F.struct(F.left("text", F.col("need").cast("int")).alias("head"), "fingerprint")).alias("next"))
    )
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.left("text", n - cut), F.left("next.head", cut))
    joined = prints.join(sent, prints.doc_id.eqNullSafe(sent.prev_id), "left")
    full = joined.select(
        "doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", F.col("next.fingerprint").alias("after")
    )
    told = full.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        "after",
    )
    return told.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("after")).alias("near_next"),
    )
