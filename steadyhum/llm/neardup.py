"""Near-duplicate documents by b-bit MinHash, linked documents forming components.

1. One pass over the texts gives each document its number of distinct shingles, a 128-bit key of
   its whole shingle set, 24 band keys of 4 full minima each, and a signature of 2 mixed bits
   of each of 384 minima in twelve longs.
2. Documents with the same set are one class. Only classes go on, so thousands of copies cost
   one row per task, whatever share of the corpus they are.
3. Classes that share a band key are candidates. Pairs within a bucket are never enumerated:
   everything in a bucket is paired with one member of it, the pivot: first the member with the
   most neighbours in all its buckets, which is near the middle of its group, then members
   picked by hash. Four such rounds join what belongs together; what is left are buckets that still hold
   different components, and there the rows outside the bucket's largest component meet the
   others in a join whose condition keeps only pairs that the signatures let pass.
4. The signatures estimate the similarity by counting equal groups of bits, corrected for the
   share that agrees by chance. Pairs well below the threshold (four standard deviations) go.
5. The others are confirmed on the full shingle sets of both texts; the texts of classes that share
   a bucket are written once for that. Confirmed links are contracted to components after every
   round, and pairs inside a component are not tested.

Two texts at the very threshold of 0.85 miss all bands with a probability of 2e-8 and the
estimate with some 1e-4 (in a simulation 0 to 8 of 100,000 pairs of 7 to 20 shingles), more similar
ones far less often. Every other step is exact up to collisions of 64-bit shingle hashes.

Defined results: a null text counts as empty; texts without words have 0 shingles and link with
nothing; a text of fewer than five words has one shingle, all of it; rows that share a doc_id
are one document and get one component; a row without a doc_id links with nothing, has no
component and is kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scale import bounded_join, materialize
from . import shingles
from .common import releasing, text_slices, texts, unused

PERCENT = 85
SIGMAS = 4.0
SKETCH = "doc_id long, n_shingles long, key_1 long, key_2 long, bands array<long>, signature array<long>"
PIVOT_SALTS = (0x5DEECE66D1234567, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85)  # each orders the members of a bucket anew


def sketch(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_shingles, key_1, key_2, bands, signature; keys are null without shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, [1]):
            sets = shingles.sets_of(batch.column(1).cast(pa.binary()).to_pylist())
            keys, bands, signatures = [], [], []
            for s in sets:
                if not len(s):
                    keys.append((None, None))
                    bands.append(None)
                    signatures.append(None)
                    continue
                keys.append(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist())
                best = shingles.minima(s)
                bands.append(shingles.band_keys(best))
                signatures.append(shingles.packed_signature(best))
            first, second = zip(*keys, strict=True) if keys else ((), ())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(first, pa.int64()),
                    pa.array(second, pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(signatures, pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "key_1", "key_2", "bands", "signature"],
            )

    return texts(docs).mapInArrow(releasing(run), SKETCH)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures: the share of equal groups of bits, corrected for chance."""
    longs = shingles.HASHES * shingles.LOW_BITS // 64
    ones = sum(1 << i for i in range(0, 64, shingles.LOW_BITS))
    ones -= (ones >> 63) << 64  # as a signed long

    def differing(i: int) -> Column:
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        folded = reduce(Column.bitwiseOR, [F.shiftrightunsigned(x, k) for k in range(1, shingles.LOW_BITS)], x)
        return F.bit_count(folded.bitwiseAND(F.lit(ones)))

    equal = 1.0 - reduce(Column.__add__, [differing(i) for i in range(longs)]) / shingles.HASHES
    chance = 2.0**-shingles.LOW_BITS
    return (equal - chance) / (1.0 - chance)


def least_estimate(percent: int) -> float:
    """The threshold less ``SIGMAS`` standard deviations of an estimate at the threshold."""
    chance = 2.0**-shingles.LOW_BITS
    p = chance + (1 - chance) * percent / 100
    return percent / 100 - SIGMAS * (p * (1 - p) / shingles.HASHES) ** 0.5 / (1 - chance)


def crowded_texts(docs: DataFrame, slots: DataFrame) -> DataFrame:
    """key_1, doc_id and text of the classes in buckets of two or more, written once for all rounds."""
    reps = materialize(slots.select("key_1", F.col("rep").alias("doc_id")).distinct(), "crowded_classes")
    return materialize(bounded_join(texts(docs), reps, ["doc_id"], [F.xxhash64("text")], F.lit(16)), "crowded_texts")


def confirm(pairs: DataFrame, crowded: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs`` (a, b) of classes those whose full shingle sets are similar, as edges (u, v) of doc_ids."""
    pairs = materialize(pairs, "candidates")
    needed = pairs.select(F.col("a").alias("key_1")).unionByName(pairs.select(F.col("b").alias("key_1"))).distinct()
    held = bounded_join(crowded, materialize(needed, "candidate_classes"), ["key_1"], [F.col("doc_id")], F.lit(8))
    left = held.select(F.col("key_1").alias("a"), F.col("doc_id").alias("u"), F.col("text").alias("text_a"))
    right = held.select(F.col("key_1").alias("b"), F.col("doc_id").alias("v"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("u", "v", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, [2, 3]):
            u, v = batch.column(0), batch.column(1)
            ids, columns = {}, []
            for owner, text in ((u, batch.column(2)), (v, batch.column(3))):
                columns.append([ids.setdefault((o, t), len(ids)) for o, t in zip(owner.to_pylist(), text.to_pylist(), strict=True)])
            sets = shingles.sets_of([t.encode() for _, t in ids])
            good = [shingles.similar(sets[i], sets[j], percent) for i, j in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays([u, v], names=["u", "v"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(releasing(run), "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) for the nodes of ``edges`` (u, v).

    Labels spread to neighbours and then jump along labels; every round is written to the shared
    folder, so rounds grow with the logarithm of a component's width, not with the lineage.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = materialize(both.where(F.col("u") != F.col("v")).distinct(), "edges")
    labels = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("near"))
    labels = materialize(labels.select("node", F.least("node", "near").alias("comp")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("v"), "comp"), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("comp").alias("near"))
        )
        spread = labels.join(near, "node").select("node", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        spread = materialize(spread, "spread")
        jump = spread.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        jumped = spread.join(jump, "comp").select("node", F.least("comp", "far").alias("comp"), "was")
        jumped = materialize(jumped, "labels")
        labels = jumped.select("node", "comp")
        if jumped.where(F.col("comp") != F.col("was")).isEmpty():
            return labels


def relabel(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """``comp`` (rep, comp) after adding ``edges`` between reps: the components are contracted."""
    small = (
        edges.join(comp.select(F.col("rep").alias("u"), F.col("comp").alias("x")), "u")
        .join(comp.select(F.col("rep").alias("v"), F.col("comp").alias("y")), "v")
        .select(F.col("x").alias("u"), F.col("y").alias("v"))
        .where(F.col("u") != F.col("v"))
    )
    merged = components(small).select(F.col("node").alias("comp"), F.col("comp").alias("new"))
    renamed = comp.join(merged, "comp", "left").select("rep", F.coalesce("new", "comp").alias("comp"))
    return materialize(renamed, "components")


def near_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text)."""
    rows = materialize(sketch(docs), "sketches")
    linked = rows.where(F.col("key_1").isNotNull() & F.col("doc_id").isNotNull())
    classes = linked.groupBy("key_1", "key_2").agg(
        F.min("doc_id").alias("rep"), F.first(F.struct("n_shingles", "bands", "signature")).alias("s")
    )
    classes = materialize(classes.select("key_1", "key_2", "rep", "s.n_shingles", "s.bands", "s.signature"), "classes")
    members = linked.join(classes.select("key_1", "key_2", "rep"), ["key_1", "key_2"]).select("doc_id", "rep")

    slots = classes.select(F.posexplode("bands").alias("band_no", "band"), "key_1", "rep")
    crowded = slots.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    slots = materialize(slots.join(crowded, "band"), "buckets")
    crowded_docs = crowded_texts(docs, slots)
    hubs = slots.groupBy("key_1").agg(F.least(F.sum("n"), F.lit(1 << 22)).alias("weight"))
    hubs = hubs.select("key_1", (F.col("weight") * (1 << 40) + F.col("key_1").bitwiseAND(F.lit((1 << 40) - 1))).alias("rank_0"))
    ranks = {f"rank_{r}": F.col("key_1").bitwiseXOR(F.lit(salt)) for r, salt in enumerate(PIVOT_SALTS, 1)}
    ranked = materialize(classes.join(hubs, "key_1").withColumns(ranks), "ranked")
    floor = least_estimate(percent)

    # Rows that share a doc_id are one document.
    spread = members.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high"))
    spread = spread.where(F.col("low") < F.col("high"))
    edges = members.join(spread, "doc_id").select(F.col("low").alias("u"), F.col("rep").alias("v")).distinct()
    # Classes that share neither a bucket nor a document stay by themselves and need no label.
    alone = edges.select(F.col("u").alias("rep")).unionByName(edges.select(F.col("v").alias("rep")))
    nodes = slots.select("rep").unionByName(alone).distinct()
    comp = materialize(nodes.select("rep", F.col("rep").alias("comp")), "components")
    comp = relabel(comp, edges) if not edges.isEmpty() else comp

    for r in range(1 + len(PIVOT_SALTS)):
        pairs = star_pairs(slots, ranked, comp, floor, percent, f"rank_{r}")
        found = materialize(confirm(pairs, crowded_docs, percent), "links")
        if found.isEmpty():
            break
        comp = relabel(comp, found)

    found = materialize(confirm(remaining_pairs(slots, classes, comp, floor, percent), crowded_docs, percent), "links")
    if not found.isEmpty():
        comp = relabel(comp, found)
    return _results(rows, classes, comp)


def sizes_near(sizes: tuple[Column, Column], percent: int) -> Column:
    """Whether two set sizes are near enough for their sets to be similar."""
    return F.least(*sizes) * 100 >= F.greatest(*sizes) * percent


def star_pairs(slots: DataFrame, ranked: DataFrame, comp: DataFrame, floor: float, percent: int, rank: str) -> DataFrame:
    """Pairs (a, b) of a bucket's pivot, the highest ``rank``, and its members in other components.

    Only pairs that sizes and estimate let pass leave the join.
    """
    state = ranked.join(comp, "rep").select("key_1", F.col(rank).alias("rank"), "comp", "n_shingles", "signature")
    now = slots.select("band", "key_1").join(state, "key_1")
    open_ = (
        now.groupBy("band")
        .agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max("rank").alias("rank"))
        .where(F.col("low") < F.col("high"))
        .select(F.col("band").alias("p_band"), "rank")
    )
    pivots = open_.join(
        state.select(
            "rank",
            F.col("key_1").alias("pivot"),
            F.col("comp").alias("c_pivot"),
            F.col("n_shingles").alias("n_pivot"),
            F.col("signature").alias("s_pivot"),
        ),
        "rank",
    ).drop("rank")
    passes = (
        (F.col("band") == F.col("p_band"))
        & (F.col("comp") != F.col("c_pivot"))
        & sizes_near((F.col("n_shingles"), F.col("n_pivot")), percent)
        & (estimate(F.col("signature"), F.col("s_pivot")) >= floor)
    )
    pairs = now.join(pivots, passes)
    return pairs.select(F.least("pivot", "key_1").alias("a"), F.greatest("pivot", "key_1").alias("b")).distinct()


def remaining_pairs(slots: DataFrame, classes: DataFrame, comp: DataFrame, floor: float, percent: int) -> DataFrame:
    """Pairs (a, b) of different components in one bucket that the estimate lets pass.

    The rows of a bucket's largest component need no test among themselves, so only the others
    meet the whole bucket. A pair comes out of the first bucket that it shares, only once.
    """
    now = slots.join(comp, "rep")
    held = now.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("n"))
    most = held.groupBy("band").agg(F.max(F.struct("n", "comp")).alias("top"), F.count(F.lit(1)).alias("kinds"))
    most = most.where(F.col("kinds") > 1).select("band", F.col("top.comp").alias("main"))
    open_ = now.join(most, "band").join(classes.select("key_1", "n_shingles", "signature", "bands"), "key_1")
    open_ = open_.withColumn("outside", F.col("comp") != F.col("main")).drop("main", "rep")
    open_ = materialize(open_, "open")
    left = open_.where("outside").select(
        "band",
        F.col("band_no").alias("no"),
        F.col("key_1").alias("x"),
        F.col("comp").alias("cx"),
        F.col("n_shingles").alias("nx"),
        F.col("signature").alias("sx"),
        F.col("bands").alias("bx"),
    )
    right = open_.select(
        F.col("band").alias("r_band"),
        F.col("key_1").alias("y"),
        F.col("comp").alias("cy"),
        F.col("n_shingles").alias("ny"),
        F.col("signature").alias("sy"),
        F.col("bands").alias("by"),
        "outside",
    )
    first_shared = F.array_position(F.zip_with("bx", "by", lambda p, q: p == q), True) - 1
    meets = (
        (F.col("band") == F.col("r_band"))
        & (F.col("cx") != F.col("cy"))
        & (~F.col("outside") | (F.col("x") < F.col("y")))
        & sizes_near((F.col("nx"), F.col("ny")), percent)
        & (estimate(F.col("sx"), F.col("sy")) >= floor)
        & (first_shared == F.col("no"))
    )
    return left.join(right, meets).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _results(rows: DataFrame, classes: DataFrame, comp: DataFrame) -> DataFrame:
    labelled = classes.join(comp, "rep", "left").select("key_1", "key_2", F.coalesce("comp", "rep").alias("comp"))
    joined = rows.select("doc_id", "n_shingles", "key_1", "key_2").join(labelled, ["key_1", "key_2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return joined.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with all its columns, of every component only the document with the smallest doc_id."""
    gone = near_components(docs, percent).where(~F.col("kept")).select("doc_id").distinct()
    name = unused(docs, "dropped_id")
    gone = gone.withColumnRenamed("doc_id", name)
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
