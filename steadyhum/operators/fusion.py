"""Vector checks, fingerprint rows, embeddings and their fusion."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import as_double, has_inf, has_nan, has_null

REQUIRED_METADATA = ("machine_type", "machine_id", "label", "filename")


def _listed(df: DataFrame, keep: list[str], reasons: list[Column]) -> DataFrame:
    return df.select(*keep, F.explode(F.array_compact(F.array(*reasons))).alias("violation"))


def metadata_violations(recs: DataFrame, keep: list[str], required: tuple[str, ...] = REQUIRED_METADATA) -> DataFrame:
    """One row per recording and blank required field."""
    blank = [
        F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) == "", F.concat(F.lit("empty "), F.lit(c))) for c in required
    ]
    return _listed(recs, keep, blank)


def _vector_reasons(vector: str, names: str | None = None, dim: int | None = None) -> list[Column]:
    v = F.col(vector)
    reasons = [
        F.when(v.isNull() | (F.size(v) == 0), "empty vector"),
        F.when(has_null(v), "null values"),
        F.when(has_nan(v), "NaN values"),
        F.when(has_inf(v), "infinite values"),
    ]
    if names:
        reasons.append(F.when(F.size(names) != F.size(v), "length differs from names"))
    if dim:
        reasons.append(F.when(F.size(v) != dim, f"length is not {dim}"))
    return reasons


def vector_violations(
    df: DataFrame, keep: list[str], vector: str = "vector", names: str | None = None, dim: int | None = None
) -> DataFrame:
    return _listed(df, keep, _vector_reasons(vector, names, dim))


def _sound(reasons: list[Column]) -> Column:
    return F.coalesce(*reasons).isNull()


def build_fingerprints(features: DataFrame, recs: DataFrame, key: str = "rec_id") -> DataFrame:
    """Fingerprint rows: metadata, names, vector, creation time; faulty rows are left to the
    violation tables. Both sides are keyed by recording, so the join has no hot key."""
    blank = [F.coalesce(F.trim(F.col(c)), F.lit("")) == "" for c in REQUIRED_METADATA]
    complete = recs.select(key, *REQUIRED_METADATA)
    for b in blank:
        complete = complete.where(~b)
    checked = features.where(_sound(_vector_reasons("feature_vector", "feature_names")))
    return complete.join(checked, key).withColumn("created_at", F.current_timestamp())


def mean_pool(frame_embeddings: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """Element-wise mean of frame vectors per key, combined on the map side."""
    pooled = frame_embeddings.groupBy(*keys).agg(
        Summarizer.mean(array_to_vector(as_double(F.col(vector)))).alias("_mean")
    )
    return pooled.select(*keys, vector_to_array("_mean").alias(vector))


def attach_embeddings(recs: DataFrame, embeddings: DataFrame, key: str = "rec_id") -> DataFrame:
    """Recordings with their embedding; see ``without_embedding`` for the rest."""
    return recs.join(embeddings, key)


def without_embedding(recs: DataFrame, embeddings: DataFrame, key: str = "rec_id") -> DataFrame:
    return recs.join(embeddings.select(key), key, "left_anti")


def fuse(
    df: DataFrame, dsp: str = "feature_vector", embedding: str = "embedding", embedding_dim: int | None = None
) -> DataFrame:
    """Add ``fused_vector``: signal features first, embedding after; faulty rows are excluded."""
    reasons = [*_vector_reasons(dsp), *_vector_reasons(embedding, dim=embedding_dim)]
    joined = F.concat(as_double(F.col(dsp)), as_double(F.col(embedding))).cast("array<float>")
    return df.where(_sound(reasons)).withColumn("fused_vector", joined)


def fusion_violations(
    df: DataFrame, keep: list[str], dsp: str = "feature_vector", embedding: str = "embedding", embedding_dim: int | None = None
) -> DataFrame:
    tagged = [F.concat(F.lit(f"{c}: "), r) for c, dim in ((dsp, None), (embedding, embedding_dim)) for r in _vector_reasons(c, dim=dim)]
    return _listed(df, keep, tagged)


def dimensions(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add the length of each vector column under its output name."""
    return df.withColumns({name: F.size(column) for name, column in columns.items()})
