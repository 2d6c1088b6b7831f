"""From a folder of WAV files to fused vectors and the health report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scale import materialize
from ..functions.signal import SignalParams
from ..operators.features import extract, feature_names, feature_vector
from ..operators.fusion import attach_embeddings, dimensions, fuse
from ..operators.preprocess import TARGET_RATE, prepare_waves
from ..operators.projection import Head, project
from ..sources.recordings import accepted, parse_paths, relative_path, scan_files
from ..sources.feature_store import extend_store
from ..sources.stores import STORE_KEY, with_store_key
from ..sources.wav import decode_wav
from .report import explained_report, health_report

STORE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in (*STORE_KEY, "filename")]
    + [
        T.StructField("feature_names", T.ArrayType(T.StringType())),
        T.StructField("feature_vector", T.ArrayType(T.FloatType())),
    ]
)
CATALOG = ["machine_type", "machine_id", "label", "filename"]


def catalog(spark: SparkSession, root: str, extension: str = ".wav", with_content: bool = False) -> DataFrame:
    """All files below ``root`` with their parsed metadata and ``reject_reason``."""
    files = scan_files(spark, root, extension, with_content)
    return parse_paths(files.withColumn("relative_path", relative_path(F.col("path"), root)))


def decoded_recordings(spark: SparkSession, root: str) -> DataFrame:
    """Accepted recordings with samples; undecodable ones keep their row and an ``error``."""
    files = accepted(catalog(spark, root, with_content=True))
    return decode_wav(files.select(*CATALOG, "relative_path", "content"))


def dsp_vectors(decoded: DataFrame, params: SignalParams | None = None) -> DataFrame:
    """(catalog columns, feature_names, feature_vector), narrow from file to vector."""
    p = params or SignalParams()
    waves = prepare_waves(decoded, p.sample_rate or TARGET_RATE)
    return feature_vector(extract(waves, CATALOG, p), feature_names(p))


def fused_vectors(dsp: DataFrame, embeddings: DataFrame, embedding_dim: int | None = None) -> DataFrame:
    """Join the embeddings, keyed by (machine_type, machine_id, label, stem), and fuse."""
    keyed = with_store_key(dsp).withColumn("_key", F.struct("machine_type", "machine_id", "label", "stem"))
    arrived = embeddings.select(F.struct("machine_type", "machine_id", "label", "stem").alias("_key"), "embedding")
    return fuse(attach_embeddings(keyed, arrived, "_key"), embedding_dim=embedding_dim).drop("_key")


def stored_vectors(decoded: DataFrame, store: str, params: SignalParams | None = None) -> DataFrame:
    """Signal features of ``decoded`` through the store at ``store``: only missing ones are computed, once."""

    def compute(misses: DataFrame) -> DataFrame:
        return with_store_key(dsp_vectors(misses, params))

    return extend_store(decoded, store, compute, STORE_SCHEMA)


def learned_vectors(fused: DataFrame, head: Head) -> DataFrame:
    """Catalog columns, the projected ``vector`` and the length of every vector, written once."""
    dims = {"dsp_dim": "feature_vector", "embedding_dim": "embedding", "fused_dim": "fused_vector", "learned_dim": "vector"}
    sized = dimensions(project(fused, head, output="vector"), dims)
    return materialize(sized.select(*CATALOG, "vector", *dims), "learned_vectors")


def learned_report(fused: DataFrame, members: DataFrame, head: Head) -> DataFrame:
    """Project both sides and report every recording, with the length of each vector."""
    scored, known = learned_vectors(fused, head), learned_vectors(members, head)
    return health_report(scored, known.select(*CATALOG, "vector"))


def full_report(decoded: DataFrame, embeddings: DataFrame, head: Head, store: str, params: SignalParams | None = None) -> DataFrame:
    """Decoded recordings to the explained report against profiles of their own normal ones.

    Decoding and features run once, into the store, and the projection once; the three passes
    of profiling and scoring read the learned vectors only.
    """
    learned = learned_vectors(fused_vectors(stored_vectors(decoded, store, params), embeddings), head)
    return explained_report(learned, learned.where("label = 'normal'"))
