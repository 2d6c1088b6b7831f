"""Signal queries over whole signals in chunks: any length, exact across the borders of chunks and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scale import fresh_path
from ..functions.signal import AMIN
from ..functions.vectors import total
from ..operators import chunked as C
from ..operators.preprocess import mel_weights_of
from ..sources import wav_ranges as R
from ..sources.wav import encode_wav
from . import views as X
from . import wave_queries as Q
from .registry import query, r6, rounded

KEYS = ["rec_id"]
CHUNK = 100  # samples, not a multiple of the hop
CELL = 5  # frames; tiny, so that every signal has many borders


def over_signals(*views: str) -> tuple[str, ...]:
    """The views of the clip queries, with whole signals for clips."""
    return tuple(X.SIGNAL_SQL if v == X.CLIP_SQL else v for v in views)


def chunks(spark, sf_dir, size=CHUNK):
    return X.signal_chunks(spark, sf_dir, size)


FRAME_SELECT = "SELECT rec_id, CAST(frame AS BIGINT) AS frame, CAST(k AS INTEGER) AS i, round(x, 6) + 0.0 AS v FROM fx32"


@query("chunked_frames", "P5", X.sql(FRAME_SELECT, *over_signals(*Q.BASE, Q.FX32)))
def chunked_frames(spark, sf_dir):
    framed = C.frames(chunks(spark, sf_dir), KEYS, 32, 16, cell_frames_n=CELL)
    return rounded(framed.select("rec_id", "frame", F.posexplode("x").alias("i", "v")), "v")


@query(
    "chunked_frames_uncentred",
    "P5",
    X.sql(
        """SELECT c.rec_id, CAST(t.frame AS BIGINT) AS frame, CAST(c.i - t.frame * 16 AS INTEGER) AS i, round(c.x, 6) + 0.0 AS v
FROM (SELECT rec_id, unnest(range((n - 32) // 16 + 1)) AS frame FROM len WHERE n >= 32) t
JOIN clip c ON c.rec_id = t.rec_id AND c.i >= t.frame * 16 AND c.i < t.frame * 16 + 32""",
        *over_signals(*Q.BASE),
    ),
)
def chunked_frames_uncentred(spark, sf_dir):
    framed = C.frames(chunks(spark, sf_dir, 7), KEYS, 32, 16, centred=False, cell_frames_n=CELL)
    return rounded(framed.select("rec_id", "frame", F.posexplode("x").alias("i", "v")), "v")


@query(
    "chunked_mel_spectrum",
    "P6 P7",
    X.sql(
        "SELECT rec_id, CAST(frame AS BIGINT) AS frame, CAST(band AS INTEGER) AS band, round(m, 7) + 0.0 AS mel FROM mel32",
        *over_signals(*Q.BASE, Q.FX32, Q.PW32, Q.MEL32),
    ),
)
def chunked_mel_spectrum(spark, sf_dir):
    melled = C.power_frames(chunks(spark, sf_dir), KEYS, 32, 16, mel_weights_of(Q.SMALL), CELL)
    return rounded(melled.select("rec_id", "frame", F.posexplode("power").alias("band", "mel")), "mel", digits=7)


@query(
    "chunked_log_mel",
    "P8",
    X.sql(
        Q.LOG_MEL_SELECT.replace("CAST(frame AS INTEGER)", "CAST(frame AS BIGINT)"),
        *over_signals(*Q.BASE, Q.FX32, Q.PW32, Q.MEL32),
    ),
)
def chunked_log_mel(spark, sf_dir):
    return Q.tidy_log_mel(C.log_mel(chunks(spark, sf_dir), KEYS, Q.SMALL, CELL))


def cepstra(spark, sf_dir):
    return C.cepstral_frames(chunks(spark, sf_dir), KEYS, Q.SMALL, CELL)


@query(
    "chunked_mfcc",
    "F1",
    X.sql(
        "SELECT rec_id, CAST(frame AS BIGINT) AS frame, CAST(c AS INTEGER) AS coefficient, round(v, 5) + 0.0 AS value FROM mfcc",
        *over_signals(*Q.MFCC_VIEWS),
    ),
)
def chunked_mfcc(spark, sf_dir):
    rows = cepstra(spark, sf_dir).select("rec_id", "frame", F.posexplode("mfcc").alias("coefficient", "value"))
    return rounded(rows, "value", digits=5)


@query(
    "chunked_mfcc_deltas",
    "F2 F3",
    X.sql(
        """SELECT rec_id, CAST(frame AS BIGINT) AS frame, CAST(c AS INTEGER) AS coefficient,
       round(d1, 5) + 0.0 AS delta, round(d2, 5) + 0.0 AS delta2 FROM delta""",
        *over_signals(*Q.DELTA_VIEWS),
    ),
)
def chunked_mfcc_deltas(spark, sf_dir):
    both = cepstra(spark, sf_dir).where("mfcc_delta IS NOT NULL").select(
        "rec_id", "frame", F.posexplode(F.arrays_zip("mfcc_delta", "mfcc_delta2")).alias("coefficient", "d")
    )
    return both.select(
        "rec_id", "frame", "coefficient", r6(F.col("d.mfcc_delta"), 5).alias("delta"), r6(F.col("d.mfcc_delta2"), 5).alias("delta2")
    )


@query("chunked_mfcc_statistics", "F4", X.sql(Q.MFCC_SELECT, *over_signals(*Q.DELTA_VIEWS)))
def chunked_mfcc_statistics(spark, sf_dir):
    return rounded(C.cepstral_statistics(cepstra(spark, sf_dir), KEYS, Q.SMALL), *Q.MFCC_NAMES, digits=5)


@query(
    "chunked_resample",
    "P2",
    X.sql(
        """SELECT o.rec_id, o.m AS i, round(sum(c.x * t.w), 6) + 0.0 AS v
FROM (SELECT rec_id, unnest(range(2 * n)) AS m FROM len) o
JOIN tap t ON t.p = o.m % 2 JOIN clip c ON c.rec_id = o.rec_id AND c.i = o.m // 2 + t.j - 34 GROUP BY o.rec_id, o.m""",
        *over_signals(*Q.BASE), Q.TAP_SQL,
    ),
)
def chunked_resample(spark, sf_dir):
    moved = C.resample(chunks(spark, sf_dir), KEYS, 8000, 16000, cell_samples=77)
    rows = moved.select("rec_id", "start", F.posexplode("samples").alias("k", "v"))
    return rounded(rows.select("rec_id", (F.col("start") + F.col("k")).alias("i"), "v"), "v")


@query("chunked_harmonic_features", "F14 F15", X.sql(Q.HARMONIC_SELECT, *over_signals(*Q.OK, Q.FXOK, Q.PWOK, Q.HPSS_SQL)))
def chunked_harmonic_features(spark, sf_dir):
    p = Q.SMALL
    split = C.harmonic_energies(chunks(spark, sf_dir), KEYS, p.hpss_fft, p.hop, p.hpss_kernel, CELL)
    both = F.col("harmonic_energy") + F.col("percussive_energy")
    ratio = F.when(both > AMIN, F.col("harmonic_energy") / both).otherwise(0.0)
    return rounded(split.withColumn("harmonic_ratio", ratio), "harmonic_energy", "percussive_energy", "harmonic_ratio", digits=5)


@query(
    "chunk_violations",
    "P5 S7",
    X.sql(
        f"""SELECT rec_id, start, 'gap or overlap before the chunk' AS violation
FROM (SELECT DISTINCT rec_id, CAST(i // {CHUNK} * {CHUNK} AS BIGINT) AS start FROM clip) c
WHERE start > 0 AND start % 300 <> 0 AND (start - {CHUNK}) % 300 = 0 AND rec_id % 3 = 0
UNION ALL
SELECT rec_id, start, 'start is not unique'
FROM (SELECT DISTINCT rec_id, CAST(i // {CHUNK} * {CHUNK} AS BIGINT) AS start FROM clip) c WHERE rec_id % 3 = 1 AND start = 200""",
        X.SIGNAL_SQL,
    ),
)
def chunk_violations(spark, sf_dir):
    """A third of the signals lack every third chunk, another third have one chunk twice."""
    whole = chunks(spark, sf_dir)
    gappy = whole.where(~((F.col("rec_id") % 3 == 0) & (F.col("start") % 300 == 0)))
    return C.chunk_violations(gappy.unionByName(whole.where("rec_id % 3 = 1 AND start = 200")), KEYS)


PCM_VIEWS = (X.SIGNAL_SQL, Q.QUANTISED_SQL)


def written_wavs(spark, sf_dir):
    """(rec_id, path) of WAV files of whole signals, some of them spoiled."""
    samples = X.numbered_samples(spark, sf_dir).select(
        F.col("signal_id").alias("rec_id"), F.struct("n", (F.col("v") / X.SIGNAL_SCALE - 0.5).alias("x")).alias("s")
    )
    waves = samples.groupBy("rec_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    content = encode_wav(F.col("s.x"), F.lit(X.SAMPLE_RATE))
    spoiled = (
        F.when(F.col("rec_id") % 17 == 0, F.lit(b""))
        .when(F.col("rec_id") % 17 == 1, F.lit(b"not a wav file"))
        .otherwise(F.col("content"))
    )
    files = waves.select("rec_id", F.concat(F.col("rec_id"), F.lit(".wav")).alias("name"), content.alias("content"))
    return R.write_wavs(files.withColumn("content", spoiled), fresh_path(spark, "wavs"))


@query(
    "wav_ranges",
    "S4",
    X.sql(
        f"""SELECT rec_id, CAST(start AS BIGINT) AS start, CASE WHEN ok THEN 16000 END AS sample_rate, CASE WHEN ok THEN 1 END AS channels,
       CASE WHEN ok THEN n END AS n_samples, CASE WHEN ok THEN round(s, 5) + 0.0 END AS total, NOT ok AS failed
FROM (SELECT rec_id, rec_id % 17 > 1 AS ok, CASE WHEN rec_id % 17 > 1 THEN i // {CHUNK} * {CHUNK} ELSE 0 END AS start,
             CAST(count(*) AS INTEGER) AS n, sum(x) AS s FROM pcm GROUP BY ALL) t""",
        *PCM_VIEWS,
    ),
)
def wav_ranges(spark, sf_dir):
    read = R.read_wav_chunks(written_wavs(spark, sf_dir), range_frames=CHUNK)
    samples = F.col("samples").cast("array<double>")
    return read.select(
        "rec_id", "start", "sample_rate", "channels",
        F.when(samples.isNotNull(), F.size(samples)).alias("n_samples"),
        r6(total(samples), 5).alias("total"),
        F.col("error").isNotNull().alias("failed"),
    )


@query(
    "chunked_preprocess_wav",
    "P9 S4",
    X.sql(
        Q.LOG_MEL_SELECT.replace("CAST(frame AS INTEGER)", "CAST(frame AS BIGINT)"),
        *PCM_VIEWS,
        "unit AS (SELECT rec_id, i, x / max(abs(x)) OVER (PARTITION BY rec_id) AS x FROM pcm WHERE rec_id % 17 > 1)",
        "len AS (SELECT rec_id, count(*) AS n FROM unit GROUP BY rec_id)",
        Q.frames_sql("fx32", 32, "len", "unit"), Q.PW32, Q.MEL32,
    ),
)
def chunked_preprocess_wav(spark, sf_dir):
    read = R.read_wav_chunks(written_wavs(spark, sf_dir), range_frames=CHUNK).where("error IS NULL")
    return Q.tidy_log_mel(C.log_mel(C.normalize(read, KEYS), KEYS, Q.SMALL, CELL))
