"""Signal queries over clips cut from the line items, with short frames so SQL can check them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.signal import SignalParams
from ..functions.vectors import total
from ..operators import features as FT
from ..operators import preprocess as P
from ..sources.wav import decode_wav, encode_wav
from . import views as X
from .registry import query, r6, rounded

KEYS = ["rec_id"]
SMALL = SignalParams(
    sample_rate=X.SAMPLE_RATE, n_fft=32, hop=16, n_mels=8, n_mfcc=5, mfcc_fft=64, mfcc_mels=8,
    zcr_frame=64, contrast_bands=2, contrast_fmin=1000.0, hpss_fft=32, hpss_kernel=9,
)

# --- checking SQL, written from the definitions ---

LEN_SQL = "len AS (SELECT rec_id, count(*) AS n FROM clip GROUP BY rec_id)"
LONG_SQL = """clip_ok AS (SELECT rec_id, n, 1 + n // 16 AS t FROM len),
clip_long AS (SELECT * FROM clip_ok WHERE n >= 32 AND t >= 9)"""


def frames_sql(name: str, length: int, source: str = "len", samples: str = "clip") -> str:
    """Centred frames with zero padding, long form."""
    return f"""{name} AS (
  SELECT t.rec_id, t.frame, t.k, coalesce(c.x, 0.0) AS x
  FROM (SELECT rec_id, frame, unnest(range({length})) AS k
        FROM (SELECT rec_id, unnest(range(1 + n // 16)) AS frame FROM {source}) s) t
  LEFT JOIN {samples} c ON c.rec_id = t.rec_id AND c.i = t.frame * 16 + t.k - {length // 2})"""


def power_sql(name: str, frames: str, length: int) -> str:
    """Discrete Fourier transform by its definition."""
    angle = f"2 * pi() * b.bin * f.k / {length}"
    window = f"(0.5 - 0.5 * cos(2 * pi() * f.k / {length}))"
    return f"""{name} AS (
  SELECT rec_id, frame, bin, re, im, re * re + im * im AS p FROM (
    SELECT f.rec_id, f.frame, b.bin, sum(f.x * {window} * cos({angle})) AS re, -sum(f.x * {window} * sin({angle})) AS im
    FROM {frames} f, (SELECT unnest(range({length // 2 + 1})) AS bin) b GROUP BY f.rec_id, f.frame, b.bin) t)"""


def mel_sql(name: str, power: str, length: int, bands: int, fmin: float) -> str:
    """Triangular unit-area filters on the mel scale."""
    hz = "CASE WHEN m < 15 THEN m * 200.0 / 3 ELSE 1000 * exp((m - 15) * ln(6.4) / 27) END"
    low = f"({fmin} * 3 / 200.0)"
    high = f"(15 + ln({X.SAMPLE_RATE / 2} / 1000) / (ln(6.4) / 27))"
    return f"""{name}_edge AS (
  SELECT i, {hz} AS hz FROM (SELECT i, {low} + i * ({high} - {low}) / {bands + 1} AS m FROM (SELECT unnest(range({bands + 2})) AS i) a) b),
{name}_w AS (
  SELECT a.i AS band, k.bin, greatest(0, least((k.f - a.hz) / (b.hz - a.hz), (c.hz - k.f) / (c.hz - b.hz))) * 2 / (c.hz - a.hz) AS w
  FROM {name}_edge a JOIN {name}_edge b ON b.i = a.i + 1 JOIN {name}_edge c ON c.i = a.i + 2,
       (SELECT bin, bin * {X.SAMPLE_RATE / length} AS f FROM (SELECT unnest(range({length // 2 + 1})) AS bin) r) k),
{name} AS (
  SELECT rec_id, frame, band, sum(p * w) AS m FROM {power} JOIN {name}_w USING (bin) GROUP BY rec_id, frame, band)"""


FX32, PW32 = frames_sql("fx32", 32), power_sql("pw32", "fx32", 32)
MEL32 = mel_sql("mel32", "pw32", 32, 8, 20.0)
FXOK, PWOK = frames_sql("fxok", 32, "clip_ok"), power_sql("pwok", "fxok", 32)
FX64, PW64 = frames_sql("fx64", 64, "clip_ok"), power_sql("pw64", "fx64", 64)
MEL64 = mel_sql("mel64", "pw64", 64, 8, 0.0)
MFCC_SQL = """db64 AS (
  SELECT rec_id, frame, band, greatest(d, max(d) OVER (PARTITION BY rec_id) - 80) AS d
  FROM (SELECT *, 10 * log10(greatest(1e-10, m)) AS d FROM mel64) t),
mfcc AS (
  SELECT rec_id, frame, c.c, sum(d * cos(pi() * c.c * (2 * band + 1) / 16) * sqrt(2.0 / 8) * CASE WHEN c.c = 0 THEN sqrt(0.5) ELSE 1 END) AS v
  FROM db64, (SELECT unnest(range(5)) AS c) c GROUP BY rec_id, frame, c.c)"""
DELTA_SQL = """delta AS (
  SELECT m.rec_id, m.frame, m.c, any_value(m.v) AS v, sum(k.k / 60.0 * o.v) AS d1, sum(k.w / 462.0 * o.v) AS d2
  FROM mfcc m JOIN clip_long USING (rec_id),
       (VALUES (-4, 28), (-3, 7), (-2, -8), (-1, -17), (0, -20), (1, -17), (2, -8), (3, 7), (4, 28)) k(k, w)
  JOIN mfcc o ON o.rec_id = m.rec_id AND o.c = m.c AND o.frame = greatest(4, least(t - 5, m.frame)) + k.k
  GROUP BY m.rec_id, m.frame, m.c)"""
BASE = (X.CLIP_SQL, LEN_SQL)
OK = (*BASE, LONG_SQL)
MFCC_VIEWS = (*OK, FX64, PW64, MEL64, MFCC_SQL)
DELTA_VIEWS = (*MFCC_VIEWS, DELTA_SQL)

SPECTRAL_SQL = """mag AS (SELECT *, sqrt(p) AS g, bin * 500.0 AS f FROM pwok),
cum AS (SELECT *, sum(g) OVER (PARTITION BY rec_id, frame ORDER BY bin) AS run, sum(g) OVER (PARTITION BY rec_id, frame) AS mass,
               sum(g * f) OVER (PARTITION BY rec_id, frame) AS moment FROM mag),
spec AS (
  SELECT rec_id, frame, any_value(CASE WHEN mass > 0 THEN moment / mass ELSE 0 END) AS centroid,
         sqrt(sum(CASE WHEN mass > 0 THEN g * (f - moment / mass) * (f - moment / mass) / mass ELSE 0 END)) AS bandwidth,
         min(CASE WHEN run >= 0.85 * mass THEN f END) AS rolloff,
         exp(avg(ln(greatest(1e-10, p)))) / avg(greatest(1e-10, p)) AS flatness,
         max(g) FILTER (bin BETWEEN 0 AND 1) AS p0, min(g) FILTER (bin BETWEEN 0 AND 1) AS v0,
         max(g) FILTER (bin BETWEEN 1 AND 3) AS p1, min(g) FILTER (bin BETWEEN 1 AND 3) AS v1,
         max(g) FILTER (bin BETWEEN 3 AND 16) AS p2, min(g) FILTER (bin BETWEEN 3 AND 16) AS v2
  FROM cum GROUP BY rec_id, frame),
floors AS (
  SELECT rec_id, 10 * log10(greatest(1e-10, max(greatest(p0, p1, p2)))) - 80 AS pf,
         10 * log10(greatest(1e-10, max(greatest(v0, v1, v2)))) - 80 AS vf FROM spec GROUP BY rec_id),
contrast AS (
  SELECT rec_id, frame, """ + ", ".join(
    f"greatest(10 * log10(greatest(1e-10, p{b})), pf) - greatest(10 * log10(greatest(1e-10, v{b})), vf) AS c{b}" for b in range(3)
) + """ FROM spec JOIN floors USING (rec_id)),
zx AS (
  SELECT t.rec_id, t.frame, t.k, c.x < -1e-10 AS neg
  FROM (SELECT rec_id, n, frame, unnest(range(64)) AS k FROM (SELECT rec_id, n, unnest(range(t)) AS frame FROM clip_ok) s) t
  JOIN clip c ON c.rec_id = t.rec_id AND c.i = greatest(0, least(n - 1, t.frame * 16 + t.k - 32))),
zcr AS (
  SELECT rec_id, frame, sum(CASE WHEN neg <> before THEN 1 ELSE 0 END) / 64.0 AS zcr
  FROM (SELECT *, lag(neg) OVER (PARTITION BY rec_id, frame ORDER BY k) AS before FROM zx) t GROUP BY rec_id, frame)"""
SPECTRAL_VIEWS = (*OK, FXOK, PWOK, SPECTRAL_SQL)


def stat_pair(expr: str, name: str, digits: int = 5) -> str:
    return f"round(avg({expr}), {digits}) + 0.0 AS {name}_mean, round(stddev_pop({expr}), {digits}) + 0.0 AS {name}_std"


def tidy(features, names):
    """Rounded for comparison; crossing rates are dyadic fractions and need digits beyond a tie."""
    zcr = [n for n in names if n.startswith("zcr")]
    return rounded(rounded(features, *[n for n in names if n not in zcr], digits=5), *zcr, digits=11)


SPECTRAL_SELECT = (
    "SELECT rec_id, "
    + ", ".join(stat_pair(c, f"spectral_{c}") for c in ("centroid", "bandwidth", "rolloff", "flatness"))
    + ", " + stat_pair("zcr", "zcr", 11) + ", "
    + ", ".join(stat_pair(f"c{b}", f"spectral_contrast_band{b}") for b in range(3))
    + " FROM spec JOIN contrast USING (rec_id, frame) JOIN zcr USING (rec_id, frame) GROUP BY rec_id"
)

TEMPORAL_SQL = """rms AS (SELECT rec_id, frame, sqrt(sum(x * x) / 32) AS r FROM fxok GROUP BY rec_id, frame),
ste AS (
  SELECT t.rec_id, t.frame, sum(c.x * c.x) AS e
  FROM (SELECT rec_id, unnest(range((n - 32) // 16 + 1)) AS frame FROM clip_ok WHERE n >= 32) t
  JOIN clip c ON c.rec_id = t.rec_id AND c.i >= t.frame * 16 AND c.i < t.frame * 16 + 32 GROUP BY t.rec_id, t.frame),
rms_pool AS (
  SELECT rec_id, avg(r) AS rms_mean, stddev_pop(r) AS rms_std, max(r) AS rms_max,
         least(80.0, 10 * log10(greatest(1e-10, max(r) * max(r))) - 10 * log10(greatest(1e-10, min(r) * min(r)))) AS dynamic_range_db
  FROM rms GROUP BY rec_id),
ste_pool AS (SELECT rec_id, avg(e) AS ste_mean, stddev_pop(e) AS ste_std FROM ste GROUP BY rec_id),
temporal AS (SELECT * FROM rms_pool JOIN ste_pool USING (rec_id))"""
TEMPORAL_SELECT = "SELECT rec_id, " + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in FT.TEMPORAL) + " FROM temporal"


def mirrored(index: str, size: str) -> str:
    """Index reflected at both ends, the edge element repeated."""
    m = f"((({index}) % (2 * {size}) + 2 * {size}) % (2 * {size}))"
    return f"CASE WHEN {m} < {size} THEN {m} ELSE 2 * {size} - 1 - {m} END"


HPSS_SQL = f"""hmag AS (SELECT p.*, sqrt(p.p) AS g, o.t, o.n FROM pwok p JOIN clip_ok o USING (rec_id)),
near AS (SELECT unnest(range(-4, 5)) AS k),
harm AS (
  SELECT a.rec_id, a.frame, a.bin, median(b.g) AS h FROM hmag a, near
  JOIN hmag b ON b.rec_id = a.rec_id AND b.bin = a.bin AND b.frame = {mirrored('a.frame + near.k', 'a.t')}
  GROUP BY a.rec_id, a.frame, a.bin),
perc AS (
  SELECT a.rec_id, a.frame, a.bin, median(b.g) AS q FROM hmag a, near
  JOIN hmag b ON b.rec_id = a.rec_id AND b.frame = a.frame AND b.bin = {mirrored('a.bin + near.k', '17')}
  GROUP BY a.rec_id, a.frame, a.bin),
share AS (
  SELECT m.*, CASE WHEN h = 0 AND q = 0 THEN 0.5 ELSE h * h / (h * h + q * q) END AS s
  FROM hmag m JOIN harm USING (rec_id, frame, bin) JOIN perc USING (rec_id, frame, bin)),
inv AS (
  SELECT rec_id, frame, k, any_value(n) AS n, (0.5 - 0.5 * cos(2 * pi() * k / 32)) AS w,
         sum(CASE WHEN bin IN (0, 16) THEN 1 ELSE 2 END * s * (re * cos(2 * pi() * bin * k / 32) - im * sin(2 * pi() * bin * k / 32))) / 32 AS xh,
         sum(CASE WHEN bin IN (0, 16) THEN 1 ELSE 2 END * (1 - s) * (re * cos(2 * pi() * bin * k / 32) - im * sin(2 * pi() * bin * k / 32))) / 32 AS xp
  FROM share, (SELECT unnest(range(32)) AS k) r GROUP BY rec_id, frame, k),
ola AS (
  SELECT rec_id, frame * 16 + k - 16 AS i, any_value(n) AS n, sum(xh * w) / sum(w * w) AS yh, sum(xp * w) / sum(w * w) AS yp
  FROM inv GROUP BY rec_id, frame * 16 + k - 16),
split AS (
  SELECT rec_id, avg(yh * yh) AS eh, avg(yp * yp) AS ep FROM ola WHERE i >= 0 AND i < n GROUP BY rec_id)"""
HARMONIC_SELECT = """SELECT rec_id, round(eh, 5) + 0.0 AS harmonic_energy, round(ep, 5) + 0.0 AS percussive_energy,
       round(CASE WHEN eh + ep > 1e-10 THEN eh / (eh + ep) ELSE 0 END, 5) + 0.0 AS harmonic_ratio FROM split"""

MFCC_NAMES = [f"{f}_{i}_{s}" for f in FT.MFCC_FAMILIES for s in ("mean", "std") for i in range(SMALL.n_mfcc)]
_value = {"mfcc": "v", "mfcc_delta": "d1", "mfcc_delta2": "d2"}
_stat = {"mean": "avg", "std": "stddev_pop"}
MFCC_SELECT = (
    "SELECT rec_id, "
    + ", ".join(
        f"round({_stat[s]}({_value[f]}) FILTER (c = {i}), 5) + 0.0 AS {f}_{i}_{s}"
        for f in FT.MFCC_FAMILIES for s in ("mean", "std") for i in range(SMALL.n_mfcc)
    )
    + " FROM delta GROUP BY rec_id"
)

# --- queries ---


def long_samples(waves, column="samples", name="v"):
    return waves.select("rec_id", F.posexplode(column).alias("i", name))


@query("downmix", "P1", X.sql("SELECT rec_id, i, round((x + x * x) / 2, 6) + 0.0 AS v FROM clip", *X.CLIP_VIEWS))
def downmix(spark, sf_dir):
    waves = X.clips(spark, sf_dir)
    stereo = F.array("samples", F.transform("samples", lambda x: x * x))
    return rounded(long_samples(waves.withColumn("samples", P.downmix(stereo))), "v")


def partly_silent(spark, sf_dir):
    loud = F.when(F.col("rec_id") % 7 == 0, 0.0).otherwise(1.0)
    return X.clips(spark, sf_dir).withColumn("samples", F.transform("samples", lambda x: x * loud))


@query(
    "peak_normalize",
    "P3",
    X.sql(
        """SELECT rec_id, i, round(CASE WHEN m < 1e-9 THEN y ELSE y / m END, 6) + 0.0 AS v FROM (
  SELECT *, max(abs(y)) OVER (PARTITION BY rec_id) AS m FROM (SELECT rec_id, i, CASE WHEN rec_id % 7 = 0 THEN 0.0 ELSE x END AS y FROM clip) a) b""",
        *X.CLIP_VIEWS,
    ),
)
def peak_normalize(spark, sf_dir):
    return rounded(long_samples(P.normalize(partly_silent(spark, sf_dir))), "v")


@query(
    "silent_recordings",
    "P4",
    X.sql("SELECT DISTINCT rec_id, 16000 AS sample_rate, 0.0::DOUBLE AS peak FROM clip WHERE rec_id % 7 = 0", *X.CLIP_VIEWS),
)
def silent_recordings(spark, sf_dir):
    return P.silent_recordings(partly_silent(spark, sf_dir))


@query(
    "frames_centred",
    "P5",
    X.sql("SELECT rec_id, CAST(frame AS INTEGER) AS frame, CAST(k AS INTEGER) AS i, round(x, 6) + 0.0 AS v FROM fx32", *BASE, FX32),
)
def frames_centred(spark, sf_dir):
    framed = P.frames(X.clips(spark, sf_dir).select("rec_id", "samples"), 32, 16)
    return rounded(framed.select("rec_id", "frame", F.posexplode("x").alias("i", "v")), "v")


@query(
    "frames_uncentred",
    "P5",
    X.sql(
        """SELECT c.rec_id, CAST(t.frame AS INTEGER) AS frame, CAST(c.i - t.frame * 16 AS INTEGER) AS i, round(c.x, 6) + 0.0 AS v
FROM (SELECT rec_id, unnest(range((n - 32) // 16 + 1)) AS frame FROM len WHERE n >= 32) t
JOIN clip c ON c.rec_id = t.rec_id AND c.i >= t.frame * 16 AND c.i < t.frame * 16 + 32""",
        *BASE,
    ),
)
def frames_uncentred(spark, sf_dir):
    framed = P.frames(X.clips(spark, sf_dir).select("rec_id", "samples"), 32, 16, centred=False)
    return rounded(framed.select("rec_id", "frame", F.posexplode("x").alias("i", "v")), "v")


def powered(spark, sf_dir):
    return P.power_frames(X.clips(spark, sf_dir).select("rec_id", "samples"), 32, 16)


@query(
    "power_spectrum",
    "P6",
    X.sql(
        "SELECT rec_id, CAST(frame AS INTEGER) AS frame, CAST(bin AS INTEGER) AS bin, round(p, 6) + 0.0 AS power FROM pw32",
        *BASE, FX32, PW32,
    ),
)
def power_spectrum(spark, sf_dir):
    return rounded(powered(spark, sf_dir).select("rec_id", "frame", F.posexplode("power").alias("bin", "power")), "power")


@query(
    "mel_spectrum",
    "P7",
    X.sql(
        "SELECT rec_id, CAST(frame AS INTEGER) AS frame, CAST(band AS INTEGER) AS band, round(m, 7) + 0.0 AS mel FROM mel32",
        *BASE, FX32, PW32, MEL32,
    ),
)
def mel_spectrum(spark, sf_dir):
    melled = P.mel_spectrogram(X.clips(spark, sf_dir).select("rec_id", "samples"), SMALL)
    framed = melled.select("rec_id", F.posexplode("mel").alias("frame", "_m"))
    return rounded(framed.select("rec_id", "frame", F.posexplode("_m").alias("band", "mel")), "mel", digits=7)


LOG_MEL_SELECT = """SELECT rec_id, CAST(frame AS INTEGER) AS frame, CAST(band AS INTEGER) AS band, round(greatest(d, -80), 5) + 0.0 AS db FROM (
  SELECT *, d0 - max(d0) OVER (PARTITION BY rec_id) AS d FROM (SELECT *, 10 * log10(greatest(1e-10, m)) AS d0 FROM mel32) a) b"""


def tidy_log_mel(spectrogram):
    return rounded(spectrogram.select("rec_id", "frame", F.posexplode("mel").alias("band", "db")), "db", digits=5)


@query("log_mel", "P8", X.sql(LOG_MEL_SELECT, *BASE, FX32, PW32, MEL32))
def log_mel(spark, sf_dir):
    return tidy_log_mel(P.log_mel(X.clips(spark, sf_dir), SMALL))


QUANTISED_SQL = """pcm AS (SELECT rec_id, i, floor(x * 32767 + 0.5) / 32768.0 AS x FROM clip)"""


def wav_files(spark, sf_dir):
    """The clips as WAV bytes, with some rows spoiled."""
    waves = X.clips(spark, sf_dir)
    files = waves.select("rec_id", encode_wav(F.col("samples"), F.col("sample_rate")).alias("content"))
    spoiled = (
        F.when(F.col("rec_id") % 17 == 0, F.lit(b""))
        .when(F.col("rec_id") % 17 == 1, F.lit(b"not a wav file"))
        .otherwise(F.col("content"))
    )
    return files.withColumn("content", spoiled)


@query(
    "wav_decode",
    "S4",
    X.sql(
        """SELECT rec_id, CASE WHEN ok THEN 16000 END AS sample_rate, CASE WHEN ok THEN 1 END AS channels, CASE WHEN ok THEN n END AS n_samples,
       CASE WHEN ok THEN round(s, 5) + 0.0 END AS total, NOT ok AS failed
FROM (SELECT rec_id, rec_id % 17 > 1 AS ok, CAST(count(*) AS INTEGER) AS n, sum(x) AS s FROM pcm GROUP BY rec_id) t""",
        *X.CLIP_VIEWS, QUANTISED_SQL,
    ),
)
def wav_decode(spark, sf_dir):
    decoded = decode_wav(wav_files(spark, sf_dir))
    samples = F.col("samples").cast("array<double>")
    return decoded.select(
        "rec_id", "sample_rate", "channels",
        F.when(samples.isNotNull(), F.size(samples)).alias("n_samples"),
        r6(total(samples), 5).alias("total"),
        F.col("error").isNotNull().alias("failed"),
    )


@query(
    "preprocess_wav",
    "P9",
    X.sql(
        LOG_MEL_SELECT,
        X.CLIP_SQL, QUANTISED_SQL,
        "unit AS (SELECT rec_id, i, x / max(abs(x)) OVER (PARTITION BY rec_id) AS x FROM pcm WHERE rec_id % 17 > 1)",
        "len AS (SELECT rec_id, count(*) AS n FROM unit GROUP BY rec_id)",
        frames_sql("fx32", 32, "len", "unit"), PW32, MEL32,
    ),
)
def preprocess_wav(spark, sf_dir):
    waves = P.prepare_waves(decode_wav(wav_files(spark, sf_dir)))
    return tidy_log_mel(P.log_mel(waves, SMALL))


# Doubling the rate: a sinc of cutoff 0.96 over 34 samples to each side, under a Kaiser window of beta 12
# whose Bessel function is its power series.
TAP_SQL = """tap AS (
  SELECT p, j, 0.96 * CASE WHEN d = 0 THEN 1 ELSE sin(pi() * 0.96 * d) / (pi() * 0.96 * d) END
         * sum(pow(36 * greatest(0, 1 - d * d / 1156), k) / pow(gamma(k + 1), 2)) / sum(pow(36.0, k) / pow(gamma(k + 1), 2)) AS w
  FROM (SELECT p, j, j - 34 - p / 2.0 AS d FROM (SELECT unnest(range(2)) AS p) a, (SELECT unnest(range(68)) AS j) b) t,
       (SELECT unnest(range(41)) AS k) s GROUP BY p, j, d)"""


@query(
    "resample",
    "P2",
    X.sql(
        """SELECT rec_id, 16000 AS sample_rate, i, round(x, 6) + 0.0 AS v FROM clip WHERE rec_id % 2 <> 0
UNION ALL
SELECT o.rec_id, 16000, CAST(o.m AS INTEGER), round(sum(c.x * t.w), 6) + 0.0
FROM (SELECT rec_id, unnest(range(2 * n)) AS m FROM len WHERE rec_id % 2 = 0) o
JOIN tap t ON t.p = o.m % 2 JOIN clip c ON c.rec_id = o.rec_id AND c.i = o.m // 2 + t.j - 34 GROUP BY o.rec_id, o.m""",
        *BASE, TAP_SQL,
    ),
)
def resample(spark, sf_dir):
    waves = X.clips(spark, sf_dir)
    rate = F.when(F.col("rec_id") % 2 == 0, 8000).otherwise(F.col("sample_rate"))
    moved = P.resample_waves(waves.withColumn("sample_rate", rate))
    return rounded(moved.select("rec_id", "sample_rate", F.posexplode("samples").alias("i", "v")), "v")


@query(
    "resample_lengths",
    "P2",
    X.sql(
        """SELECT rec_id, 16000 AS sample_rate, CAST(CASE WHEN rec_id % 2 = 0 THEN ceil(n * 16000 / 11025.0) ELSE n END AS INTEGER) AS n_samples,
       round(CASE WHEN rec_id % 2 = 0 THEN 0 ELSE total END, 6) + 0.0 AS unchanged_total
FROM len JOIN (SELECT rec_id, sum(x) AS total FROM clip GROUP BY rec_id) t USING (rec_id)""",
        *BASE,
    ),
)
def resample_lengths(spark, sf_dir):
    """Lengths after resampling, and the untouched content of recordings already at the rate."""
    waves = X.clips(spark, sf_dir)
    rate = F.when(F.col("rec_id") % 2 == 0, 11025).otherwise(F.col("sample_rate"))
    moved = P.resample_waves(waves.withColumn("sample_rate", rate))
    kept = F.when(F.col("rec_id") % 2 == 0, 0.0).otherwise(total(F.col("samples")))
    return moved.select("rec_id", "sample_rate", F.size("samples").alias("n_samples"), r6(kept).alias("unchanged_total"))


@query(
    "waveform_violations",
    "V5",
    X.sql(
        """SELECT rec_id, CASE WHEN rec_id % 3 = 0 THEN 8000 ELSE 16000 END AS sample_rate, CASE WHEN rec_id % 5 = 0 THEN 2 ELSE 1 END AS channels, violation
FROM (SELECT rec_id, unnest(['not mono', 'samples are double', 'rate is 8000']) AS violation FROM len) t
WHERE violation = 'samples are double' OR (violation = 'not mono' AND rec_id % 5 = 0) OR (violation = 'rate is 8000' AND rec_id % 3 = 0)""",
        *BASE,
    ),
)
def waveform_violations(spark, sf_dir):
    waves = X.clips(spark, sf_dir).withColumns(
        {
            "channels": F.when(F.col("rec_id") % 5 == 0, 2).otherwise(1),
            "sample_rate": F.when(F.col("rec_id") % 3 == 0, 8000).otherwise(16000),
        }
    )
    return P.waveform_violations(waves)


def cepstral(spark, sf_dir):
    return FT.cepstral_frames(X.clips(spark, sf_dir), KEYS, SMALL)


@query(
    "mfcc_frames",
    "F1",
    X.sql(
        "SELECT rec_id, CAST(frame AS INTEGER) AS frame, CAST(c AS INTEGER) AS coefficient, round(v, 5) + 0.0 AS value FROM mfcc",
        *MFCC_VIEWS,
    ),
)
def mfcc_frames(spark, sf_dir):
    framed = cepstral(spark, sf_dir).select("rec_id", F.posexplode("mfcc").alias("frame", "_c"))
    rows = framed.select("rec_id", "frame", F.posexplode("_c").alias("coefficient", "value"))
    return rounded(rows, "value", digits=5)


@query(
    "mfcc_deltas",
    "F2 F3",
    X.sql(
        """SELECT rec_id, CAST(frame AS INTEGER) AS frame, CAST(c AS INTEGER) AS coefficient,
       round(d1, 5) + 0.0 AS delta, round(d2, 5) + 0.0 AS delta2 FROM delta""",
        *DELTA_VIEWS,
    ),
)
def mfcc_deltas(spark, sf_dir):
    deltas = F.arrays_zip("mfcc_delta", "mfcc_delta2")
    framed = cepstral(spark, sf_dir).select("rec_id", F.posexplode(deltas).alias("frame", "d"))
    rows = framed.select(
        "rec_id", "frame", F.posexplode(F.arrays_zip("d.mfcc_delta", "d.mfcc_delta2")).alias("coefficient", "d")
    )
    return rows.select(
        "rec_id", "frame", "coefficient", r6(F.col("d.mfcc_delta"), 5).alias("delta"), r6(F.col("d.mfcc_delta2"), 5).alias("delta2")
    )


def pooled(spark, sf_dir, complete=True):
    return FT.extract(X.clips(spark, sf_dir), KEYS, SMALL, complete)


def temporal(spark, sf_dir):
    """Temporal features of all clips of at least one uncentred frame."""
    return pooled(spark, sf_dir, complete=False).select("rec_id", *FT.TEMPORAL).where("ste_mean IS NOT NULL")


@query("mfcc_features", "F4", X.sql(MFCC_SELECT, *DELTA_VIEWS))
def mfcc_features(spark, sf_dir):
    return rounded(pooled(spark, sf_dir).select("rec_id", *MFCC_NAMES), *MFCC_NAMES, digits=5)


SPECTRAL_NAMES = [
    f"{n}_{s}"
    for n in (*FT.SPECTRAL_SCALARS, *[f"spectral_contrast_band{b}" for b in range(3)])
    for s in ("mean", "std")
]


@query("spectral_features", "F5 F6 F7 F8 F9 F10", X.sql(SPECTRAL_SELECT, *SPECTRAL_VIEWS))
def spectral_features(spark, sf_dir):
    return tidy(pooled(spark, sf_dir, complete=False).select("rec_id", *SPECTRAL_NAMES), SPECTRAL_NAMES)


@query("temporal_features", "F11 F12 F13", X.sql(TEMPORAL_SELECT, *OK, FXOK, TEMPORAL_SQL))
def temporal_features(spark, sf_dir):
    return rounded(temporal(spark, sf_dir), *FT.TEMPORAL, digits=5)


@query("harmonic_features", "F14 F15", X.sql(HARMONIC_SELECT, *OK, FXOK, PWOK, HPSS_SQL))
def harmonic_features(spark, sf_dir):
    return rounded(pooled(spark, sf_dir, complete=False).select("rec_id", *FT.HARMONIC), *FT.HARMONIC, digits=5)


ALL_NAMES = FT.feature_names(SMALL)
FEATURE_VIEWS = (
    *OK, FX64, PW64, MEL64, MFCC_SQL, DELTA_SQL, FXOK, PWOK, SPECTRAL_SQL, TEMPORAL_SQL, HPSS_SQL,
    f"feature AS (SELECT * FROM ({MFCC_SELECT}) a JOIN ({SPECTRAL_SELECT}) b USING (rec_id) "
    f"JOIN ({TEMPORAL_SELECT}) c USING (rec_id) JOIN ({HARMONIC_SELECT}) d USING (rec_id))",
)


@query("feature_rows", "F16", X.sql(f"SELECT rec_id, {', '.join(ALL_NAMES)} FROM feature", *FEATURE_VIEWS))
def feature_rows(spark, sf_dir):
    return tidy(pooled(spark, sf_dir), ALL_NAMES)


@query(
    "feature_vectors",
    "F17",
    X.sql(
        "SELECT f.rec_id, n.position, n.name, round(CAST(CAST(v.value AS FLOAT) AS DOUBLE), 3) + 0.0 AS value FROM feature f, (VALUES "
        + ", ".join(f"({i}, '{n}')" for i, n in enumerate(ALL_NAMES))
        + f") n(position, name) JOIN (UNPIVOT feature ON {', '.join(ALL_NAMES)} INTO NAME name VALUE value) v ON v.rec_id = f.rec_id AND v.name = n.name",
        *FEATURE_VIEWS,
    ),
)
def feature_vectors(spark, sf_dir):
    rows = tidy(pooled(spark, sf_dir), ALL_NAMES)
    vectors = FT.feature_vector(rows, ALL_NAMES)
    at = vectors.select("rec_id", F.posexplode(F.arrays_zip("feature_names", "feature_vector")).alias("position", "f"))
    return at.select(
        "rec_id", "position", F.col("f.feature_names").alias("name"), r6(F.col("f.feature_vector").cast("double"), 3).alias("value")
    )


@query(
    "too_short_recordings",
    "F2 P5",
    X.sql(
        """SELECT rec_id, 16000 AS sample_rate, 1 + n // 16 AS n_frames,
       CASE WHEN n < 32 THEN 'shorter than one frame' ELSE 'too few frames for deltas' END AS violation
FROM len WHERE n < 32 OR 1 + n // 16 < 9""",
        *BASE,
    ),
)
def too_short_recordings(spark, sf_dir):
    return FT.too_short(X.clips(spark, sf_dir), SMALL)
