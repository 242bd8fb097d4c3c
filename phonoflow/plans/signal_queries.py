"""Signal queries: embeddings as 64-sample signals, events as one ordered signal per user."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoflow.functions import kernels as K
from phonoflow.functions import signal as D
from phonoflow.operators import features as FE
from phonoflow.plans.register import query
from phonoflow.plans.register import source as table

N_FFT, FILTERS, CEPSTRA = 64, 8, 6
_X = "e AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings)"


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, label, x)."""
    return table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))


def by_user(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, x): each user's values in the order of time, then event."""
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("s"))
    return rows.select("user_id", F.transform("s", lambda r: F.coalesce(r.value, F.lit(0.0))).alias("x"))


_U = "u AS (SELECT user_id, list(coalesce(value, 0.0) ORDER BY ts, event_id) AS x FROM events GROUP BY user_id)"


def spread(df: DataFrame, array: Column, name: str = "v", places: int = 6) -> DataFrame:
    """A row per element: (other columns, i, v)."""
    key = df.columns[0]
    return df.select(key, F.posexplode(array).alias("i", name)).withColumn(name, F.round(name, places) + 0.0)


def _spread(source: str, array: str, key: str = "vec_id", places: int = 6, name: str = "v") -> str:
    return f"SELECT {key}, CAST(i - 1 AS INTEGER) AS i, round(a[i], {places}) + 0.0 AS {name} FROM (SELECT {key}, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT {key}, {array} AS a FROM {source}))"


_PRE = "list_transform(range(1, len(x) + 1), lambda i: CASE WHEN i = 1 THEN x[1] ELSE x[i] - 0.97::DOUBLE * x[i - 1] END)"


@query(f"WITH {_X} " + _spread("e", _PRE))
def preemphasis(spark: SparkSession, sf: str) -> DataFrame:
    """D1."""
    e = embeddings(spark, sf)
    return spread(e.select("vec_id", "x"), D.pre_emphasis(F.col("x")))


@query(f"WITH {_U} " + _spread("u", _PRE, "user_id"))
def preemphasis_events(spark: SparkSession, sf: str) -> DataFrame:
    """D1 over users' events."""
    return spread(by_user(spark, sf), D.pre_emphasis(F.col("x")))


@query(f"""WITH {_X}, f AS (SELECT vec_id, x, unnest(range(0, 7)) AS frame FROM e)
SELECT vec_id, CAST(frame AS INTEGER) AS frame, CAST(i AS INTEGER) AS i, round(x[frame * 8 + i + 1] * (0.54 - 0.46 * cos(2 * pi() * i / 15)), 6) + 0.0 AS v FROM (SELECT vec_id, x, frame, unnest(range(0, 16)) AS i FROM f)""")
def framing(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of 16 samples every 8, under a Hamming window."""
    rows = embeddings(spark, sf).select("vec_id", F.posexplode(D.frames(F.col("x"), 16, 8)).alias("frame", "f"))
    return rows.select("vec_id", "frame", F.posexplode(D.windowed(F.col("f"), 16)).alias("i", "v")).withColumn("v", F.round("v", 6) + 0.0)


_POWER = f"""p AS (SELECT vec_id, label, bin, (power(sum(x[n + 1] * cos(2 * pi() * bin * n / {N_FFT})), 2) + power(sum(x[n + 1] * sin(2 * pi() * bin * n / {N_FFT})), 2)) / {N_FFT} AS power
 FROM (SELECT vec_id, label, x, unnest(range(0, {N_FFT})) AS n FROM e), (SELECT unnest(range(0, {N_FFT // 2 + 1})) AS bin) GROUP BY vec_id, label, bin)"""


@query(f"WITH {_X}, {_POWER} SELECT vec_id, CAST(bin AS INTEGER) AS bin, round(power, 6) + 0.0 AS power FROM p")
def power_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    """The transform's butterflies are those of the numeric library."""
    rows = embeddings(spark, sf).select("vec_id", F.posexplode(FE.dft_power(F.col("x"), N_FFT)).alias("bin", "power"))
    return rows.withColumn("power", F.round("power", 6) + 0.0)


_MEL = f"""m AS (SELECT i, CAST(floor(700 * (power(10, (i * 2595 * log10(1 + 8000 / 700.0::DOUBLE) / {FILTERS + 1}) / 2595) - 1) * {N_FFT + 1} / 16000) AS INTEGER) AS edge FROM (SELECT unnest(range(0, {FILTERS + 2})) AS i)),
w AS (SELECT a.i AS filter, bin, CASE WHEN bin >= a.edge AND bin < b.edge THEN (bin - a.edge)::DOUBLE / (b.edge - a.edge) WHEN bin >= b.edge AND bin <= c.edge AND c.edge > b.edge THEN (c.edge - bin)::DOUBLE / (c.edge - b.edge) ELSE 0 END AS weight
 FROM m a JOIN m b ON b.i = a.i + 1 JOIN m c ON c.i = a.i + 2, (SELECT unnest(range(0, {N_FFT // 2 + 1})) AS bin))"""
_LOGMEL = "l AS (SELECT vec_id, filter, ln(greatest(sum(power * weight), 1e-30)) AS e FROM p JOIN w USING (bin) GROUP BY vec_id, filter)"


@query(f"WITH {_MEL} SELECT CAST(filter AS INTEGER) AS filter, CAST(bin AS INTEGER) AS bin, round(weight, 9) AS weight FROM w WHERE weight <> 0")
def mel_filters(spark: SparkSession, sf: str) -> DataFrame:
    """D6, D8."""
    return FE.mel_table(spark, FILTERS, N_FFT, 16000, 0.0, 8000.0).withColumn("weight", F.round("weight", 9))


def _log_mel(spark: SparkSession, sf: str) -> DataFrame:
    bank = K.mel_bank(FILTERS, N_FFT, 16000, 0.0, 8000.0)
    return embeddings(spark, sf).select("vec_id", D.log_mel(FE.dft_power(F.col("x"), N_FFT), bank.tolist()).alias("e"))


@query(f"WITH {_X}, {_POWER}, {_MEL}, {_LOGMEL} SELECT vec_id, CAST(filter AS INTEGER) AS i, round(e, 5) + 0.0 AS v FROM l")
def mel_energies(spark: SparkSession, sf: str) -> DataFrame:
    """D9."""
    return spread(_log_mel(spark, sf), F.col("e"), places=5)


@query(f"""WITH {_X}, {_POWER}, {_MEL}, {_LOGMEL}
SELECT vec_id, CAST(k AS INTEGER) AS i, round((1 + 11 * sin(pi() * k / 22)) * sum(e * cos(pi() * k * (filter + 0.5) / {FILTERS})), 5) + 0.0 AS v FROM l, (SELECT unnest(range(0, {CEPSTRA})) AS k) GROUP BY vec_id, k""")
def cepstra(spark: SparkSession, sf: str) -> DataFrame:
    """From the signal in the one Arrow pass that makes its spectrum."""
    bank = K.mel_bank(FILTERS, N_FFT, 16000, 0.0, 8000.0)
    return spread(embeddings(spark, sf).select("vec_id", FE.cepstra(F.col("x"), N_FFT, bank, CEPSTRA)), F.col("cepstra"), places=5)


@query(f"""WITH {_X}, {_POWER}, {_MEL}, {_LOGMEL}
SELECT vec_id, CAST(k AS INTEGER) AS i, round(sum(e * cos(pi() * k * (filter + 0.5) / {FILTERS})), 5) + 0.0 AS v FROM l, (SELECT unnest(range(0, {CEPSTRA})) AS k) GROUP BY vec_id, k""")
def cosine_transform(spark: SparkSession, sf: str) -> DataFrame:
    """D10 as an expression over given energies."""
    return spread(_log_mel(spark, sf), D.dct(F.col("e"), FILTERS, CEPSTRA), places=5)


@query(f"WITH {_X}, l AS (SELECT vec_id, label, i, x[i] AS v FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM e)) SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(v - avg(v) OVER (PARTITION BY label, i), 6) + 0.0 AS v FROM l")
def mean_normalisation(spark: SparkSession, sf: str) -> DataFrame:
    """A label's vectors as the frames of an utterance."""
    long = embeddings(spark, sf).select("vec_id", "label", F.posexplode("x").alias("i", "v"))
    return FE.mean_normalised(long, ["label", "i"]).select("vec_id", "i", (F.round("v", 6) + 0.0).alias("v"))


def _delta_sql(x: str) -> str:
    at = lambda k: f"{x}[least(i + {k}, len({x}))] - {x}[greatest(i - {k}, 1)]"
    return f"list_transform(range(1, len({x}) + 1), lambda i: (({at(1)}) + 2 * ({at(2)})) / 10)"


@query(f"WITH {_X}, d AS (SELECT vec_id, {_delta_sql('x')} AS d1 FROM e), f AS (SELECT vec_id, d1, {_delta_sql('d1')} AS d2 FROM d) SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(d1[i], 9) + 0.0 AS d1, round(d2[i], 9) + 0.0 AS d2 FROM (SELECT *, unnest(range(1, len(d1) + 1)) AS i FROM f)")
def deltas(spark: SparkSession, sf: str) -> DataFrame:
    """D14, D15, W3."""
    one = embeddings(spark, sf).select("vec_id", D.delta_series(F.col("x")).alias("d1"))
    two = one.select("vec_id", F.posexplode(F.arrays_zip("d1", D.delta_series(F.col("d1")).alias("d2"))).alias("i", "z"))
    return two.select("vec_id", "i", (F.round("z.d1", 9) + 0.0).alias("d1"), (F.round("z.d2", 9) + 0.0).alias("d2"))


@query(f"""WITH {_X}, s AS (SELECT vec_id, x, f AS factor, CAST(floor(len(x) / f) AS BIGINT) AS n FROM e, (SELECT unnest([1.0, 0.9, 0.95, 1.05, 1.1]::DOUBLE[]) AS f)),
r AS (SELECT vec_id, x, factor, i, i * factor AS place, CAST(floor(i * factor) AS BIGINT) AS k FROM (SELECT *, unnest(range(0, n)) AS i FROM s))
SELECT vec_id, factor, CAST(i AS INTEGER) AS i, round(CASE WHEN k + 1 < len(x) THEN x[k + 1] * (1 - (place - k)) + x[k + 2] * (place - k) ELSE x[least(k, len(x) - 1) + 1] END, 6) + 0.0 AS v FROM r""")
def speed_perturb(spark: SparkSession, sf: str) -> DataFrame:
    """D19, D20."""
    rows = embeddings(spark, sf).select("vec_id", "x", F.explode(D.augmentation_factors(F.lit(False))).alias("factor"))
    return rows.select("vec_id", "factor", F.posexplode(D.speed_perturbed(F.col("x"), F.col("factor"))).alias("i", "v")).withColumn("v", F.round("v", 6) + 0.0)


_WARP = "CASE WHEN f <= 100 THEN f * (alpha * 100) / 100 WHEN f < 7500 THEN f * alpha ELSE 7500 * alpha + (f - 7500) * (8000 - 7500 * alpha) / 500 END"
_GRID = "g AS (SELECT round(0.82 + 0.02 * a, 2)::DOUBLE AS alpha FROM (SELECT unnest(range(0, 20)) AS a))"


def _alphas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a,) for a in K.ALPHAS], "alpha double")


@query(f"WITH {_GRID} SELECT alpha, CAST(f AS DOUBLE) AS f, round({_WARP}, 6) AS warped, round(2595 * log10(1 + f / 700.0::DOUBLE), 6) AS mel FROM g, (SELECT unnest(range(0, 8001, 50)) AS f)")
def vtln_warp(spark: SparkSession, sf: str) -> DataFrame:
    """D6, D7."""
    f = spark.range(0, 8001, 50).select(F.col("id").cast("double").alias("f"))
    return _alphas(spark).crossJoin(f).select("alpha", "f", F.round(D.warp_frequency(F.col("f"), F.col("alpha")), 6).alias("warped"), F.round(D.hz_to_mel(F.col("f")), 6).alias("mel"))


@query(f"""WITH {_X}, {_GRID}, s AS (SELECT vec_id, alpha, round(-abs(list_sum(x[1:32]) * alpha - list_sum(x[33:64])), 6) AS score FROM e, g)
SELECT vec_id, alpha, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, alpha) AS r FROM s) WHERE r = 1""")
def vtln_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """The best of the grid by a score of the user's, the first of equals."""
    half = lambda k: F.aggregate(F.slice("x", 1 + 32 * k, 32), F.lit(0.0), lambda t, v: t + v)
    e = embeddings(spark, sf).select("vec_id", half(0).alias("a"), half(1).alias("b"))
    scores = e.crossJoin(F.broadcast(_alphas(spark))).select("vec_id", "alpha", F.round(-F.abs(F.col("a") * F.col("alpha") - F.col("b")), 6).alias("score"))
    return FE.best_alpha(scores, "vec_id")


@query("""WITH v AS (SELECT user_id, coalesce(value, 0.0) AS c, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, count(*) OVER (PARTITION BY user_id) AS n FROM events),
l AS (SELECT *, c > min(c) OVER (PARTITION BY user_id) + 0.3::DOUBLE * (max(c) OVER (PARTITION BY user_id) - min(c) OVER (PARTITION BY user_id)) AS loud FROM v),
b AS (SELECT user_id, n, greatest(coalesce(min(t) FILTER (loud AND t < n // 4), n // 4), 3) AS a, n - greatest(coalesce(min(n - 1 - t) FILTER (loud AND n - 1 - t < n // 4), n // 4), 3) AS z FROM l GROUP BY user_id, n),
c AS (SELECT user_id, n, CASE WHEN a >= z THEN 3 ELSE a END AS a, CASE WHEN a >= z THEN n - 3 ELSE z END AS z FROM b)
SELECT user_id, CAST(CASE WHEN n < 6 OR z <= a THEN 0 ELSE a END AS INTEGER) AS "start", CAST(CASE WHEN n < 6 OR z <= a THEN n ELSE z END AS INTEGER) AS "end" FROM c""")
def silence_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """D21."""
    return by_user(spark, sf).select("user_id", FE.silence_bounds(F.col("x")).alias("b")).select("user_id", "b.start", "b.end")


@query(f"""WITH {_U} SELECT user_id, CAST(t - 1 AS INTEGER) AS t, CAST(k + 2 AS INTEGER) AS k, x[least(greatest(t + k, 1), len(x))] AS v
FROM (SELECT user_id, x, unnest(range(1, len(x) + 1)) AS t FROM u), (SELECT unnest([-2, -1, 0, 1, 2]) AS k)""")
def context_stack(spark: SparkSession, sf: str) -> DataFrame:
    """D23, W4."""
    rows = by_user(spark, sf).select("user_id", F.posexplode(D.context_stack(F.transform("x", lambda v: F.array(v)), 2)).alias("t", "w"))
    return rows.select("user_id", "t", F.posexplode("w").alias("k", "v"))


@query("""WITH v AS (SELECT user_id, event_type, row_number() OVER w - 1 AS t, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY t) AS run FROM v)
SELECT user_id, event_type, CAST(min(t) AS INTEGER) AS "start", CAST(max(t) + 1 AS INTEGER) AS "end" FROM r GROUP BY user_id, run, event_type""")
def run_length_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of one event type by position, so that equal neighbours in two runs stay apart."""
    s = table(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("s"))
    cuts = F.filter(F.transform("s", lambda r, i: F.when((i == 0) | (F.get("s", i - 1).event_type != r.event_type), i)), lambda i: i.isNotNull())
    rows = s.withColumn("c", cuts).select("user_id", "s", F.posexplode("c").alias("k", "start"), "c")
    return rows.select("user_id", F.get("s", F.col("start")).event_type.alias("event_type"), "start", F.coalesce(F.get("c", F.col("k") + 1), F.size("s")).cast("int").alias("end"))


CONFIG = K.FeatureConfig(rate=1600, frame_ms=20.0, shift_ms=5.0, filters=6, cepstra=4, low=0.0, high=800.0, n_fft=32, lifter=22)


_FRAMES, _LEN, _HOP, _BINS, _MELS, _CEPS = 5, 32, 8, 17, 6, 4
_MFCC = f"""{_X}, y AS (SELECT vec_id, {_PRE} AS y FROM e),
f AS (SELECT vec_id, t, n, y[t * {_HOP} + n + 1] * (0.54 - 0.46 * cos(2 * pi() * n / {_LEN - 1})) AS v FROM y, (SELECT unnest(range(0, {_FRAMES})) AS t), (SELECT unnest(range(0, {_LEN})) AS n)),
p AS (SELECT vec_id, t, bin, (power(sum(v * cos(2 * pi() * bin * n / {_LEN})), 2) + power(sum(v * sin(2 * pi() * bin * n / {_LEN})), 2)) / {_LEN} AS power FROM f, (SELECT unnest(range(0, {_BINS})) AS bin) GROUP BY ALL),
m AS (SELECT i, CAST(floor(700 * (power(10, (i * 2595 * log10(1 + 800 / 700.0::DOUBLE) / {_MELS + 1}) / 2595) - 1) * {_LEN + 1} / 1600) AS INTEGER) AS edge FROM (SELECT unnest(range(0, {_MELS + 2})) AS i)),
w AS (SELECT a.i AS filter, bin, CASE WHEN bin >= a.edge AND bin < b.edge THEN (bin - a.edge)::DOUBLE / (b.edge - a.edge) WHEN bin >= b.edge AND bin <= c.edge AND c.edge > b.edge THEN (c.edge - bin)::DOUBLE / (c.edge - b.edge) ELSE 0 END AS weight
 FROM m a JOIN m b ON b.i = a.i + 1 JOIN m c ON c.i = a.i + 2, (SELECT unnest(range(0, {_BINS})) AS bin)),
l AS (SELECT vec_id, t, filter, ln(greatest(sum(power * weight), 1e-30)) AS e FROM p JOIN w USING (bin) GROUP BY ALL),
c AS (SELECT vec_id, t, k, (1 + 11 * sin(pi() * k / 22)) * sum(e * cos(pi() * k * (filter + 0.5) / {_MELS})) AS c FROM l, (SELECT unnest(range(0, {_CEPS})) AS k) GROUP BY vec_id, t, k),
z AS (SELECT vec_id, k, list(c ORDER BY t) AS c FROM c GROUP BY ALL), n AS (SELECT vec_id, k, list_transform(c, lambda v: v - list_avg(c)) AS c FROM z),
d AS (SELECT *, {_delta_sql("c")} AS d1 FROM n), dd AS (SELECT *, {_delta_sql("d1")} AS d2 FROM d)"""


@query(f"WITH {_MFCC} SELECT vec_id, CAST(t AS INTEGER) AS frame, CAST(g * {_CEPS} + k AS INTEGER) AS i, round(CASE g WHEN 0 THEN c[t + 1] WHEN 1 THEN d1[t + 1] ELSE d2[t + 1] END, 4) + 0.0 AS v FROM dd, (SELECT unnest(range(0, {_FRAMES})) AS t), (SELECT unnest(range(0, 3)) AS g)")
def mfcc(spark: SparkSession, sf: str) -> DataFrame:
    """The whole chain on signals of 64 samples, with a configuration that fits them."""
    rows = embeddings(spark, sf).select("vec_id", F.posexplode(FE.mfcc(F.col("x"), CONFIG)).alias("frame", "f"))
    return rows.select("vec_id", "frame", F.posexplode("f").alias("i", "v")).withColumn("v", F.round("v", 4) + 0.0)


@query(f"WITH {_MFCC} SELECT vec_id, CAST(t AS INTEGER) AS frame, CAST(g * {_CEPS} + k AS INTEGER) AS i, round(CASE g WHEN 0 THEN c[t + 1] WHEN 1 THEN d1[t + 1] ELSE d2[t + 1] END, 4) + 0.0 AS v FROM dd, (SELECT unnest(range(0, {_FRAMES})) AS t), (SELECT unnest(range(0, 3)) AS g)")
def features_of_spectra(spark: SparkSession, sf: str) -> DataFrame:
    """Spectra as a column of their own, and the features made of them."""
    kept = embeddings(spark, sf).select("vec_id", FE.power_spectra(F.col("x"), CONFIG).alias("s"))
    rows = kept.select("vec_id", F.posexplode(FE.features_from_spectra(F.col("s"), CONFIG)).alias("frame", "f"))
    return rows.select("vec_id", "frame", F.posexplode("f").alias("i", "v")).withColumn("v", F.round("v", 4) + 0.0)


@query("SELECT vec_id, CAST(CASE WHEN vec_id % 65 < 32 THEN -1 ELSE 1 + (vec_id % 65 - 32) // 8 END AS INTEGER) AS n_frames FROM embeddings")
def short_audio(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of 0 to 64 samples; those with less than a frame have no features."""
    rows = embeddings(spark, sf).select("vec_id", F.slice("x", 1, F.pmod("vec_id", F.lit(65)).cast("int")).alias("x"))
    return rows.select("vec_id", F.coalesce(F.size(FE.mfcc(F.col("x"), CONFIG)), F.lit(-1)).alias("n_frames"))


@query(f"WITH {_X} SELECT vec_id, round(greatest(x[1], x[2]) + ln(1 + exp(-abs(x[1] - x[2]))), 9) AS added, CASE WHEN x[1] = x[2] THEN -1e30 ELSE round(greatest(x[1], x[2]) + ln(1 - exp(-abs(x[1] - x[2]))), 6) END AS subtracted FROM e")
def log_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    """Sums and differences of numbers given by their logs."""

    @F.arrow_udf("struct<added: double, subtracted: double>")
    def run(x: pa.Array) -> pa.Array:
        v = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)[:, :2] if len(x) else np.zeros((0, 2))
        less = [K.log_sub(float(max(a, b)), float(min(a, b))) for a, b in v]
        return pa.StructArray.from_arrays([pa.array(np.round(K.log_sum_exp(v), 9) if len(v) else v[:, 0]), pa.array([y if y < -1e29 else round(y, 6) for y in less], pa.float64())], ["added", "subtracted"])

    return embeddings(spark, sf).select("vec_id", run(F.col("x")).alias("r")).select("vec_id", "r.added", "r.subtracted")


@query(f"""WITH {_X}, t AS (SELECT vec_id, len(x) AS n, ['sil', 'a', 'k', 'i', 'sil'] AS ph FROM e)
SELECT vec_id, CASE WHEN p = 0 OR p = 4 THEN 'sil' ELSE ph[p + 1] END AS phoneme, CAST(CASE p WHEN 0 THEN 0 WHEN 4 THEN z ELSE a + (p - 1) * ((z - a) // 3) + least(p - 1, (z - a) % 3) END AS INTEGER) AS "start",
 CAST(CASE p WHEN 0 THEN a WHEN 4 THEN n ELSE a + p * ((z - a) // 3) + least(p, (z - a) % 3) END AS INTEGER) AS "end"
FROM (SELECT *, unnest(range(0, 5)) AS p FROM (
 SELECT t.vec_id, n, ph, CASE WHEN n < 6 OR z2 <= a2 THEN 0 ELSE a2 END AS a, CASE WHEN n < 6 OR z2 <= a2 THEN n ELSE z2 END AS z FROM t JOIN (
  SELECT vec_id, CASE WHEN a1 >= z1 THEN 3 ELSE a1 END AS a2, CASE WHEN a1 >= z1 THEN m - 3 ELSE z1 END AS z2 FROM (
   SELECT vec_id, m, greatest(coalesce(min(i) FILTER (loud AND i < m // 4), m // 4), 3) AS a1, m - greatest(coalesce(min(m - 1 - i) FILTER (loud AND m - 1 - i < m // 4), m // 4), 3) AS z1 FROM (
    SELECT vec_id, len(x) AS m, i, x[i + 1] > list_min(x) + 0.3::DOUBLE * (list_max(x) - list_min(x)) AS loud FROM (SELECT *, unnest(range(0, len(x))) AS i FROM e)) GROUP BY vec_id, m)) USING (vec_id)))""")
def uniform_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Three phonemes between silences, evenly."""
    ph = F.array(*[F.lit(p) for p in ("sil", "a", "k", "i", "sil")])
    rows = embeddings(spark, sf).select("vec_id", F.explode(FE.uniform_segments(ph, F.col("x"))).alias("s"))
    return rows.select("vec_id", "s.phoneme", "s.start", "s.end")


@query(f"WITH {_X} SELECT vec_id, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] * x[i])), 6) AS dot, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - 0.5) * (x[i] - 0.5) * 2)), 6) AS mahalanobis FROM e")
def vector_kernels(spark: SparkSession, sf: str) -> DataFrame:
    """I3, I4, I8."""
    e = embeddings(spark, sf)
    same = lambda v: F.transform("x", lambda _: F.lit(v))
    return e.select("vec_id", F.round(D.dot(F.col("x"), F.col("x")), 6).alias("dot"), F.round(D.mahalanobis(F.col("x"), same(0.5), same(2.0)), 6).alias("mahalanobis"))


