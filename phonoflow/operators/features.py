"""Features of utterances (D4, D5, D8, D12, D13, D16-D18, D21, D22, D24): one Arrow pass per heavy stage, the rest in the JVM."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phonoflow.functions import kernels as K
from phonoflow.functions.common import let
from phonoflow.functions.signal import lifter_weights

FEATURES = "array<array<double>>"


def to_lists(rows: list[np.ndarray | None], scalar: pa.DataType = pa.float64()) -> pa.Array:  # noqa: B008
    """An Arrow column of matrices; None is null."""
    have = [r for r in rows if r is not None and r.size]
    flat = np.concatenate([r.ravel() for r in have]) if have else np.zeros(0)
    widths = np.concatenate([np.full(len(r), r.shape[1]) for r in rows if r is not None]) if any(r is not None for r in rows) else np.zeros(0, np.int64)
    inner = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(widths)].astype(np.int32)), pa.array(flat, scalar))
    outer = np.r_[0, np.cumsum([0 if r is None else len(r) for r in rows])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(outer), inner, mask=pa.array([r is None for r in rows]))


def matrix(value: pa.Scalar) -> np.ndarray:
    """Frames x dim of one row."""
    rows = value.values
    if rows is None or not len(rows):
        return np.zeros((0, 0))
    return np.asarray(rows.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), -1)


def _stage(f: Callable[[np.ndarray], np.ndarray]):
    """An Arrow function from signals to matrices; null in, or too little audio (F17), gives null."""

    @F.arrow_udf(FEATURES)
    def run(samples: pa.Array) -> pa.Array:
        out: list[np.ndarray | None] = []
        for x in samples:
            try:
                out.append(f(np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64)) if x.is_valid else None)
            except ValueError:
                out.append(None)
        return to_lists(out)

    return run


def mfcc(samples: Column, cfg: K.FeatureConfig = K.FeatureConfig()) -> Column:  # noqa: B008
    """Cepstral features of a signal."""
    return _stage(lambda x: K.mfcc(x, cfg))(samples)


def power_spectra(samples: Column, cfg: K.FeatureConfig = K.FeatureConfig()) -> Column:  # noqa: B008
    """Spectra to be kept for several warps."""

    def f(x: np.ndarray) -> np.ndarray:
        if len(x) < cfg.frame:
            raise ValueError("audio too short for a single frame")
        return K.spectra(x, cfg)

    return _stage(f)(samples)


def dft_power(frame: Column, n_fft: int) -> Column:
    """D4, D5 of one frame per row."""

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.list_(pa.float64()))
        p = K.power_spectrum(np.asarray(x.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(x), -1), n_fft)
        return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * p.shape[1], pa.array(p.ravel()))

    return run(frame)


def cepstra(frame: Column, n_fft: int, bank: np.ndarray, count: int, lifter: int = 22) -> Column:
    """D5, D9-D11 of one frame per row: spectrum, filters and transform as matrix products over a batch."""

    @F.arrow_udf("array<double>")
    def run(x: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.list_(pa.float64()))
        p = K.power_spectrum(np.asarray(x.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(x), -1), n_fft)
        c = np.log(np.maximum(p @ bank.T, 1e-30)) @ K.dct_matrix(len(bank), count).T * np.array(lifter_weights(count, lifter))
        return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * count, pa.array(c.ravel()))

    return run(frame).alias("cepstra")


def features_from_spectra(spectra: Column, cfg: K.FeatureConfig = K.FeatureConfig()) -> Column:  # noqa: B008
    """D17."""

    @F.arrow_udf(FEATURES)
    def run(s: pa.Array) -> pa.Array:
        return to_lists([K.from_spectra(matrix(x), cfg) if x.is_valid and len(x.values) else None for x in s])

    return run(spectra)


def warped(samples: Column, score: Callable[[np.ndarray], float], cfg: K.FeatureConfig = K.FeatureConfig()) -> Column:  # noqa: B008
    """struct(features, alpha) of the warp that ``score`` prefers. ``score`` is shipped to the executors."""

    @F.arrow_udf(f"struct<features:{FEATURES},alpha:double>")
    def run(x: pa.Array) -> pa.Array:
        got = [K.best_warp(np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64), cfg, score) if v.is_valid and len(v.values) >= cfg.frame else (None, None) for v in x]
        return pa.StructArray.from_arrays([to_lists([g[0] for g in got]), pa.array([g[1] for g in got], pa.float64())], ["features", "alpha"])

    return run(samples)


def best_alpha(scores: DataFrame, key: str) -> DataFrame:
    """D18, O9 in relational form: of (key, alpha, score) the best score, the smaller alpha on ties."""
    best = F.max_by("alpha", F.struct(F.col("score"), -F.col("alpha")))
    return scores.groupBy(key).agg(best.alias("alpha"), F.max("score").alias("score"))


def mel_table(spark: SparkSession, filters: int, n_fft: int, rate: int, low: float, high: float, alpha: float = 1.0) -> DataFrame:
    """D8 as (filter, bin, weight), non-zero weights only."""
    bank = K.mel_bank(filters, n_fft, rate, low, high, alpha)
    return spark.createDataFrame([(int(i), int(j), float(bank[i, j])) for i, j in zip(*np.nonzero(bank), strict=True)], "filter int, bin int, weight double")


def mean_normalised(rows: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """A value less its mean over ``by``."""
    return rows.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(*by)))


def silence_bounds(energy: Column) -> Column:
    """struct(start, end) of the speech within an array of energies, by the first and last quarter of the frames."""

    def loud(e: Column) -> Column:
        low, high = F.array_min(e), F.array_max(e)
        return let(F.struct(low.alias("low"), (low + F.lit(0.3) * (high - low)).alias("at")), lambda b: F.transform(e, lambda v: v > b["at"]))

    def find(x: Column) -> Column:
        n = F.size(x)
        limit = F.floor(n / 4).cast("int")
        run = lambda y: F.coalesce(F.nullif(F.array_position(F.slice(y, 1, limit), F.lit(True)), F.lit(0).cast("bigint")) - 1, limit)
        return F.struct(F.greatest(run(x), F.lit(3)).alias("a"), (n - F.greatest(run(F.reverse(x)), F.lit(3))).alias("z"), n.alias("n"))

    def bounds(b: Column) -> Column:
        crossed = b["a"] >= b["z"]
        start, end = F.when(crossed, F.lit(3)).otherwise(b["a"]), F.when(crossed, b["n"] - 3).otherwise(b["z"])
        whole = (b["n"] < 6) | (end <= start)
        return F.struct(F.when(whole, F.lit(0)).otherwise(start).cast("int").alias("start"), F.when(whole, b["n"]).otherwise(end).cast("int").alias("end"))

    return let(let(let(energy, loud), find), bounds)


def uniform_segments(phonemes: Column, energy: Column, min_frames: int = 3) -> Column:
    """Array of (phoneme, start, end): frames dealt evenly, the first phonemes one more; silence at the edges apart.

    A segment under ``min_frames`` is left out. All that are behind it are as short, so none moves up into its place (Q6).
    """
    none = F.array().cast("array<struct<phoneme:string,start:int,end:int>>")
    as_int = lambda c, name: c.cast("int").alias(name)

    def plan(d: Column) -> Column:
        n, total = F.size(d.ph), F.size(d.e)
        lead, trail = (n > 0) & (F.get(d.ph, F.lit(0)) == "sil"), (n > 1) & (F.get(d.ph, n - 1) == "sil")
        one = lambda c: F.when(c, F.lit(1)).otherwise(F.lit(0))
        inner = F.slice(d.ph, one(lead) + 1, F.greatest(n - one(lead) - one(trail), F.lit(0)))
        span = F.when(lead | trail, silence_bounds(d.e)).otherwise(F.struct(F.lit(0).alias("start"), as_int(total, "end")))
        return F.struct(F.when(n <= total, inner).otherwise(F.array().cast("array<string>")).alias("ph"), span.alias("b"), (lead & (n <= total)).alias("lead"), (trail & (n <= total)).alias("trail"), as_int(total, "total"))

    def dealt(d: Column) -> Column:
        k, frames = F.size(d.ph), d.b.end - d.b.start
        shares = F.struct(F.floor(frames / F.greatest(k, F.lit(1))).cast("int").alias("each"), F.pmod(frames, F.greatest(k, F.lit(1))).alias("rest"), d.b.start.alias("start"))

        def made(s: Column) -> Column:
            first = lambda i: s["start"] + i * s["each"] + F.least(i, s["rest"])
            return F.transform(d.ph, lambda p, i: F.struct(p.alias("phoneme"), as_int(first(i), "start"), as_int(first(i + 1), "end")))

        return F.when((k > 0) & (frames >= k), F.filter(let(shares, made), lambda s: s.end - s.start >= min_frames)).otherwise(none)

    def edge(on: Column, a: Column, b: Column) -> Column:
        return F.when(on & (b - a >= min_frames), F.array(F.struct(F.lit("sil").alias("phoneme"), as_int(a, "start"), as_int(b, "end")))).otherwise(none)

    whole = let(F.struct(phonemes.alias("ph"), energy.alias("e")), plan)
    return let(whole, lambda d: F.concat(edge(d.lead, F.lit(0), d.b.start), dealt(d), edge(d.trail, d.b.end, d.total)))
