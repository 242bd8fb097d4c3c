"""Signal expressions on arrays of doubles (D1-D3, D6-D11, D14, D15, D19, D20, D23). All stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from phonoflow.functions.common import let

FACTORS = (1.0, 0.9, 0.95, 1.05, 1.1)
KNEE_LOW, KNEE_HIGH = 100.0, 7500.0


def constants(values: Sequence[float]) -> Column:
    """An array literal of doubles."""
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    """I8: sum of products."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def mahalanobis(x: Column, mean: Column, inv_var: Column) -> Column:
    """Sum of squared distances over variances; 0 for empty arrays."""
    return F.aggregate(F.arrays_zip(x.alias("x"), mean.alias("m"), inv_var.alias("v")), F.lit(0.0), lambda s, t: s + (t.x - t.m) * (t.x - t.m) * t.v)


def pre_emphasis(x: Column, a: float = 0.97) -> Column:
    """y0 = x0, y[n] = x[n] - a x[n-1]."""
    return let(x, lambda s: F.transform(s, lambda v, i: F.when(i == 0, v).otherwise(v - F.lit(a) * F.get(s, i - 1))))


def n_frames(n: Column, length: int, shift: int) -> Column:
    """How many whole frames a signal of n samples has."""
    return F.when(n < length, F.lit(0)).otherwise((F.floor((n - length) / shift) + 1).cast("int"))


def frames(x: Column, length: int, shift: int) -> Column:
    """Overlapping frames; a tail that fills none is dropped."""

    def cut(s: Column) -> Column:
        n = n_frames(F.size(s), length, shift)
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.slice(s, i * shift + 1, F.lit(length)))).otherwise(F.array().cast("array<array<double>>"))

    return let(x, cut)


def hamming_window(n: int) -> list[float]:
    """D3: 0.54 - 0.46 cos(2 pi i / (n - 1))."""
    return [0.54 - 0.46 * math.cos(2 * math.pi * i / (n - 1)) for i in range(n)] if n > 1 else [1.0] * n


def windowed(x: Column, n: int) -> Column:
    """D3: a frame under the Hamming window."""
    return F.zip_with(x, constants(hamming_window(n)), lambda a, b: a * b)


def hz_to_mel(f: Column) -> Column:
    """D6."""
    return F.lit(2595.0) * F.log10(F.lit(1.0) + f / 700.0)


def mel_to_hz(m: Column) -> Column:
    """D6, the inverse."""
    return F.lit(700.0) * (F.pow(F.lit(10.0), m / 2595.0) - 1)


def warp_frequency(f: Column, alpha: Column, low: float = 0.0, high: float = 8000.0, knee_low: float = KNEE_LOW, knee_high: float = KNEE_HIGH) -> Column:
    """Alpha f between the knees, linear beyond them so that both ends stay where they are."""
    below = F.lit(low) + (f - low) * (alpha * knee_low - low) / (knee_low - low)
    above = alpha * knee_high + (f - knee_high) * (F.lit(high) - alpha * knee_high) / (high - knee_high)
    return F.when(f <= knee_low, below).when(f >= knee_high, above).otherwise(alpha * f)


def log_mel(power: Column, filters: Sequence[Sequence[float]]) -> Column:
    """Log energies of the filters."""
    return let(power, lambda p: F.array(*[F.log(F.greatest(dot(p, constants(w)), F.lit(1e-30))) for w in filters]))


def dct(e: Column, n: int, count: int) -> Column:
    """Unnormalised DCT-II."""
    return let(e, lambda v: F.array(*[dot(v, constants([math.cos(math.pi * k * (j + 0.5) / n) for j in range(n)])) for k in range(count)]))


def lifter_weights(count: int, lifter: int = 22) -> list[float]:
    """1 + L/2 sin(pi i / L)."""
    return [1 + lifter / 2 * math.sin(math.pi * i / lifter) for i in range(count)]


def liftered(c: Column, count: int, lifter: int = 22) -> Column:
    """Cepstra by their weights."""
    return F.zip_with(c, constants(lifter_weights(count, lifter)), lambda a, b: a * b)


def delta(rows: Column, reach: int = 2) -> Column:
    """Regression over +-reach frames of an array of frames, indices clamped at the ends."""
    norm = float(2 * sum(k * k for k in range(1, reach + 1)))

    def all_of(m: Column) -> Column:
        last = F.size(m) - 1

        def one(i: Column, d: Column) -> Column:
            at = lambda k: F.get(F.get(m, F.least(i + k, last)), d) - F.get(F.get(m, F.greatest(i - k, F.lit(0))), d)
            total = at(1)
            for k in range(2, reach + 1):
                total = total + F.lit(float(k)) * at(k)
            return total / norm

        return F.transform(m, lambda row, i: F.transform(row, lambda _, d: one(i, d)))

    return let(rows, all_of)


def delta_series(x: Column, reach: int = 2) -> Column:
    """D14 of a plain series."""
    norm = float(2 * sum(k * k for k in range(1, reach + 1)))

    def all_of(s: Column) -> Column:
        last = F.size(s) - 1

        def one(i: Column) -> Column:
            total = None
            for k in range(1, reach + 1):
                term = F.lit(float(k)) * (F.get(s, F.least(i + k, last)) - F.get(s, F.greatest(i - k, F.lit(0))))
                total = term if total is None else total + term
            return total / norm

        return F.transform(s, lambda _, i: one(i))

    return let(x, all_of)


def speed_perturbed(x: Column, factor: Column) -> Column:
    """Linear interpolation at every ``factor`` samples; null for an empty signal or factor <= 0."""

    def made(d: Column) -> Column:
        n = F.size(d.x)
        count = F.floor(n / d.by).cast("int")

        def sample(i: Column) -> Column:
            place = i.cast("double") * d.by
            k = F.floor(place).cast("int")
            frac = place - k
            return F.when(k + 1 < n, F.get(d.x, k) * (1.0 - frac) + F.get(d.x, k + 1) * frac).otherwise(F.get(d.x, F.least(k, n - 1)))

        good = (n > 0) & (d.by > 0) & (F.coalesce(count, F.lit(0)) > 0)
        return F.when(good, F.transform(F.sequence(F.lit(0), F.when(good, count - 1).otherwise(F.lit(0))), sample))

    return let(F.struct(x.alias("x"), F.when(factor > 0, factor).alias("by")), made)


def augmentation_factors(no_augment: Column) -> Column:
    """The speeds of an utterance."""
    return F.when(no_augment, constants([1.0])).otherwise(constants(FACTORS))


def context_stack(rows: Column, reach: int) -> Column:
    """Every frame with ``reach`` frames on both sides, the ends repeated."""
    return let(rows, lambda m: F.transform(m, lambda _, i: F.flatten(F.transform(F.sequence(i - reach, i + reach), lambda k: F.get(m, F.greatest(F.lit(0), F.least(k, F.size(m) - 1)))))))
