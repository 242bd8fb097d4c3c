"""Sentences from templates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoflow.functions import text as X

FULL_UP_TO, LARGE, MANY, FEW = 500, 5000, 300, 200

#: (format, slots): a small set to start from; bring your own.
TEMPLATES = [
    ("%s に 行き ます", [["学校", "駅", "海", "山"]]),
    ("%s を %s で 買う", [["本", "傘", "花"], ["店", "駅"]]),
    ("%s は %s です", [["空", "風", "夜"], ["青い", "静か", "冷たい"]]),
    ("%s と %s を 見る", [["犬", "猫", "鳥"], ["犬", "猫", "鳥"]]),
]


def product(spark: SparkSession, fmt: str, slots: list[list[str]]) -> DataFrame:
    """(i0, i1, ..., sentence): every combination in odometer order."""
    every = spark.range(0, 1, 1, 1)
    for k, s in enumerate(slots):
        every = every.select("*", F.posexplode(F.array(*map(F.lit, s))).alias(f"i{k}", f"s{k}"))
    return every.select(*[f"i{k}" for k in range(len(slots))], X.fill_template(fmt, *[F.col(f"s{k}") for k in range(len(slots))]).alias("sentence"))


def sampled(rows: DataFrame, n: int, seed: int = 42, by: str = "sentence") -> DataFrame:
    """``n`` rows by a seeded hash of their content: the same rows in any partitioning."""
    return rows.orderBy(F.xxhash64(by, F.lit(seed)), by).limit(n)  # each task keeps its n best


def generated(spark: SparkSession, templates: list[tuple[str, list[list[str]]]] = TEMPLATES, seed: int = 42) -> DataFrame:
    """G1: (sentence): the full product of a template of up to 500 sentences, else 300, or 200 of more than 5,000.

    White space is normalised; sentences whose first word is the third go, and so do repeats.
    """
    parts = []
    for fmt, slots in templates:
        total = reduce(lambda a, s: a * len(s), slots, 1)
        rows = product(spark, fmt, slots).select(X.join_words(X.fields_u(F.col("sentence"))).alias("sentence"))
        rows = rows.where(~X.self_referring(F.split("sentence", " ")))
        parts.append(rows if total <= FULL_UP_TO else sampled(rows.distinct(), FEW if total > LARGE else MANY, seed))
    return reduce(DataFrame.unionByName, parts).distinct()
