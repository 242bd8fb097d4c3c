"""Where queries are kept: a name, a callable of (spark, sf_dir), and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phonoflow.session import table

#: tables whose rows are worth a task each few megabytes
LARGE = ("documents", "pages", "embeddings", "conversations")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers the function under its name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a large one that is read in fewer tasks than there are cores, being one small file, is dealt out to all of them.

    A table of many files has more splits than cores and is left as it is, so nothing is shuffled at scale.
    """
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in LARGE and df.rdd.getNumPartitions() < cores else df
