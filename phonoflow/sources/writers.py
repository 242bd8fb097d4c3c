"""Text sinks (K1, K4-K9). An ordered file is range-sorted; only a format that must be one file is written by one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoflow.functions import text as X
from phonoflow.operators.lexicon import existing_only
from phonoflow.operators.lm import NGramModel, arpa_rows
from phonoflow.session import stored


def write_lines(rows: DataFrame, line: Column, path: str, order: list[Column | str] | None = None, one_file: bool = False) -> None:
    """K8: lines as text files, in order where one is given."""
    out = rows.withColumn("_line", line)
    if order:
        out = out.orderBy(*order)
    out = out.select(F.col("_line").alias("value"))
    (out.coalesce(1) if one_file else out).write.mode("overwrite").text(path)


def arpa_lines(model: NGramModel) -> DataFrame:
    """K1: (part, ngram, value): all lines of the file; sorting by (part, ngram) gives their order."""
    spark = model.uni.sparkSession
    rows = stored(arpa_rows(model))
    sizes = {r["ord"]: r["n"] for r in rows.groupBy("ord").agg(F.count("*").alias("n")).collect()}
    orders = [n for n in range(1, model.order + 1) if n < 3 or sizes.get(3)]
    marks = [(0.0, "0", "\\data\\"), *[(0.0, str(n), f"ngram {n}={sizes.get(n, 0)}") for n in orders]]
    for n in orders:
        marks += [(n - 0.5, "0", ""), (n - 0.5, "1", f"\\{n}-grams:")]
    marks += [(9.0, "0", ""), (9.0, "1", "\\end\\")]
    fixed = spark.createDataFrame(marks, "part double, ngram string, value string")
    return fixed.unionByName(rows.select(F.col("ord").cast("double").alias("part"), "ngram", F.col("line").alias("value")))


def write_arpa(model: NGramModel, path: str) -> None:
    """K1: one file, as its readers want it."""
    write_lines(arpa_lines(model), F.col("value"), path, ["part", "ngram"], one_file=True)


def write_dictionary(entries: DataFrame, path: str, order: list[str] | None = None) -> None:
    """K5, K6: word, reading and phonemes, tabs between them; sorted by word and reading unless told otherwise."""
    write_lines(entries, F.concat_ws("\t", "word", "reading", X.join_words(F.col("phonemes"))), path, order or ["word", "reading"])


def write_manifest(rows: DataFrame, files: DataFrame, path: str) -> None:
    """K4: wav_path and words of the rows whose file exists."""
    write_lines(existing_only(rows, files), F.concat_ws("\t", "wav_path", X.join_words(F.col("words"))), path)


def write_ranking(results: DataFrame, path: str) -> None:
    """K9: the ranked grid with a header."""
    results.orderBy("rank").coalesce(1).write.mode("overwrite").csv(path, header=True)
