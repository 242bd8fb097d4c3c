"""A training corpus from the documents table, in five stages; see STAGES.

What each stage makes of nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns is what its
operator states. In short: a document without text goes with the first stage, as does one of an unlabelled kind that a
rule rejects; nulls in other columns are no reason to go; of repeated rows one stays, in the third stage; an empty table
stays empty; extra columns stay up to the last stage, which returns (doc_id, piece, token_start, n_tokens, bin_id,
bin_offset, text).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from phonoflow.llm import classifier, packing, rules, secret_scan, simhash
from phonoflow.session import ensure_checkpoint_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go; null, empty and blank texts are rejected, other nulls aren't looked at."""
    return rules.accepted(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go.

    It is fitted on the labelled ones of the whole documents table: what the rules left has hardly a bad one to learn from.
    A document with a null in lang or source is scored without it; repeated rows score alike.
    """
    model = classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return classifier.accepted_by(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id; rows without doc_id or text stay."""
    return simhash.one_of_each_group(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked; every row stays."""
    return secret_scan.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in bins of tokens: a row per piece with its place and its text; a null text is an end mark alone."""
    return packing.packed(docs, texts=True)


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("near duplicates", near_duplicates),
    ("secret scans", secrets),
    ("best-fit packing", pack),
]

#: SQL can't express the signatures, the fit or the vocabulary.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. Each one's result is a table in the shared checkpoint folder, and goes once the next one's is written."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            _remove(spark, f"{folder}/{k - 1}")
    return docs


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
