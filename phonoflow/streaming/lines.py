"""Article text as a stream (S19, K8): the batch expressions over readStream, exactly-once by the sink's checkpoint.

The only stream that the domain has is text that arrives as files of lines; it needs no state, so no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from phonoflow.functions import text as X
from phonoflow.sources.readers import article_sentences


def sentences(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """(sentence) of the text files that arrive in a folder."""
    return article_sentences(spark.readStream.option("maxFilesPerTrigger", max_files).text(folder))


def covered(stream: DataFrame, dictionary: DataFrame, min_words: int) -> DataFrame:
    """F2 on a stream: sentences of enough words, all known. The dictionary is one row, a set, joined without state."""
    known = dictionary.select("word").distinct().agg(F.map_from_entries(F.collect_list(F.struct("word", F.lit(True)))).alias("_known"))
    rows = stream.withColumn("words", X.fields_u(F.col("sentence"))).crossJoin(known)
    return rows.where((F.size("words") >= min_words) & F.forall("words", lambda w: F.map_contains_key("_known", w))).drop("_known")


def write(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Sentences to text files, as they come; ends when all that was there is written."""
    return stream.selectExpr("sentence as value").writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
