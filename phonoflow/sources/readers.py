"""Text sources as DataFrames (S5-S16, S19). Lines are split and checked by expressions; nothing is read on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoflow.functions import text as X
from phonoflow.operators.lm import LN10, NGramModel
from phonoflow.operators.lexicon import numbered


#: an ARPA file has one for each order, one before and one behind
MOST_HEADERS = 100


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Lines (value) with their order (pos) and file; pos orders the lines of a file, and of files by their name's partition."""
    lines = spark.read.text(list(paths)).withColumn("file", F.col("_metadata.file_path"))
    return lines.withColumn("pos", F.monotonically_increasing_id())


def _checked(ok: Column, value: Column, message: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(message).cast("string"))


def read_dictionary(spark: SparkSession, *paths: str, strict: bool = True) -> DataFrame:
    """(word, reading, phonemes, pron_idx, pos). Blank lines and comments are skipped.

    A line with fewer than three fields is an error that names it; with ``strict=False`` it is passed over.
    """
    lines = read_lines(spark, *paths).withColumn("line", X.trim_u(F.col("value"))).where((F.col("line") != "") & ~F.startswith("line", F.lit("#")))
    f = lines.withColumn("f", F.split("line", "\t", 3))
    ok = F.size("f") == 3
    f = f.withColumn("word", _checked(ok, F.get("f", F.lit(0)), F.concat(F.lit("too few fields in dictionary line: "), F.col("line")))) if strict else f.where(ok).withColumn("word", F.get("f", F.lit(0)))
    return numbered(f.select("word", F.get("f", F.lit(1)).alias("reading"), X.fields_u(F.get("f", F.lit(2))).alias("phonemes"), "pos"))


def arpa_grams(lines: DataFrame) -> DataFrame:
    """(ord, words, log_prob, log_backoff), natural logs, of the lines (value, pos) of one file in the ARPA format.

    A line's section is the last header before it. There is a header an order, so their positions are collected (at most
    MOST_HEADERS) and each line is compared with them; nothing is sorted, and positions have to be the same each time they
    are asked for, as those of a file or a table are. Declared counts are ignored.
    """
    t = lines.withColumn("line", X.trim_u(F.col("value")))
    head = F.when(F.col("line") == "\\data\\", F.lit(0)).when(F.col("line") == "\\end\\", F.lit(-1)).when(F.col("line").rlike(r"^\\\d+-grams:$"), F.regexp_extract("line", r"^\\(\d+)-grams:$", 1).cast("int"))
    heads = sorted((r["pos"], r["ord"]) for r in t.select("pos", head.alias("ord")).where("ord is not null").limit(MOST_HEADERS + 1).collect())
    if len(heads) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} section headers")
    section = F.lit(0)
    for pos, n in heads:  # the last one before the line decides
        section = F.when(F.col("pos") > pos, F.lit(n)).otherwise(section)
    rows = t.withColumn("ord", section).where((F.col("ord") > 0) & (F.col("line") != "") & ~F.startswith("line", F.lit("\\")))
    f = rows.withColumn("f", X.fields_u(F.col("line")))
    enough = F.size("f") >= F.col("ord") + 1
    good = f.withColumn("lp", _checked(enough, F.get("f", F.lit(0)), F.concat(F.lit("too few fields in n-gram line: "), F.col("line"))).cast("double"))
    return good.select("ord", F.slice("f", F.lit(2), F.greatest("ord", F.lit(0))).alias("words"), (F.col("lp") * LN10).alias("log_prob"), (F.coalesce(F.get("f", F.col("ord") + 1).cast("double"), F.lit(0.0)) * LN10).alias("log_backoff"))


def read_arpa(spark: SparkSession, path: str, oov: float = 0.0) -> NGramModel:
    """A model in log10, as files have it; orders above three are read and dropped."""
    lines = read_lines(spark, path)
    order = lines.select(F.max(F.regexp_extract("value", r"^\s*ngram\s+(\d+)\s*=", 1).try_cast("int"))).first()[0] or 0
    g = arpa_grams(lines)
    part = lambda n: g.where(F.col("ord") == n)
    word = lambda i: F.get("words", F.lit(i))
    lp, bo = (F.col("log_prob") / LN10).alias("lp"), (F.col("log_backoff") / LN10).alias("bo")
    tri = part(3).select(word(0).alias("h2"), word(1).alias("h1"), word(2).alias("w"), lp) if order >= 3 else None
    return NGramModel(order, part(1).select(word(0).alias("w"), lp, bo), part(2).select(word(0).alias("h"), word(1).alias("w"), lp, bo), tri, oov)


def read_corpus(spark: SparkSession, *paths: str) -> DataFrame:
    """(sent_id, words) of lines that aren't blank."""
    rows = read_lines(spark, *paths).select(F.col("pos").alias("sent_id"), X.fields_u(F.col("value")).alias("words"))
    return rows.where(F.size("words") > 0)


def read_manifest(spark: SparkSession, *paths: str, comments: bool = False) -> DataFrame:
    """(utt_id, wav_path, expected, words) of tab-separated lines; others are skipped, comments too where they may occur."""
    lines = read_lines(spark, *paths).withColumn("line", X.trim_u(F.col("value"))).where(F.col("line") != "")
    if comments:
        lines = lines.where(~F.startswith("line", F.lit("#")))
    f = lines.withColumn("f", F.split("line", "\t", 2)).where(F.size("f") == 2)
    return f.select(F.col("pos").alias("utt_id"), F.get("f", F.lit(0)).alias("wav_path"), F.get("f", F.lit(1)).alias("expected"), X.fields_u(F.get("f", F.lit(1))).alias("words"))


def read_validated(spark: SparkSession, path: str) -> DataFrame:
    """(client_id, path, sentence, up_votes) by the header's names; no quoting; votes that don't parse are 0."""
    lines = read_lines(spark, path)
    head = lines.orderBy("pos").first()
    names = [] if head is None else [n.strip() for n in head["value"].rstrip("\r").split("\t")]
    wanted = ["client_id", "path", "sentence", "up_votes"]
    if missing := [n for n in wanted if n not in names]:
        raise ValueError(f"no column {missing[0]} in {path}")
    at = {n: names.index(n) for n in wanted}
    f = lines.where(F.col("pos") != head["pos"]).withColumn("f", F.split(F.regexp_replace("value", r"\r$", ""), "\t")).where(F.size("f") > max(at.values()))
    col = lambda n: F.get("f", F.lit(at[n])).alias(n)
    return f.select(col("client_id"), col("path"), col("sentence"), F.coalesce(X.trim_u(F.get("f", F.lit(at["up_votes"]))).try_cast("int"), F.lit(0)).alias("up_votes"))


def read_transcripts(spark: SparkSession, root: str) -> DataFrame:
    """(subset, utt, sentence, wav_path) of root/*/transcript_utf8.txt; a line is id:sentence, split at its first colon."""
    lines = spark.read.option("ignoreMissingFiles", "true").text(f"{root}/*/transcript_utf8.txt").select("value", F.regexp_replace(F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))), "^file:(//)?", "").alias("file"))
    folder = F.regexp_replace("file", "/[^/]*$", "")
    utt, sentence = (X.trim_u(F.regexp_extract("value", r"^([^:]*):(.*)$", i)) for i in (1, 2))
    rows = lines.select(F.substring_index(folder, "/", -1).alias("subset"), utt.alias("utt"), sentence.alias("sentence"), F.concat(folder, F.lit("/wav/"), utt, F.lit(".wav")).alias("wav_path"))
    return rows.where((F.col("utt") != "") & (F.col("sentence") != "")).orderBy("subset", "utt")


def read_lexicon_csv(spark: SparkSession, *paths: str, encoding: str = "UTF-8") -> DataFrame:
    """(word, reading, phonemes) of comma-separated dictionaries of at least 13 fields, sorted, each once."""
    from phonoflow.functions.phonemes import kana_to_phonemes

    names = [f"c{i}" for i in range(13)]
    schema = ", ".join(f"{n} string" for n in [*names, "_odd"])
    rows = spark.read.csv(list(paths), schema=schema, encoding=encoding, mode="PERMISSIVE", escape='"', columnNameOfCorruptRecord="_odd")
    # a line of other than 13 fields is odd; an empty field is null, so whether there are enough is told from the line
    enough = F.col("_odd").isNull() | (F.size(F.split("_odd", ",")) >= 13)
    reading = X.pronunciation(F.col("c12"), F.col("c11"))
    got = rows.where(enough & F.col("c0").isNotNull()).select(F.col("c0").alias("word"), reading.alias("reading")).where("reading is not null")
    made = got.withColumn("phonemes", kana_to_phonemes(F.col("reading"))).where(F.size("phonemes") > 0)
    return made.dropDuplicates(["word", "reading"]).orderBy("word", "reading")


def read_pages(spark: SparkSession, path: str, max_pages: int = 0) -> DataFrame:
    """(title, text) of MediaWiki pages, bzip2 too; titles with a colon are special pages. ``max_pages`` of 0 means all."""
    rows = spark.read.format("xml").option("rowTag", "page").schema("title string, revision struct<text:string>").load(path)
    kept = rows.select("title", F.col("revision.text").alias("text")).where(~F.contains(F.coalesce("title", F.lit("")), F.lit(":")))
    return kept.limit(max_pages) if max_pages > 0 else kept


def page_sentences(pages: DataFrame) -> DataFrame:
    """(sentence) of cleaned pages, of 4 to 200 bytes."""
    rows = pages.select(F.explode(X.split_sentences(X.clean_markup(F.coalesce("text", F.lit(""))))).alias("sentence"))
    return rows.where(X.sentence_bytes_between(F.col("sentence")))


def read_word_lists(spark: SparkSession, *globs: str) -> DataFrame:
    """The distinct words of all files."""
    return spark.read.text(list(globs)).select(F.explode(X.fields_u(F.col("value"))).alias("word")).distinct()


def article_sentences(lines: DataFrame) -> DataFrame:
    """(sentence) of lines (value), batch or stream; blank lines and document tags are skipped."""
    line = X.trim_u(F.col("value"))
    return lines.where((line != "") & ~X.is_tag_line(line)).select(F.explode(X.split_sentences(line)).alias("sentence"))
