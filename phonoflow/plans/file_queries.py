"""Sources and sinks: tables are written as the files that the domain has, in the shared folder, and read back by the scans."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from phonoflow.functions import kernels as K
from phonoflow.functions import text as X
from phonoflow.operators import acoustic as A
from phonoflow.operators import decoder, lexicon, lm
from phonoflow.operators import network as NN
from phonoflow.plans.model_queries import _LONG, _STATS, formula_network
from phonoflow.plans.register import query
from phonoflow.plans.register import source as table
from phonoflow.plans.signal_queries import _X, embeddings
from phonoflow.plans.text_queries import _KANA, _WORDS, documents
from phonoflow.session import ensure_checkpoint_dir
from phonoflow.sources import audio, readers, writers


def folder(spark: SparkSession) -> str:
    """A new folder among the shared ones."""
    return f"{ensure_checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file on whatever file system the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(content))
    out.close()


# ---------------------------------------------------------------- audio
@F.arrow_udf(BinaryType())
def _wav(x: pa.Array, kind: pa.Array) -> pa.Array:
    """Files of signals, by kind: good, another rate, two channels, 8 bits, no RIFF mark, cut short."""
    out = []
    for v, k in zip(x, kind.to_pylist(), strict=True):
        raw = audio.wav_bytes(v.values.to_numpy(zero_copy_only=False), 8000 if k == 1 else 16000, 2 if k == 2 else 1, 8 if k == 3 else 16)
        out.append(b"RIFX" + raw[4:] if k == 4 else raw[:-2] if k == 5 else raw)
    return pa.array(out, pa.binary())


@query(
    """WITH k AS (SELECT vec_id, vec_id % 12 AS kind, list_transform(embedding, lambda v: greatest(least(trunc(v::DOUBLE * 32768), 32767), -32768) / 32768) AS s FROM embeddings)
SELECT vec_id, CAST(CASE WHEN kind BETWEEN 1 AND 5 THEN 0 ELSE 16000 END AS INTEGER) AS rate, CAST(CASE WHEN kind BETWEEN 1 AND 5 THEN 0 ELSE len(s) END AS INTEGER) AS n_samples,
 CASE WHEN kind BETWEEN 1 AND 5 THEN 0 ELSE round(list_sum(s), 9) + 0.0 END AS total,
 CASE kind WHEN 1 THEN 'unsupported rate 8000' WHEN 2 THEN 'unsupported channels 2' WHEN 3 THEN 'unsupported bits 8' WHEN 4 THEN 'not a RIFF file' WHEN 5 THEN 'short data chunk' END AS error FROM k"""
)
def wav_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as the bytes of WAV files, five of twelve of them not what the scan takes."""
    made = embeddings(spark, sf).select("vec_id", _wav(F.col("x"), F.pmod("vec_id", F.lit(12)).cast("int")).alias("content"))
    got = made.select("vec_id", audio.decode_wav(F.col("content")).alias("w"))
    total = F.round(F.aggregate("w.samples", F.lit(0.0), lambda s, v: s + v), 9) + 0.0
    none = lambda c: F.coalesce(F.col(f"w.{c}"), F.lit(0)).alias(c)
    return got.select("vec_id", none("rate"), none("n_samples"), F.when(F.col("w.error").isNull(), total).otherwise(0.0).alias("total"), "w.error")


@query("SELECT n_name AS name, 16000 AS rate, CAST(100 + n_nationkey AS INTEGER) AS n_samples, round(list_sum(list_transform(range(0, 100 + n_nationkey), lambda i: (i * 7 + n_nationkey) % 100 / 128.0::DOUBLE)), 6) AS total FROM nation")
def wav_files(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of WAV files, one a nation."""
    path = folder(spark)
    for r in table(spark, sf, "nation").collect():
        put(spark, f"{path}/{r['n_name']}.wav", audio.wav_bytes((np.arange(100 + r["n_nationkey"]) * 7 + r["n_nationkey"]) % 100 / 128))
    name = F.regexp_extract("path", r"([^/]*)\.wav$", 1).alias("name")
    return audio.read_wav(spark, path).where("error is null").select(name, "rate", "n_samples", F.round(F.aggregate("samples", F.lit(0.0), lambda s, v: s + v), 6).alias("total"))


# ---------------------------------------------------------------- text
@query("SELECT DISTINCT p_brand AS word, p_type AS reading, array_to_string(string_split(lower(p_name), ' '), ' ') AS phonemes FROM part")
def dictionary_file(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary, written sorted and read strictly; then its short lines passed over."""
    path = folder(spark)
    entries = table(spark, sf, "part").select(F.col("p_brand").alias("word"), F.col("p_type").alias("reading"), F.split(F.lower("p_name"), " ").alias("phonemes"))
    writers.write_dictionary(lexicon.distinct_entries(entries), f"{path}/a")
    read = readers.read_dictionary(spark, f"{path}/a").select("word", "reading", X.join_words(F.col("phonemes")).alias("phonemes"))
    # beside short lines, comments and blanks, all of which a lenient scan leaves out
    lines = read.select(F.concat_ws("\t", "word", "reading", "phonemes").alias("value"))
    odd = spark.createDataFrame([("# a comment",), ("",), ("short\tline",)], "value string")
    lines.unionByName(odd).write.text(f"{path}/b")
    return readers.read_dictionary(spark, f"{path}/b", strict=False).select("word", "reading", X.join_words(F.col("phonemes")).alias("phonemes"))


@query(f"SELECT array_to_string({_WORDS}, ' ') AS sentence FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM benchmark UNION ALL SELECT unnest(string_split(text, chr(10))) FROM conversations) WHERE len({_WORDS}) > 0")
def corpus_file(spark: SparkSession, sf: str) -> DataFrame:
    """Two files of sentences as one corpus."""
    path = folder(spark)
    for name in ("benchmark", "conversations"):
        writers.write_lines(table(spark, sf, name).where("text is not null"), F.col("text"), f"{path}/{name}")
    return readers.read_corpus(spark, f"{path}/benchmark", f"{path}/conversations").select(X.join_words(F.col("words")).alias("sentence"))


@query("SELECT c_name AS wav_path, array_to_string([c_mktsegment, c_name], ' ') AS sentence FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def manifest_file(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest of the rows whose file exists, read with comments and short lines in between."""
    path = folder(spark)
    c = table(spark, sf, "customer")
    rows = c.select(F.col("c_name").alias("wav_path"), F.array("c_mktsegment", "c_name").alias("words"))
    ordered = c.join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    writers.write_manifest(rows, ordered.select(F.col("c_name").alias("path")), f"{path}/a")
    spark.createDataFrame([("# comment\twith a tab",), ("no tab",), ("",)], "value string").write.text(f"{path}/b")
    return readers.read_manifest(spark, f"{path}/a", f"{path}/b", comments=True).select("wav_path", X.join_words(F.col("words")).alias("sentence"))


@query("SELECT source AS client_id, 'clip_' || doc_id AS path, lang AS sentence, CAST(CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars END AS INTEGER) AS up_votes FROM documents WHERE CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars END >= 2")
def validated_file(spark: SparkSession, sf: str) -> DataFrame:
    """Columns by the names of a header, in another order, votes that don't parse as 0."""
    path = folder(spark)
    d = table(spark, sf, "documents").where("doc_id is not null")
    votes = F.when(F.col("doc_id") % 7 == 0, "many").otherwise(F.col("n_chars").cast("string"))
    rows = d.select(F.col("doc_id").alias("at"), F.concat_ws("\t", votes, "lang", F.lit("x"), F.concat(F.lit("clip_"), "doc_id"), "source").alias("line"))
    head = spark.createDataFrame([(-1, "up_votes\tsentence\tage\tpath\tclient_id")], "at long, line string")
    writers.write_lines(head.unionByName(rows), F.col("line"), path, ["at"], one_file=True)
    return lexicon.vote_filter(readers.read_validated(spark, path), 2)


@query("SELECT r_name AS subset, n_name AS utt, 'of ' || r_name || ': ' || n_nationkey AS sentence, n_name || '.wav' AS wav FROM nation JOIN region ON n_regionkey = r_regionkey")
def transcript_files(spark: SparkSession, sf: str) -> DataFrame:
    """A folder a region, with a transcript of its nations; lines without a colon or a sentence are left out."""
    path = folder(spark)
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    for r in rows.groupBy("r_name").agg(F.collect_list(F.struct("n_name", "n_nationkey")).alias("n")).collect():
        lines = [f"{n['n_name']}:of {r['r_name']}: {n['n_nationkey']}" for n in r["n"]]
        put(spark, f"{path}/{r['r_name']}/transcript_utf8.txt", "\n".join([*lines, "no colon", "empty:", ""]).encode())
    return readers.read_transcripts(spark, path).select("subset", "utt", "sentence", F.substring_index("wav_path", "/", -1).alias("wav"))


_SPOKEN = "(VALUES " + ", ".join(f"({i}, '{k}', '{p}')" for i, (k, p) in enumerate(_KANA)) + ") AS k(i, kana, phonemes)"


@query(f"SELECT DISTINCT p_brand AS word, kana AS reading, phonemes FROM part JOIN {_SPOKEN} ON i = p_partkey % {len(_KANA)} WHERE kana <> ''")
def lexicon_csv(spark: SparkSession, sf: str) -> DataFrame:
    """13 comma-separated fields, some quoted; the pronunciation, or the reading where that is * or empty."""
    path = folder(spark)
    kana = F.array(*[F.lit(k) for k, _ in _KANA])
    p = table(spark, sf, "part").select("p_brand", "p_partkey", F.get(kana, (F.col("p_partkey") % len(_KANA)).cast("int")).alias("kana"))
    said = F.when(F.col("p_partkey") % 3 == 0, "*").when(F.col("p_partkey") % 3 == 1, "").otherwise(F.col("kana"))
    fields = [F.concat(F.lit('"'), "p_brand", F.lit('"')), *[F.lit(str(i)) for i in range(1, 10)], F.lit('"a ""b"""'), F.col("kana"), said]
    p.select(F.concat_ws(",", *fields).alias("value")).write.text(path)
    return readers.read_lexicon_csv(spark, path).select("word", "reading", X.join_words(F.col("phonemes")).alias("phonemes"))


@query("SELECT 'Item ' || item_id AS title, text FROM benchmark WHERE item_id % 5 <> 0")
def markup_dump(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of an XML dump; a title with a colon is a special page."""
    path = folder(spark)
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    title = F.concat(F.when(F.col("item_id") % 5 == 0, "Talk:").otherwise(""), F.lit("Item "), "item_id")
    page = F.concat(F.lit("<page><title>"), title, F.lit("</title><ns>0</ns><revision><id>1</id><text>"), escaped, F.lit("</text></revision></page>"))
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("at"), page.alias("line"))
    ends = spark.createDataFrame([(-1, "<mediawiki>"), ((1 << 62), "</mediawiki>")], "at long, line string")
    writers.write_lines(rows.unionByName(ends), F.col("line"), path, ["at"], one_file=True)
    return readers.read_pages(spark, path)


@query("WITH r AS (SELECT CAST(quality AS DOUBLE) AS lm_weight, CAST(toxic AS DOUBLE) AS word_penalty, sum(CAST(doc_id % 3 = 0 AS BIGINT)) AS correct, count(*) AS total FROM labels GROUP BY ALL) SELECT lm_weight, word_penalty, CAST(correct AS BIGINT) AS correct, total, round(correct / total * 100.0, 6) AS accuracy, CAST(row_number() OVER (ORDER BY correct DESC, lm_weight, word_penalty) AS INTEGER) AS rank FROM r")
def ranking_file(spark: SparkSession, sf: str) -> DataFrame:
    """The ranked report, as a file with a header."""
    path = folder(spark)
    rows = table(spark, sf, "labels").select(F.col("quality").cast("double").alias("lm_weight"), F.col("toxic").cast("double").alias("word_penalty"), "doc_id")
    writers.write_ranking(decoder.ranked(rows, F.col("doc_id") % 3 == 0, ["lm_weight", "word_penalty"]), path)
    return spark.read.csv(path, header=True, schema="lm_weight double, word_penalty double, correct long, total long, accuracy double, rank int").withColumn("accuracy", F.round("accuracy", 6))


@query(f"SELECT p_partkey || 'w' AS word, kana AS reading, phonemes FROM part JOIN {_SPOKEN} ON i = p_partkey % {len(_KANA)} WHERE kana <> '' UNION ALL SELECT '<sil>', 'SIL', 'sil'")
def regenerated_dictionary(spark: SparkSession, sf: str) -> DataFrame:
    """Phonemes anew from the readings, with the silence entry behind, as a file."""
    path = folder(spark)
    kana = F.array(*[F.lit(k) for k, _ in _KANA])
    p = table(spark, sf, "part").select(F.concat("p_partkey", F.lit("w")).alias("word"), F.get(kana, (F.col("p_partkey") % len(_KANA)).cast("int")).alias("reading"))
    writers.write_dictionary(lexicon.regenerated(p.where("reading <> ''")), path)
    return readers.read_dictionary(spark, path).select("word", "reading", X.join_words(F.col("phonemes")).alias("phonemes"))


@query("SELECT word FROM (VALUES ('日本'), ('ひらがな'), ('カタカナ'), ('佐々木'), ('コーヒー'), ('八文字の言葉です')) AS t(word)")
def japanese_words(spark: SparkSession, sf: str) -> DataFrame:
    """words of Japanese characters alone, of at most eight."""
    words = ["日本", "ひらがな", "カタカナ", "佐々木", "コーヒー", "八文字の言葉です", "九文字の言葉ですよ", "abc", "日本a", "１２３", "カタカナ。", "", "한국", "日 本"]
    return spark.createDataFrame([(w,) for w in words], "word string").where(X.is_japanese(F.col("word")) & X.at_most_runes(F.col("word")))


_ENTRY = "e AS (SELECT p_partkey AS pos, chr(CAST(19968 + p_partkey % 300 AS INTEGER)) || repeat('字', CAST(p_partkey % 9 AS INTEGER)) AS word, CAST(p_size % 6 AS INTEGER) AS n FROM part)"


@query(
    f"""WITH {_ENTRY}, must AS (SELECT * FROM e WHERE pos < 5 QUALIFY row_number() OVER (PARTITION BY word ORDER BY pos) = 1), full_ AS (SELECT * FROM e WHERE word NOT IN (SELECT word FROM must)),
c AS (SELECT * FROM full_ WHERE pos % 3 = 0), inc AS (SELECT * FROM full_ WHERE word IN (SELECT word FROM c) QUALIFY row_number() OVER (PARTITION BY word ORDER BY pos) = 1),
oth AS (SELECT * FROM full_ WHERE word NOT IN (SELECT word FROM c) AND length(word) <= 8 AND n >= 2 QUALIFY row_number() OVER (PARTITION BY word ORDER BY pos) = 1),
pick AS (SELECT *, row_number() OVER (ORDER BY n, length(word), pos) AS r FROM oth)
SELECT 0 AS grp, CAST(pos AS BIGINT) AS pos, word, n FROM must UNION ALL SELECT 1, CAST(pos AS BIGINT), word, n FROM inc
UNION ALL SELECT 2, CAST(r AS BIGINT), word, n FROM pick WHERE r <= greatest(0, (SELECT count(*) FROM must) + (SELECT count(*) FROM inc) + 40 - (SELECT count(*) FROM must) - (SELECT count(*) FROM inc))"""
)
def dictionary_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Must entries, then corpus words, then 40 more by phonemes, characters and place."""
    p = table(spark, sf, "part").withColumn("n", F.col("p_size") % 6)
    word = F.concat(F.get(F.array(*[F.lit(chr(19968 + i)) for i in range(300)]), (F.col("p_partkey") % 300).cast("int")), F.repeat(F.lit("字"), (F.col("p_partkey") % 9).cast("int")))
    e = p.select(F.col("p_partkey").alias("pos"), word.alias("word"), F.transform(F.when(F.col("n") > 0, F.sequence(F.lit(1), F.col("n"))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("p"), i.cast("string"))).alias("phonemes"))
    must = e.where("pos < 5").dropDuplicates(["word"])
    corpus = e.join(must.select("word"), "word", "left_anti").where("pos % 3 = 0").select("word")
    taken = must.count() + e.join(must.select("word"), "word", "left_anti").join(corpus.distinct(), "word", "left_semi").select("word").distinct().count()
    got = lexicon.filtered_dictionary(e, must, corpus, taken + 40, min_distance=0)
    return got.select("grp", "pos", "word", F.size("phonemes").alias("n"))


@query(f"SELECT word, total FROM (SELECT DISTINCT w AS word FROM (SELECT unnest({_WORDS}) AS w FROM conversations) WHERE w NOT IN (SELECT unnest({_WORDS}) FROM documents WHERE text IS NOT NULL)), (SELECT count(DISTINCT w) AS total FROM (SELECT unnest({_WORDS}) AS w FROM conversations) WHERE w NOT IN (SELECT unnest({_WORDS}) FROM documents WHERE text IS NOT NULL)) ORDER BY word LIMIT 20")
def missing_report(spark: SparkSession, sf: str) -> DataFrame:
    """The first 20 words that a dictionary lacks, and how many there are; the limit is the report."""
    said = table(spark, sf, "conversations").select(F.explode(X.fields_u(F.col("text"))).alias("w"))
    first, total = lexicon.missing_report(said, documents(spark, sf).select(F.explode("words").alias("word")).distinct())
    return spark.createDataFrame([(w, total) for w in first], "word string, total long")


@query(f"SELECT conv_id * 1000 + turn AS id, array_to_string({_WORDS}, ' ') AS words FROM conversations WHERE text IS NOT NULL")
def external_tokeniser(spark: SparkSession, sf: str) -> DataFrame:
    """Lines through a child process that answers a line with a line."""
    rows = table(spark, sf, "conversations").where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("line"))
    return lexicon.tokenised(rows, ["cat"]).select("id", X.join_words(F.col("words")).alias("words"))


# ---------------------------------------------------------------- models
@query(f"WITH {_X}, {_LONG}, {_STATS} SELECT 'c' || cls AS name, CAST(state AS INTEGER) AS state, CAST(i - 1 AS INTEGER) AS dim, round(mean + state, 6) + 0.0 AS mean, round(var, 6) AS var, round(ln(0.5), 6) AS stay FROM g, (SELECT unnest([1, 2, 3]) AS state)")
def model_files(spark: SparkSession, sf: str) -> DataFrame:
    """A model from the classes' statistics, saved and loaded; its states shift the means by their number."""
    path = folder(spark)
    stats = A.gaussian_statistics(embeddings(spark, sf), "label", "x").toPandas().sort_values(["label", "dim"])
    model = {}
    for label, g in stats.groupby("label"):
        mean, var = (np.repeat(g[c].to_numpy()[None, None, :], 3, 0) for c in ("mean", "var"))
        model[f"c{label}"] = K.Hmm(f"c{label}", mean + np.arange(1, 4)[:, None, None], var, np.zeros((3, 1)))
    A.save_model(spark, model, path)
    back = A.load_model(spark, path)
    states = A.state_table(spark, back).select("name", "state", F.posexplode(F.arrays_zip("mean", "var")).alias("dim", "z"))
    stay = A.move_table(spark, back).where("from_state = to_state").select("name", F.col("from_state").alias("state"), F.round("log_prob", 6).alias("stay"))
    return states.join(stay, ["name", "state"]).select("name", "state", "dim", (F.round("z.mean", 6) + 0.0).alias("mean"), F.round("z.var", 6).alias("var"), "stay")


@query(
    """SELECT 'w' AS kind, 0 AS layer, CAST(j * 64 + i AS INTEGER) AS at, round(sin(0.1 * (j * 64 + i + 1)), 9) + 0.0 AS value FROM (SELECT unnest(range(0, 8)) AS j), (SELECT unnest(range(0, 64)) AS i)
UNION ALL SELECT 'w', 1, CAST(k * 8 + j AS INTEGER), round(cos(0.3 * (k * 8 + j + 1)), 9) + 0.0 FROM (SELECT unnest(range(0, 4)) AS k), (SELECT unnest(range(0, 8)) AS j)
UNION ALL SELECT 'b', 0, CAST(j AS INTEGER), round(0.01 * j, 9) FROM (SELECT unnest(range(0, 8)) AS j) UNION ALL SELECT 'b', 1, CAST(j AS INTEGER), round(0.02 * j, 9) FROM (SELECT unnest(range(0, 4)) AS j)
UNION ALL SELECT 'prior', 0, CAST(j AS INTEGER), -(j + 1.0) FROM (SELECT unnest(range(0, 4)) AS j)"""
)
def network_files(spark: SparkSession, sf: str) -> DataFrame:
    """A network saved and loaded, a row per weight."""
    path = folder(spark)
    NN.save_network(spark, formula_network(), path)
    net = NN.load_network(spark, path)
    rows = [(kind, i, a.ravel()) for kind, arrays in (("w", net.w), ("b", net.b), ("prior", [net.log_prior])) for i, a in enumerate(arrays)]
    return spark.createDataFrame([(kind, layer, at, float(round(v, 9)) + 0.0) for kind, layer, values in rows for at, v in enumerate(values.tolist())], "kind string, layer int, at int, value double")


_W2 = f"""d AS (SELECT {_WORDS} AS words FROM benchmark WHERE text IS NOT NULL), s AS (SELECT list_concat(['<s>'], words, ['</s>']) AS w FROM d WHERE len(words) > 0),
g1 AS (SELECT w1, count(*) AS c FROM (SELECT unnest(w) AS w1 FROM s) GROUP BY w1), p1 AS (SELECT w1 AS w, c / (SELECT sum(c) FROM g1)::DOUBLE AS p FROM g1),
g2 AS (SELECT g.a AS w1, g.b AS w2, count(*) AS c FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: {{'a': w[i], 'b': w[i + 1]}})) AS g FROM s) GROUP BY ALL),
p2 AS (SELECT w1, w2, c / (sum(c) OVER (PARTITION BY w1) + count(*) OVER (PARTITION BY w1))::DOUBLE AS p FROM g2),
b AS (SELECT CASE WHEN sum(l.p) < 1 AND sum(u.p) < 1 THEN log10((1 - sum(u.p)) / (1 - sum(l.p))) ELSE 0.0 END AS bo FROM p2 u JOIN p1 l ON u.w2 = l.w WHERE u.w1 = '<s>')"""


@query(f"WITH {_W2} SELECT round(max(2.302585092994046 * coalesce(log10(p2.p), coalesce((SELECT bo FROM b), 0) + log10(p1.p))), 6) AS best FROM p1 LEFT JOIN p2 ON p2.w1 = '<s>' AND p2.w2 = p1.w WHERE p1.w NOT IN ('<s>', '</s>')")
def best_first_word(spark: SparkSession, sf: str) -> DataFrame:
    """The look-ahead bound of the decoder, from the bigram model of benchmark."""
    lines = table(spark, sf, "benchmark").where("text is not null").select(X.fields_u(F.col("text")).alias("words"))
    return spark.createDataFrame([(round(lm.best_start(lm.build(lines, 2)), 6),)], "best double")
