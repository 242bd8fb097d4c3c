"""Text, dictionary and language-model queries over documents, benchmark, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoflow.functions import phonemes as P
from phonoflow.functions import text as X
from phonoflow.operators import corpus, decoder, lexicon, lm
from phonoflow.plans.register import query
from phonoflow.plans.register import source as table
from phonoflow.session import cut_lineage

OOV = -5.0 * lm.LN10
_WORDS = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '')"


def words_of(df: DataFrame, key: str) -> DataFrame:
    """(key, words) of a table with texts."""
    return df.select(key, X.fields_u(F.coalesce("text", F.lit(""))).alias("words"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as sentences of a corpus."""
    return words_of(table(spark, sf, "documents"), "doc_id")


_DOCS = f"d AS (SELECT doc_id, {_WORDS} AS words FROM documents WHERE text IS NOT NULL), s AS (SELECT list_concat(['<s>'], words, ['</s>']) AS w FROM d WHERE len(words) > 0)"


def _grams(n: int) -> str:
    cells = ", ".join(f"'w{k + 1}': w[i + {k}]" for k in range(n))
    cols = ", ".join(f"g.w{k + 1} AS w{k + 1}" for k in range(n))
    return f"g{n} AS (SELECT {cols}, count(*) AS c FROM (SELECT unnest(list_transform(range(1, len(w) - {n - 2}), lambda i: {{{cells}}})) AS g FROM s) GROUP BY ALL)"


_G1, _G2, _G3 = _grams(1), _grams(2), _grams(3)
_P1 = "p1 AS (SELECT w1 AS w, c / (SELECT sum(c) FROM g1)::DOUBLE AS p FROM g1)"
_P2 = "p2 AS (SELECT w1, w2, c / (sum(c) OVER (PARTITION BY w1) + count(*) OVER (PARTITION BY w1))::DOUBLE AS p FROM g2)"
_P3 = "p3 AS (SELECT w1, w2, w3, c / (sum(c) OVER (PARTITION BY w1, w2) + count(*) OVER (PARTITION BY w1, w2))::DOUBLE AS p FROM g3)"
_WEIGHT = "CASE WHEN sum(l.p) < 1 AND sum(u.p) < 1 THEN log10((1 - sum(u.p)) / (1 - sum(l.p))) ELSE 0.0 END"
_BO1 = f"b1 AS (SELECT u.w1 AS h, {_WEIGHT} AS bo FROM p2 u JOIN p1 l ON u.w2 = l.w GROUP BY u.w1)"
_BO2 = f"b2 AS (SELECT u.w1 AS h2, u.w2 AS h1, {_WEIGHT} AS bo FROM p3 u JOIN p2 l ON u.w2 = l.w1 AND u.w3 = l.w2 GROUP BY u.w1, u.w2)"


# ---------------------------------------------------------------- counting and smoothing
@query(f"WITH {_DOCS}, {_G1} SELECT w1, c FROM g1")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A1."""
    return lm.counts(documents(spark, sf), 1)


@query(f"WITH {_DOCS}, {_G2} SELECT w1, w2, c FROM g2")
def bigram_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A1, W1."""
    return lm.counts(documents(spark, sf), 2)


@query(f"WITH {_DOCS}, {_G3} SELECT w1, w2, w3, c FROM g3")
def trigram_counts(spark: SparkSession, sf: str) -> DataFrame:
    """A1, W1."""
    return lm.counts(documents(spark, sf), 3)


@query(f"WITH {_DOCS}, {_G2} SELECT w1, CAST(sum(c) AS BIGINT) AS n_h, count(*) AS t_h FROM g2 GROUP BY w1")
def lm_context_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A2, A3."""
    return lm.context_totals(lm.counts(documents(spark, sf), 2), 2)


@query(f"WITH {_DOCS}, {_G2}, {_P2} SELECT w1, w2, round(log10(p), 6) AS lp FROM p2")
def wb_bigram_prob(spark: SparkSession, sf: str) -> DataFrame:
    """A4."""
    return lm.smoothed(documents(spark, sf), 2).select("w1", "w2", F.round(F.log10("p"), 6).alias("lp"))


@query(f"WITH {_DOCS}, {_G3}, {_P3} SELECT w1, w2, w3, round(log10(p), 6) AS lp FROM p3")
def wb_trigram_prob(spark: SparkSession, sf: str) -> DataFrame:
    """A4."""
    return lm.smoothed(documents(spark, sf), 3).select("w1", "w2", "w3", F.round(F.log10("p"), 6).alias("lp"))


@query(f"WITH {_DOCS}, {_G1}, {_G2}, {_P1}, {_P2}, {_BO1} SELECT h, round(bo, 6) AS bo FROM b1")
def backoff_weights(spark: SparkSession, sf: str) -> DataFrame:
    """A5."""
    return lm.unigrams(documents(spark, sf))[0].where("t > 0").select(F.col("w").alias("h"), F.round("bo", 6).alias("bo"))


_CHAIN = f"{_DOCS}, {_G1}, {_G2}, {_G3}, {_P1}, {_P2}, {_P3}, {_BO1}, {_BO2}"


@query(
    f"""WITH {_CHAIN},
r AS (SELECT 1 AS ord, w AS ngram, log10(p) AS lp, coalesce(bo, 0.0) AS bo FROM p1 LEFT JOIN b1 ON w = h
      UNION ALL SELECT 2, w1 || ' ' || w2, log10(p), coalesce(bo, 0.0) FROM p2 LEFT JOIN b2 ON w1 = h2 AND w2 = h1
      UNION ALL SELECT 3, w1 || ' ' || w2 || ' ' || w3, log10(p), 0.0 FROM p3)
SELECT CAST(ord AS INTEGER) AS ord, ngram, printf('%.6f', lp) || chr(9) || ngram || CASE WHEN bo = 0 THEN '' ELSE chr(9) || printf('%.6f', bo) END AS line FROM r"""
)
def arpa_rows(spark: SparkSession, sf: str) -> DataFrame:
    """K1, O1: the lines of a trigram model's file."""
    return lm.arpa_rows(lm.build(documents(spark, sf), 3))


@query(
    f"""WITH {_CHAIN},
q0 AS (SELECT item_id, list_concat(['<s>'], {_WORDS}, ['</s>']) AS t FROM benchmark WHERE text IS NOT NULL),
q AS (SELECT item_id, x.h2 AS h2, x.h1 AS h1, x.w AS w FROM (SELECT item_id, unnest(list_transform(range(2, len(t) + 1), lambda i: {{'h2': CASE WHEN i > 2 THEN t[i - 2] END, 'h1': t[i - 1], 'w': t[i]}})) AS x FROM q0)),
z AS (SELECT item_id, u.w IS NULL AS oov,
  ln(10) * coalesce(log10(p3.p), coalesce(b2.bo, 0) + coalesce(log10(p2.p), coalesce(b1.bo, 0) + coalesce(log10(u.p), -5.0))) AS lp
  FROM q LEFT JOIN p1 u ON u.w = q.w LEFT JOIN b1 ON b1.h = q.h1 LEFT JOIN p2 ON p2.w1 = q.h1 AND p2.w2 = q.w
  LEFT JOIN p3 ON p3.w1 = q.h2 AND p3.w2 = q.h1 AND p3.w3 = q.w LEFT JOIN b2 ON b2.h2 = q.h2 AND b2.h1 = q.h1)
SELECT item_id, count(*) AS n_tokens, count(*) FILTER (oov) AS n_oov, round(sum(lp), 4) AS log_prob FROM z GROUP BY item_id"""
)
def lm_score_backoff(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark under the trigram model of documents."""
    lines = words_of(table(spark, sf, "benchmark").where("text is not null"), "item_id")
    model = lm.natural(lm.build(documents(spark, sf), 3, oov=OOV, queries=lm.sentence_tokens(lines, "item_id")))
    got = lm.sentence_scores(model, lines, "item_id")
    return got.select("item_id", "n_tokens", "n_oov", F.round("log_prob", 4).alias("log_prob"))


# ---------------------------------------------------------------- cleaning and splitting
@query("SELECT doc_id, s AS sentence FROM (SELECT doc_id, unnest(list_transform(string_split(text, '.'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g'))) AS s FROM documents) WHERE s <> '' AND strlen(s) BETWEEN 4 AND 200")
def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    """X3, X6, F4."""
    rows = table(spark, sf, "documents").select("doc_id", F.explode(X.split_sentences(F.col("text"), ".")).alias("sentence"))
    return rows.where(X.sentence_bytes_between(F.col("sentence")))


def _markup_sql(column: str) -> str:
    for pattern, by in X.MARKUP:
        p, b = pattern.replace("'", "''"), by.replace("$1", "\\1")
        column = f"regexp_replace({column}, '{p}', '{b}', 'g')"
    return column


@query(f"SELECT page_id, {_markup_sql('html')} AS text FROM pages")
def markup_clean(spark: SparkSession, sf: str) -> DataFrame:
    """X2."""
    return table(spark, sf, "pages").select("page_id", X.clean_markup(F.col("html")).alias("text"))


@query("SELECT page_id, s AS line FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS s FROM pages) WHERE NOT regexp_matches(s, '^</?doc[^>]*>$') AND s <> ''")
def tag_line_filter(spark: SparkSession, sf: str) -> DataFrame:
    """F3, S19."""
    rows = table(spark, sf, "pages").select("page_id", F.explode(F.split("html", "\n")).alias("line"))
    return rows.where(~X.is_tag_line(F.col("line")) & (F.col("line") != ""))


@query("SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(translate(text, '。、？！.,', ''), '[ \\t\\n\\r]+'), lambda x: x <> '')) AS w FROM conversations")
def punct_strip_tokenise(spark: SparkSession, sf: str) -> DataFrame:
    """X4, X5."""
    return table(spark, sf, "conversations").select("conv_id", "turn", F.explode(X.fields_u(X.strip_punctuation(F.col("text")))).alias("w"))


@query("SELECT DISTINCT w AS word, lang AS reading FROM (SELECT unnest(" + _WORDS + ") AS w, lang FROM documents)")
def dedup_entries(spark: SparkSession, sf: str) -> DataFrame:
    """A8, O2."""
    d = table(spark, sf, "documents")
    return lexicon.distinct_entries(d.select(F.explode(X.fields_u(F.col("text"))).alias("word"), F.col("lang").alias("reading")))


# ---------------------------------------------------------------- dictionaries
_VOCAB = f"v AS (SELECT w AS word, count(*) AS c FROM (SELECT unnest({_WORDS}) AS w FROM documents) GROUP BY w)"
DICTIONARY_WORDS = 500


def frequent_words(spark: SparkSession, sf: str, n: int = DICTIONARY_WORDS) -> DataFrame:
    """The n most frequent words of documents: a stand-in for a pronunciation dictionary, spelled by characters."""
    counts = documents(spark, sf).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("c"))
    return counts.orderBy(F.desc("c"), "word").limit(n).select("word", F.lit("").alias("reading"), F.filter(F.split("word", ""), lambda x: x != "").alias("phonemes"), F.lit(0).alias("pron_idx"))


@query(f"WITH {_VOCAB}, q AS (SELECT item_id, unnest({_WORDS}) AS w FROM benchmark) SELECT item_id, count(*) AS n_tokens, count(*) FILTER (v.word IS NULL) AS n_oov FROM q LEFT JOIN v ON v.word = q.w GROUP BY item_id")
def oov_rate(spark: SparkSession, sf: str) -> DataFrame:
    """J3, A7, A23."""
    known = documents(spark, sf).select(F.explode("words").alias("word"))
    return lm.coverage(words_of(table(spark, sf, "benchmark"), "item_id").select("item_id", F.explode("words").alias("w")), known, "item_id")


_SENTENCES = "t AS (SELECT doc_id, i AS pos, list_filter(regexp_split_to_array(s[i], '[ \\t\\n\\r]+'), lambda x: x <> '') AS words FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, '.') AS s FROM documents)))"


@query(
    f"""WITH {_VOCAB}, k AS (SELECT word FROM v ORDER BY c DESC, word LIMIT {DICTIONARY_WORDS}), {_SENTENCES},
bad AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, pos, unnest(words) AS w FROM t) WHERE w NOT IN (SELECT word FROM k))
SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos FROM t WHERE len(words) >= 2 AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.doc_id = t.doc_id AND bad.pos = t.pos)"""
)
def all_in_dict_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """F2, J3."""
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", r"\.")).alias("pos", "s"))
    rows = rows.select(F.struct("doc_id", "pos").alias("k"), X.fields_u(F.col("s")).alias("words"))
    return lexicon.all_in_dictionary(rows, frequent_words(spark, sf), "k", min_words=2).select("k.doc_id", "k.pos")


@query(f"WITH {_VOCAB} SELECT DISTINCT w AS word FROM (SELECT unnest({_WORDS}) AS w FROM benchmark) WHERE w NOT IN (SELECT word FROM v)")
def missing_corpus_words(spark: SparkSession, sf: str) -> DataFrame:
    """J4, U5, S15."""
    corpus_words = table(spark, sf, "benchmark").select(F.explode(X.fields_u(F.col("text"))).alias("w"))
    return lexicon.missing_words(corpus_words, documents(spark, sf).select(F.explode("words").alias("word")).distinct())


@query("SELECT p_brand AS word, p_type AS reading, p_partkey AS pos, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS pron_idx FROM part")
def pronunciation_index(spark: SparkSession, sf: str) -> DataFrame:
    """The numbering of a word's entries."""
    return lexicon.numbered(table(spark, sf, "part").select(F.col("p_brand").alias("word"), F.col("p_type").alias("reading"), F.col("p_partkey").alias("pos")))


@query("WITH d AS (SELECT p_brand, p_type, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) SELECT p_partkey, d.p_type AS first_reading FROM part JOIN d USING (p_brand) WHERE r = 1")
def first_pronunciations(spark: SparkSession, sf: str) -> DataFrame:
    """J1."""
    part = table(spark, sf, "part")
    d = lexicon.numbered(part.select(F.col("p_brand").alias("word"), F.array("p_type").alias("phonemes"), F.col("p_partkey").alias("pos")))
    return lexicon.first_pronunciation(part.select("p_partkey", F.col("p_brand").alias("w")), d).select("p_partkey", F.get("phonemes", F.lit(0)).alias("first_reading"))


@query("WITH d AS (SELECT n_name, c_name FROM nation JOIN customer ON c_nationkey = n_nationkey) SELECT s_suppkey, d.c_name AS reading FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN d ON d.n_name = nation.n_name")
def all_pronunciation_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """J2."""
    nation = table(spark, sf, "nation")
    d = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("word"), F.col("c_name").alias("reading"), F.array("c_name").alias("phonemes"), F.col("c_custkey").alias("pos"))
    rows = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("w"))
    return lexicon.all_pronunciations(rows, lexicon.numbered(d)).select("s_suppkey", "reading")


@query(
    f"""WITH {_VOCAB}, k AS (SELECT word FROM v ORDER BY c DESC, word LIMIT {DICTIONARY_WORDS}), {_SENTENCES},
x AS (SELECT doc_id, pos, len(words) AS n, unnest(words) AS w FROM t WHERE len(words) > 0)
SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, CAST(2 + sum(length(w)) AS INTEGER) AS n_phonemes FROM x JOIN k ON k.word = x.w GROUP BY doc_id, pos, n HAVING count(*) = n"""
)
def utterance_phonemes(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences whose every word is in the dictionary, as phonemes between silences."""
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", r"\.")).alias("pos", "s"))
    rows = rows.select(F.struct("doc_id", "pos").alias("utt_id"), X.fields_u(F.col("s")).alias("words"))
    return lexicon.utterance_phonemes(rows, frequent_words(spark, sf)).select("utt_id.doc_id", "utt_id.pos", F.size("phonemes").alias("n_phonemes"))


@query(
    """WITH j AS (SELECT quality, n_chars, lang FROM labels JOIN documents USING (doc_id))
SELECT count(*) AS total, count(*) FILTER (quality >= 1) AS votes, round(coalesce(100.0 * count(*) FILTER (quality >= 1) / count(*), 0), 6) AS votes_pct,
 count(*) FILTER (quality >= 1 AND n_chars >= 500) AS long, round(coalesce(100.0 * count(*) FILTER (quality >= 1 AND n_chars >= 500) / count(*), 0), 6) AS long_pct,
 count(*) FILTER (quality >= 1 AND n_chars >= 500 AND lang = 'en') AS english, round(coalesce(100.0 * count(*) FILTER (quality >= 1 AND n_chars >= 500 AND lang = 'en') / count(*), 0), 6) AS english_pct FROM j"""
)
def vote_filter_funnel(spark: SparkSession, sf: str) -> DataFrame:
    """F1, A7, X17."""
    j = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    got = lexicon.funnel(j, {"votes": F.col("quality") >= 1, "long": F.col("n_chars") >= 500, "english": F.col("lang") == "en"})
    return got.withColumns({c: F.round(c, 6) for c in got.columns if c.endswith("_pct")})


@query("SELECT count(DISTINCT role) AS n_speakers FROM conversations")
def distinct_speakers(spark: SparkSession, sf: str) -> DataFrame:
    """A6."""
    return lexicon.speakers(table(spark, sf, "conversations"), "role")


@query("SELECT c_name AS wav_path, FALSE AS no_augment FROM customer UNION ALL SELECT s_name, TRUE FROM supplier")
def union_manifests(spark: SparkSession, sf: str) -> DataFrame:
    """U1, U2."""
    return lexicon.union_manifests(table(spark, sf, "customer").select(F.col("c_name").alias("wav_path")), table(spark, sf, "supplier").select(F.col("s_name").alias("wav_path")))


@query("SELECT o_orderkey AS wav_path FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def existing_files(spark: SparkSession, sf: str) -> DataFrame:
    """J14, K4."""
    return lexicon.existing_only(table(spark, sf, "orders").select(F.col("o_orderkey").alias("wav_path")), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path")))


# ---------------------------------------------------------------- distances and selection
_BWORDS = f"b AS (SELECT DISTINCT w FROM (SELECT unnest({_WORDS}) AS w FROM benchmark))"


def benchmark_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words of the benchmark, spelled by characters."""
    w = table(spark, sf, "benchmark").select(F.explode(X.fields_u(F.col("text"))).alias("word")).distinct()
    return w.select("word", F.filter(F.split("word", ""), lambda x: x != "").alias("phonemes"))


_SHORTER = "len(list_filter(range(1, length({long}) + 1), lambda i: {long}[1:i - 1] || {long}[i + 1:] = {short})) > 0"


@query(
    f"""WITH {_BWORDS}, c AS (SELECT w, string_split(w, '') AS l, length(w) AS n FROM b), p AS (SELECT x.w AS a, y.w AS b, x.l AS la, y.l AS lb, x.n AS na, y.n AS nb FROM c x JOIN c y ON x.w < y.w AND abs(x.n - y.n) < 2)
SELECT a AS word_a, b AS word_b, 1 AS dist FROM p WHERE CASE WHEN na = nb THEN len(list_filter(range(1, na + 1), lambda i: la[i] <> lb[i])) = 1 WHEN na > nb THEN {_SHORTER.format(long="a", short="b")} ELSE {_SHORTER.format(long="b", short="a")} END"""
)
def edit_distance_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All words. The other engine's distance counts bytes, so the SQL tells one edit of characters by itself."""
    b = benchmark_words(spark, sf)
    return lexicon.too_close_pairs(b, b, 2).where("word_a < word_b")


@query()
def greedy_confusion_select(spark: SparkSession, sf: str) -> DataFrame:
    """200 words that keep a distance of 2 from each other."""
    c = benchmark_words(spark, sf).where(F.size("phonemes") >= 2).withColumn("pos", F.lit(0))
    return lexicon.greedy_selection(c, c.limit(0), 200, 2)


_KANA = [("ア", "a"), ("シ", "sh i"), ("キャ", "k y a"), ("トウキョウ", "t o u k y o u"), ("シンブン", "sh i ng b u ng"), ("ガッコウ", "g a q k o u"), ("チェック", "ch e q k u"), ("ティー", "t i long"), ("ヴァイオリン", "b a i o r i ng"), ("フュージョン", "f y u long j o ng"), ("スィート", "s u i long t o"), ("", "")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{p}')" for k, p in _KANA) + ") AS t(kana, phonemes)")
def kana_phonemes(spark: SparkSession, sf: str) -> DataFrame:
    """X1, X12, S20."""
    return spark.createDataFrame([(k,) for k, _ in _KANA], "kana string").select("kana", P.phoneme_string(P.kana_to_phonemes(F.col("kana"))).alias("phonemes"))


_TRI = f"{_BWORDS}, c AS (SELECT w, list_concat(['#'], list_filter(string_split(w, ''), lambda x: x <> ''), ['#']) AS s FROM b), x AS (SELECT w, unnest(list_transform(range(2, len(s)), lambda i: s[i - 1] || '-' || s[i] || '+' || s[i + 1])) AS tri FROM c)"


@query(f"WITH {_TRI} SELECT w AS word, tri FROM x")
def triphones(spark: SparkSession, sf: str) -> DataFrame:
    """X8, X9, W2."""
    return benchmark_words(spark, sf).select("word", F.explode(P.word_triphones(F.col("phonemes"))).alias("tri"))


@query(f"WITH {_TRI} SELECT tri, n, CASE WHEN regexp_matches(tri, '^[^-]*-.*\\+[^+]*$') THEN regexp_extract(tri, '^[^-]*-(.*)\\+[^+]*$', 1) ELSE tri END AS center FROM (SELECT tri, count(*) AS n FROM x GROUP BY tri) WHERE n >= 10")
def triphone_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """F12, X10, A9."""
    got = triphones(spark, sf).groupBy("tri").agg(F.count("*").alias("n")).where("n >= 10")
    return got.select("tri", "n", P.center_phoneme(F.col("tri")).alias("center"))


# ---------------------------------------------------------------- products and ranking
@query("SELECT n_name || ' in ' || r_name || ' for ' || seg AS sentence FROM nation, region, (SELECT DISTINCT c_mktsegment AS seg FROM customer)")
def corpus_product(spark: SparkSession, sf: str) -> DataFrame:
    """J13, X15, G1."""
    column = lambda t, c: [r[0] for r in table(spark, sf, t).select(c).distinct().orderBy(c).collect()]
    return corpus.product(spark, "%s in %s for %s", [column("nation", "n_name"), column("region", "r_name"), column("customer", "c_mktsegment")]).select("sentence")


@query()
def slot_sample(spark: SparkSession, sf: str) -> DataFrame:
    """G1: a seeded sample of 300 of a product, which is the feature."""
    return corpus.sampled(corpus_product(spark, sf), 300)


@query(
    """WITH g AS (SELECT * FROM (VALUES (8.0::DOUBLE), (10.0), (12.0)) AS a(lm_weight), (VALUES (0.0::DOUBLE), (2.0), (4.0)) AS b(word_penalty)),
r AS (SELECT lm_weight, word_penalty, CAST(sum(CAST(quality = 1 AS INT) * CAST(doc_id % CAST(lm_weight AS BIGINT) >= word_penalty AS INT)) AS BIGINT) AS correct, count(*) AS total FROM g, labels GROUP BY ALL)
SELECT *, round(correct / total * 100.0, 6) AS accuracy, CAST(row_number() OVER (ORDER BY correct DESC, lm_weight, word_penalty) AS INTEGER) AS rank FROM r"""
)
def grid_rank(spark: SparkSession, sf: str) -> DataFrame:
    """J11, J12, A20, O4, X17."""
    g = decoder.grid(spark, [8.0, 10.0, 12.0], [0.0, 2.0, 4.0], [1000], [0]).select("lm_weight", "word_penalty")
    hit = (F.col("quality") == 1) & (F.pmod("doc_id", F.col("lm_weight").cast("long")) >= F.col("word_penalty"))
    return decoder.ranked(table(spark, sf, "labels").crossJoin(g), hit, ["lm_weight", "word_penalty"]).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, " + _WORDS + " AS w FROM conversations) WHERE NOT (len(w) >= 4 AND w[1] = w[3])")
def self_reference_filter(spark: SparkSession, sf: str) -> DataFrame:
    """F16."""
    return table(spark, sf, "conversations").where(~X.self_referring(X.fields_u(F.col("text")))).select("conv_id", "turn")


@query("SELECT page_id, regexp_replace(url, '\\.[^./]*$', '') || '.wav' AS wav, coalesce(try_cast(regexp_extract(url, '([0-9]+)$', 1) AS INTEGER), -1) AS number FROM pages")
def names_and_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """X14, X16."""
    digits = F.regexp_extract("url", "([0-9]+)$", 1)
    return table(spark, sf, "pages").select("page_id", X.wav_name(F.col("url")).alias("wav"), F.coalesce(F.get(X.numbers(digits, "int"), F.lit(0)), F.lit(-1)).alias("number"))


@query(
    f"""WITH {_DOCS}, {_G1}, {_G2}, {_P1}, {_P2}, {_BO1},
r AS (SELECT 1 AS ord, w AS ngram, log10(p) AS lp, coalesce(bo, 0.0) AS bo FROM p1 LEFT JOIN b1 ON w = h UNION ALL SELECT 2, w1 || ' ' || w2, log10(p), 0.0 FROM p2)
SELECT CAST(ord AS INTEGER) AS ord, ngram, round(CAST(printf('%.6f', lp) AS DOUBLE) * 2.302585092994046, 5) + 0.0 AS log_prob, round(CAST(printf('%.6f', bo) AS DOUBLE) * 2.302585092994046, 5) + 0.0 AS log_backoff FROM r"""
)
def language_model_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The model of documents as lines of a file, read back from them."""
    from phonoflow.sources.readers import arpa_grams
    from phonoflow.sources.writers import arpa_lines

    lines = arpa_lines(lm.build(documents(spark, sf), 2))
    numbered = cut_lineage(lines.orderBy("part", "ngram").select("value", F.monotonically_increasing_id().alias("pos")))
    return arpa_grams(numbered).select("ord", X.join_words(F.col("words")).alias("ngram"), (F.round("log_prob", 5) + 0.0).alias("log_prob"), (F.round("log_backoff", 5) + 0.0).alias("log_backoff"))
