"""N-gram language models: counting, Witten-Bell smoothing, back-off weights and scoring.

A model is three narrow tables: uni (w), bi (h, w) and tri (h2, h1, w), with log10 columns as ARPA has them, and natural
logs when it is used for scoring. Counting needs no window: n-grams are made inside each sentence's array, so the only
shuffle is that of packed blocks (functions/grams.py).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoflow.functions import grams
from phonoflow.functions.common import let
from phonoflow.functions.grams import END, START
from phonoflow.functions.phonemes import LOG_ZERO
from phonoflow.session import bound_batches, stored

LN10 = 2.302585092994046
#: Pairs of words that a broadcast may hold.
BROADCAST_ROWS = 1_000_000
#: Bytes of files whose n-grams one task folds, tasks at most, and what Spark says of a size that it doesn't know.
BUCKET_BYTES, MOST_BUCKETS, UNKNOWN_BYTES = 3 << 20, 20_000, 1 << 50


def padded(words: Column) -> Column:
    """A sentence between its marks."""
    return F.concat(F.array(F.lit(START)), words, F.array(F.lit(END)))


def ngrams(words: Column, n: int) -> Column:
    """The n-grams of an array as structs w1..wn; empty for a shorter array."""
    none = F.array().cast("array<struct<" + ",".join(f"w{k + 1}:string" for k in range(n)) + ">>")

    def make(w: Column) -> Column:
        last = F.size(w) - n
        gram = lambda i: F.struct(*[F.get(w, i + k).alias(f"w{k + 1}") for k in range(n)])
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), gram)).otherwise(none)

    return let(words, make)


def clamp_order(order: int) -> int:
    """A1: bigram or trigram models only."""
    return min(3, max(2, order))


def _buckets(df: DataFrame) -> int:
    """Tasks that n-grams are folded in: one for each BUCKET_BYTES of what is read, at least those of a shuffle."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(-(-size // BUCKET_BYTES), MOST_BUCKETS)) if size < UNKNOWN_BYTES else least


def _blocks(sentences: DataFrame, words: str, n: int, by: list[int], buckets: int, pad: int = 0, among: list | None = None) -> DataFrame:
    """Packed counts of n-grams, by bucket."""
    bound_batches(sentences.sparkSession)
    run = lambda batches: grams.counted(batches, n, by, buckets, pad, among)
    return sentences.where(F.size(words) > 0).select(words).mapInArrow(run, "bucket int, block binary").repartitionById(buckets, "bucket").select("block")


def counts(sentences: DataFrame, n: int, words: str = "words") -> DataFrame:
    """A1: (w1..wn, c) over all sentences; empty ones don't count."""
    names = [*(f"w{k + 1}" for k in range(n)), "c"]
    packed = _blocks(sentences, words, n, list(range(n)), _buckets(sentences))
    return packed.mapInArrow(grams.reduced(n, lambda g: grams.count_rows(g, names)), ", ".join(f"{w} string" for w in names[:-1]) + ", c long")


def smoothed(sentences: DataFrame, n: int, words: str = "words", among: DataFrame | None = None) -> DataFrame:
    """A4: (w1..wn, p): c / (N(h) + T(h)), counted and smoothed in one exchange, by history.

    With ``among`` only n-grams whose first words are a row of it; a small one is sent to the tasks, so that the others
    aren't exchanged.
    """
    names, asked = [*(f"w{k + 1}" for k in range(n)), "p"], None
    if among is not None and (some := among.limit(BROADCAST_ROWS + 1).toArrow()).num_rows <= BROADCAST_ROWS:
        asked = [c.combine_chunks() for c in some.columns]
    packed = _blocks(sentences, words, n, list(range(max(1, n - 1))), _buckets(sentences), among=asked)
    got = packed.mapInArrow(grams.reduced(n, lambda g: grams.smoothed_rows(g, names)), ", ".join(f"{w} string" for w in names[:-1]) + ", p double")
    return got if among is None or asked is not None else got.join(among, among.columns, "left_semi")


def history_sums(sentences: DataFrame, n: int, words: str = "words") -> DataFrame:
    """A2-A5: (w1..wn, p, c, n, t, l) of histories of n words, END too: their own probability (n = 2; 1 for n = 1), how often they
    occur, and with a successor, how many successors they have, and how often these occur behind the last n - 1 words
    of the history (n = 1: anywhere).

    The (n+1)-grams are counted where the lower counts are, by their last n words, then added up by the history's first word.
    """
    buckets = _buckets(sentences)
    packed = _blocks(sentences, words, n + 1, [k + 1 for k in range(n)], buckets, pad=1)
    packed = packed.mapInArrow(grams.reduced(n + 1, lambda g: grams.blocks(grams.histories(g), [0], buckets)), "bucket int, block binary").repartitionById(buckets, "bucket").select("block")
    names = [*(f"w{k + 1}" for k in range(n)), "p", "c", "n", "t", "l"]
    kinds = ["string"] * n + ["double"] + ["long"] * 4
    return packed.mapInArrow(grams.reduced(n, lambda g: grams.sum_rows(g, names)), ", ".join(f"{a} {b}" for a, b in zip(names, kinds, strict=True)))


def context_totals(found: DataFrame, n: int) -> DataFrame:
    """A3: (history, n_h, t_h): how often, and with how many successors, a history occurs."""
    history = [f"w{k + 1}" for k in range(n - 1)]
    return found.groupBy(*history).agg(F.sum("c").alias("n_h"), F.count("*").alias("t_h"))


@dataclass(frozen=True)
class NGramModel:
    """L3: log10 tables; ``oov`` is a natural log, 0 for none."""

    order: int
    uni: DataFrame  # w, lp, bo
    bi: DataFrame  # h, w, lp, bo
    tri: DataFrame | None = None  # h2, h1, w, lp
    oov: float = 0.0


def _weight(upper: Column, lower: Column) -> Column:
    """A5: log10 of (1 - upper) / (1 - lower); 0 where the lower sum leaves nothing."""
    return F.when((lower < 1) & (upper < 1), F.log10((1 - upper) / (1 - lower))).otherwise(F.lit(0.0))


def backoff_bigrams(p_tri: DataFrame, p_bi: DataFrame) -> DataFrame:
    """A5: (h2, h1, bo) of two-word histories."""
    lower = p_bi.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("p").alias("pl"))
    sums = p_tri.join(lower, ["w2", "w3"]).groupBy("w1", "w2").agg(F.sum("p").alias("u"), F.sum("pl").alias("l"))
    return sums.select(F.col("w1").alias("h2"), F.col("w2").alias("h1"), _weight(F.col("u"), F.col("l")).alias("bo"))


def backoff_of_sums(lower: Column) -> Column:
    """A5: the weight of a row of :func:`history_sums`, ``lower`` being the sum of its successors' lower probabilities; 0 without successors."""
    return F.when(F.col("t") > 0, _weight(F.col("n") / (F.col("n") + F.col("t")), lower)).otherwise(F.lit(0.0))


def unigrams(sentences: DataFrame, words: str = "words") -> tuple[DataFrame, DataFrame]:
    """A2, A4, A5: (w, p, bo, t), p = c / N with N over all, the sentence marks too, and the sums they come from; one written table."""
    one = stored(history_sums(sentences, 1, words))
    total = F.lit(float(one.agg(F.sum("c")).first()[0] or 1))
    return one.select(F.col("w1").alias("w"), (F.col("c") / total).alias("p"), backoff_of_sums(F.col("l") / total).alias("bo"), "t"), one


def build(sentences: DataFrame, order: int = 3, words: str = "words", oov: float = 0.0, queries: DataFrame | None = None) -> NGramModel:
    """The smoothed model of a corpus. Each order is counted and smoothed in a pass of its own, whose result is not kept: who uses a table often stores it.

    With ``queries`` (h2, h1, w) only what they can ask for is smoothed: n-grams of their histories, whole ones, so that
    every value is that of the whole model; these tables are written.
    """
    order = clamp_order(order)
    single, one = unigrams(sentences, words)
    uni = single.select("w", F.log10("p").alias("lp"), "bo")
    pairs = lambda p2: p2.select(F.col("w1").alias("h"), F.col("w2").alias("w"), F.log10("p").alias("lp"))
    if queries is not None:
        asked = stored(queries.select(F.col("h2").alias("w1"), F.col("h1").alias("w2")).distinct())
        p2 = stored(smoothed(sentences, 2, words, asked.select(F.col("w2").alias("w1")).where("w1 is not null").distinct()))
        if order == 3:
            p3 = stored(smoothed(sentences, 3, words, asked.where("w1 is not null and w2 is not null")))
            bo2 = backoff_bigrams(p3, p2).select(F.col("h2").alias("h"), F.col("h1").alias("w"), "bo")
            bi = pairs(p2).join(bo2, ["h", "w"], "left").select("h", "w", "lp", F.coalesce("bo", F.lit(0.0)).alias("bo"))
    else:
        p2, p3 = smoothed(sentences, 2, words), smoothed(sentences, 3, words)
        if order == 3:
            # p comes with the sums, as all pairs of a first word are in one bucket; what follows the second word is one join
            behind = one.select(F.col("w1").alias("w2"), (F.col("n") + F.col("t")).alias("_d"))
            bi = history_sums(sentences, 2, words).join(behind, "w2").select(F.col("w1").alias("h"), F.col("w2").alias("w"), F.log10("p").alias("lp"), backoff_of_sums(F.col("l") / F.col("_d")).alias("bo"))
    if order == 2:
        return NGramModel(2, uni, pairs(p2).withColumn("bo", F.lit(0.0)), None, oov)
    return NGramModel(3, uni, bi, p3.select(F.col("w1").alias("h2"), F.col("w2").alias("h1"), F.col("w3").alias("w"), F.log10("p").alias("lp")), oov)


def natural(model: NGramModel) -> NGramModel:
    """Natural logs of a log10 model."""
    ln = lambda df, *c: df.withColumns({x: F.col(x) * LN10 for x in c})
    return NGramModel(model.order, ln(model.uni, "lp", "bo"), ln(model.bi, "lp", "bo"), None if model.tri is None else ln(model.tri, "lp"), model.oov)


def rounded(model: NGramModel, places: int = 6) -> NGramModel:
    """The model as it comes back from a file with so many places."""
    r = lambda df, *c: df.withColumns({x: F.round(x, places) for x in c})
    return NGramModel(model.order, r(model.uni, "lp", "bo"), r(model.bi, "lp", "bo"), None if model.tri is None else r(model.tri, "lp"), model.oov)


def vocabulary(model: NGramModel) -> DataFrame:
    """The distinct words."""
    return model.uni.select("w").distinct()


def best_start(model: NGramModel) -> float:
    """The best natural log-probability of a word after the start mark; 0 for an empty model."""
    m = natural(model)
    queries = m.uni.where(~F.col("w").isin(START, END)).select(F.monotonically_increasing_id().alias("q"), F.lit(None).cast("string").alias("h2"), F.lit(START).alias("h1"), "w")
    return scored(m, queries).agg(F.max("lp")).first()[0] or 0.0


def scored(model: NGramModel, queries: DataFrame) -> DataFrame:
    """``queries`` (h2, h1, w and others) with lp. ``model`` holds natural logs.

    Trigram, else its context bigram's back-off weight and the bigram; bigram, else the previous word's weight and the
    unigram; a context that isn't in the model costs nothing; an unknown word has the OOV value or LOG_ZERO. Chained left
    joins on the n-grams' keys; Spark broadcasts what is small.
    """
    uni = model.uni.select(F.col("w").alias("_u"), F.col("lp").alias("_lp1"))
    ctx = model.uni.select(F.col("w").alias("_c"), F.col("bo").alias("_bo1"))
    two = model.bi.select(F.col("h").alias("_bh"), F.col("w").alias("_bw"), F.col("lp").alias("_lp2"))
    q = queries.join(uni, F.col("w") == F.col("_u"), "left").join(ctx, F.col("h1") == F.col("_c"), "left")
    q = q.join(two, (F.col("h1") == F.col("_bh")) & (F.col("w") == F.col("_bw")), "left")
    unigram = F.coalesce("_lp1", F.lit(model.oov if model.oov else LOG_ZERO))
    lp = F.coalesce("_lp2", F.coalesce("_bo1", F.lit(0.0)) + unigram)
    if model.tri is not None:
        three = model.tri.select(F.col("h2").alias("_t2"), F.col("h1").alias("_t1"), F.col("w").alias("_tw"), F.col("lp").alias("_lp3"))
        weight = model.bi.select(F.col("h").alias("_wh"), F.col("w").alias("_ww"), F.col("bo").alias("_bo2"))
        q = q.join(three, (F.col("h2") == F.col("_t2")) & (F.col("h1") == F.col("_t1")) & (F.col("w") == F.col("_tw")), "left")
        q = q.join(weight, (F.col("h2") == F.col("_wh")) & (F.col("h1") == F.col("_ww")), "left")
        lp = F.coalesce("_lp3", F.coalesce("_bo2", F.lit(0.0)) + lp)
    return q.select(*queries.columns, lp.alias("lp"))


def sentence_tokens(sentences: DataFrame, key: str, words: str = "words") -> DataFrame:
    """(key, h2, h1, w): every word and the end mark with full histories; null before the start mark."""
    items = let(padded(F.col(words)), lambda p: F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.struct(F.get(p, i - 2).alias("h2"), F.get(p, i - 1).alias("h1"), F.get(p, i).alias("w"))))
    return sentences.select(key, F.explode(items).alias("t")).select(key, "t.h2", "t.h1", "t.w")


def sentence_scores(model: NGramModel, sentences: DataFrame, key: str, words: str = "words") -> DataFrame:
    """L2: (key, n_tokens, n_oov, log_prob): natural log-probability with both sentence marks and full histories."""
    known = model.uni.select(F.col("w").alias("_k"))
    rows = scored(model, sentence_tokens(sentences, key, words)).join(known, F.col("w") == F.col("_k"), "left")
    return rows.groupBy(key).agg(F.count("*").alias("n_tokens"), F.count(F.when(F.col("_k").isNull(), 1)).alias("n_oov"), F.sum("lp").alias("log_prob"))


def arpa_rows(model: NGramModel) -> DataFrame:
    """K1, O1: (ord, ngram, line): every n-gram line of the file; ord and ngram give the order, by bytes."""
    number = lambda c: F.format_string("%.6f", F.col(c) + 0.0)
    one = model.uni.select(F.lit(1).alias("ord"), F.col("w").alias("ngram"), F.when(F.col("bo") == 0, F.concat_ws("\t", number("lp"), "w")).otherwise(F.concat_ws("\t", number("lp"), "w", number("bo"))).alias("line"))
    name = F.concat_ws(" ", "h", "w")
    two = model.bi.select(F.lit(2).alias("ord"), name.alias("ngram"), (F.when((F.col("bo") == 0) | F.lit(model.order < 3), F.concat_ws("\t", number("lp"), name)).otherwise(F.concat_ws("\t", number("lp"), name, number("bo")))).alias("line"))
    out = one.unionByName(two)
    if model.tri is not None:
        name = F.concat_ws(" ", "h2", "h1", "w")
        out = out.unionByName(model.tri.select(F.lit(3).alias("ord"), name.alias("ngram"), F.concat_ws("\t", number("lp"), name).alias("line")))
    return out


def coverage(words: DataFrame, dictionary: DataFrame, key: str, word: str = "w") -> DataFrame:
    """(key, n_tokens, n_oov) of token rows against a dictionary of words."""
    d = dictionary.select(F.col("word").alias("_d")).distinct()
    return words.join(d, F.col(word) == F.col("_d"), "left").groupBy(key).agg(F.count("*").alias("n_tokens"), F.count(F.when(F.col("_d").isNull(), 1)).alias("n_oov"))
