"""Decoding many utterances, the parameter grid and the recogniser (C4-C6, J11, J12, A20, O4, K9, K10, G4, §2.13)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phonoflow.functions import kernels as K
from phonoflow.functions import network as N
from phonoflow.functions import search as S
from phonoflow.operators import acoustic
from phonoflow.operators.features import matrix, mfcc, warped
from phonoflow.operators.lm import END, LN10, START, NGramModel, natural
from phonoflow.session import cut_lineage

RESULT = "struct<text:string,score:double,words:array<struct<text:string,start:int,end:int>>>"


#: n-grams that the driver and every decoding process may hold, some 200 bytes each
MOST_GRAMS = 10_000_000


def language_model(model: NGramModel, words: set[str] | None = None, most: int = MOST_GRAMS) -> S.LanguageModel:
    """A model's tables in memory, in natural logs; for the decoder, whose lookups are per token.

    With ``words``, those of the dictionary, n-grams that no decoding can ask for stay out: all unigrams and what follows
    the start mark are kept, as they bound the search, and else only n-grams of these words and the marks. A model that has
    more than ``most`` n-grams left is refused before anything is collected.
    """
    m = natural(model)
    bi, tri = m.bi, m.tri
    if words is not None:
        known = cut_lineage(model.uni.sparkSession.createDataFrame([(w,) for w in sorted(words | {START, END})], "_k string"))
        among = lambda d, c: d.join(known, F.col(c) == F.col("_k"), "left_semi")
        bi = among(among(bi.where(F.col("h") != START), "h"), "w").unionByName(bi.where(F.col("h") == START))
        tri = None if tri is None else among(among(among(tri, "h2"), "h1"), "w")
    total = sum(d.count() for d in (m.uni, bi, tri) if d is not None)
    if total > most:
        raise ValueError(f"{total} n-grams are more than the {most} that a decoder may hold")
    uni = {r["w"]: (r["lp"], r["bo"]) for r in m.uni.collect()}
    pairs = {(r["h"], r["w"]): (r["lp"], r["bo"]) for r in bi.collect()}
    triples = {} if tri is None else {(r["h2"], r["h1"], r["w"]): r["lp"] for r in tri.collect()}
    return S.LanguageModel(model.order, uni, pairs, triples, model.oov)


def first_words(dictionary: DataFrame) -> dict[str, list[str]]:
    """Word -> first pronunciation."""
    return {r["word"]: r["phonemes"] for r in dictionary.where("pron_idx = 0").collect()}


@dataclass
class Recognizer:
    """The facade: models, parameters and options; use :func:`recognizer` to load them from files."""

    model: acoustic.Model
    lm: S.LanguageModel
    words: dict[str, list[str]]
    features: K.FeatureConfig = field(default_factory=K.FeatureConfig)
    search: S.SearchConfig = field(default_factory=S.SearchConfig)
    oov_log10: float = 0.0
    vtln: bool = False
    network: N.Network | None = None

    def __post_init__(self) -> None:
        if self.oov_log10:
            self.lm.oov = self.oov_log10 * LN10  # applied however the models came (Q10)
        self.trie = S.Trie(self.words, self.model)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """C4: frames x 3 models."""
        if self.network is not None:
            return S.class_emissions(self.trie, self.model, N.likelihoods(self.network, x), self.network.phonemes)
        return S.emission_matrix(self.trie, {m: K.emissions(self.model[m], x) for m in self.trie.models})

    def decode_features(self, x: np.ndarray, search: S.SearchConfig | None = None) -> S.Result:
        """One utterance's features."""
        return S.decode(self.emissions(x), self.trie, self.lm, search or self.search) if len(x) and self.trie.models else S.Result()


def decoded(utterances: DataFrame, r: Recognizer, features: str = "features") -> DataFrame:
    """``utterances`` with result (text, score, words). The models are broadcast: a vocabulary, not a corpus."""
    shared = utterances.sparkSession.sparkContext.broadcast(r)
    seg = pa.list_(pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(RESULT)
    def run(x: pa.Array) -> pa.Array:
        got = [shared.value.decode_features(matrix(v)) if v.is_valid else None for v in x]
        return pa.array([None if g is None else {"text": g.text, "score": g.score, "words": [{"text": w.text, "start": w.start, "end": w.end} for w in g.words]} for g in got], pa.struct([("text", pa.string()), ("score", pa.float64()), ("words", seg)]))

    return utterances.withColumn("result", run(F.col(features)))


def recognized(utterances: DataFrame, r: Recognizer, samples: str = "samples") -> DataFrame:
    """RecognizeSamples over many rows: features, with the best warp where ``vtln``, then the search."""
    if r.vtln:
        hmms = [h for n, h in sorted(r.model.items()) if "-" not in n]
        f = F.col("_w.features")
        rows = utterances.withColumn("_w", warped(F.col(samples), lambda x: K.frame_likelihood(hmms, x), r.features)).withColumn("features", f).drop("_w")
    else:
        rows = utterances.withColumn("features", mfcc(F.col(samples), r.features))
    return decoded(rows, r)


def recognize_files(spark: SparkSession, path: str, r: Recognizer) -> DataFrame:
    """RecognizeFile over a folder or glob of WAV files: (path, result)."""
    from phonoflow.sources.audio import read_wav

    return recognized(read_wav(spark, path).where("error is null"), r).select("path", "result")


def recognizer(spark: SparkSession, am_path: str, lm_path: str, dict_path: str, network_path: str | None = None, **options) -> Recognizer:  # noqa: ANN003
    """NewRecognizer: models from their files; a network that can't be read is warned of and left out."""
    import warnings

    from phonoflow.operators.network import load_network
    from phonoflow.sources import readers

    net = None
    if network_path:
        try:
            net = load_network(spark, network_path)
        except Exception as e:  # noqa: BLE001
            warnings.warn(f"network not loaded: {e}", stacklevel=2)
    words = first_words(readers.read_dictionary(spark, dict_path))
    return Recognizer(acoustic.load_model(spark, am_path), language_model(readers.read_arpa(spark, lm_path), set(words)), words, network=net, **options)


# ---------------------------------------------------------------- grid search
def grid(spark: SparkSession, lm_weights: list[float], word_penalties: list[float], max_tokens: list[int], max_word_ends: list[int]) -> DataFrame:
    """Every combination."""
    out = spark.range(0, 1, 1, 1)
    for name, kind, values in (("lm_weight", "double", lm_weights), ("word_penalty", "double", word_penalties), ("max_tokens", "int", max_tokens), ("max_word_ends", "int", max_word_ends)):
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v).cast(kind) for v in values])))
    return out.drop("id")


#: Cases whose emissions are held at once.
CASES = 512
GRID = ["lm_weight", "word_penalty", "max_tokens", "max_word_ends"]


def ranked(results: DataFrame, hit: Column, by: list[str] = GRID) -> DataFrame:
    """(parameters, correct, total, accuracy, rank): most correct first, then the smallest first parameter, then the others."""
    got = results.groupBy(*by).agg(F.sum(hit.cast("long")).alias("correct"), F.count("*").alias("total"))
    w = Window.orderBy(F.desc("correct"), *by)
    return got.withColumn("accuracy", F.col("correct") / F.col("total") * 100.0).withColumn("rank", F.row_number().over(w))


def tuned(cases: DataFrame, params: DataFrame, r: Recognizer) -> DataFrame:
    """Cases (features, expected) by all parameters; emissions are computed once a case, not once a pair."""
    shared = cases.sparkSession.sparkContext.broadcast(r)
    points = [tuple(p) for p in params.select(*GRID).collect()]

    def run(batches):  # noqa: ANN001, ANN202
        for pdf in batches:
            for at in range(0, len(pdf), CASES):
                some = pdf.iloc[at : at + CASES]
                emits = [shared.value.emissions(np.stack(list(x)).astype(float)) for x in some["features"]]
                expected = some["expected"].tolist()
                for p in points:
                    cfg = S.SearchConfig(shared.value.search.beam, p[2], p[0], p[1], shared.value.search.lm_interpolation, p[3])
                    got = S.decode_all(emits, shared.value.trie, shared.value.lm, cfg)
                    yield pd.DataFrame([(*p, g.text == e) for g, e in zip(got, expected, strict=True)], columns=[*GRID, "hit"])

    return ranked(cases.select("features", "expected").mapInPandas(run, "lm_weight double, word_penalty double, max_tokens int, max_word_ends int, hit boolean"), F.col("hit"))
