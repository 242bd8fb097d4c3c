"""Acoustic models: tables of hidden Markov models, EM, forced alignment, monophones and triphones.

M1-M15, J7-J10, A9-A16, F10-F12, K2, S17, W6. A model is two narrow tables, so that it is saved, joined and compared like
any other data; kernels get it as a broadcast of :class:`~phonoflow.functions.kernels.Hmm`. Training shuffles statistics,
never frames: each partition adds up its segments, one aggregation by (model, state, mixture) adds the partitions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoflow.functions import kernels as K
from phonoflow.functions import phonemes as P
from phonoflow.functions.common import let
from phonoflow.operators.features import matrix

STATE_SCHEMA = "name string, phoneme string, state int, mix int, mean array<double>, var array<double>, log_weight double"
MOVE_SCHEMA = "name string, from_state int, to_state int, log_prob double"
Model = dict[str, K.Hmm]


# ---------------------------------------------------------------- models as tables
def state_table(spark: SparkSession, model: Model) -> DataFrame:
    """A row per model, state and mixture."""
    return spark.createDataFrame([(n, h.phoneme, s + 1, m, h.mean[s, m].tolist(), h.var[s, m].tolist(), float(h.log_weight[s, m])) for n, h in sorted(model.items()) for s in range(K.STATES) for m in range(h.log_weight.shape[1])], STATE_SCHEMA)


def move_table(spark: SparkSession, model: Model) -> DataFrame:
    """A row per transition that isn't LOG_ZERO."""
    return spark.createDataFrame([(n, int(i), int(j), float(h.trans[i, j])) for n, h in sorted(model.items()) for i, j in zip(*np.nonzero(h.trans > P.LOG_ZERO + 1), strict=True)], MOVE_SCHEMA)


def model_from(states: DataFrame, moves: DataFrame) -> Model:
    """The tables' model; models are of a bounded size and go to the driver."""
    out: Model = {}
    pdf = states.toPandas().sort_values(["name", "state", "mix"])
    for name, g in pdf.groupby("name"):
        m = len(g) // K.STATES
        shape = lambda c: np.stack(g[c].to_numpy()).reshape(K.STATES, m, -1)  # noqa: B023, E731
        out[name] = K.Hmm(g["phoneme"].iloc[0], shape("mean"), shape("var"), g["log_weight"].to_numpy().reshape(K.STATES, m), np.full((5, 5), P.LOG_ZERO))
    for r in moves.collect():
        out[r["name"]].trans[r["from_state"], r["to_state"]] = r["log_prob"]
    return out


def save_model(spark: SparkSession, model: Model, path: str) -> None:
    """K2."""
    state_table(spark, model).write.mode("overwrite").parquet(f"{path}/states")
    move_table(spark, model).write.mode("overwrite").parquet(f"{path}/moves")


def load_model(spark: SparkSession, path: str) -> Model:
    """S17."""
    return model_from(spark.read.parquet(f"{path}/states"), spark.read.parquet(f"{path}/moves"))


def new_model(phonemes: list[str], dim: int, mixtures: int, seed: int = 0) -> Model:
    """M6."""
    return {p: K.new_hmm(p, dim, mixtures, seed) for p in phonemes}


def resolved(model: Model, tri: str) -> K.Hmm | None:
    """The triphone's model, else its centre's, else None."""
    inner = tri.partition("-")[2].rpartition("+")[0] if "-" in tri and "+" in tri else tri
    return model.get(tri) or model.get(inner)


def has_triphones(model: Model) -> bool:
    """M6."""
    return any("-" in n for n in model)


# ---------------------------------------------------------------- likelihoods as expressions
def gaussian_log(x: Column, mean: Column, var: Column) -> Column:
    """M1 in the JVM: the log density of a diagonal Gaussian."""
    z = F.zip_with(F.zip_with(x, mean, lambda a, b: (a - b) * (a - b)), var, lambda d, v: d / v + F.log(v))
    return F.lit(-0.5) * (F.size(x) * F.lit(math.log(2 * math.pi)) + F.aggregate(z, F.lit(0.0), lambda s, v: s + v))


def mixture_log(rows: DataFrame, by: list[str], log: str = "lp") -> DataFrame:
    """(by, lp, n): log-sum-exp of ``log`` over ``by`` in one aggregation pair, shifted by the maximum, and how many there are."""
    top = rows.groupBy(*by).agg(F.max(log).alias("_top"), F.collect_list(log).alias("_all"))
    total = F.col("_top") + F.log(F.aggregate("_all", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("_top"))))
    return top.select(*by, total.alias(log), F.size("_all").alias("n"))


def posteriors(mixes: Column) -> Column:
    """(mix, p) of an array of (mix, lp): each one's share of the sum."""
    top = F.array_max(F.transform(mixes, lambda m: m.lp))
    return let(mixes, lambda a: let(top, lambda t: let(F.aggregate(a, F.lit(0.0), lambda s, m: s + F.exp(m.lp - t)), lambda z: F.transform(a, lambda m: F.struct(m.mix.alias("mix"), (F.exp(m.lp - t) / z).alias("p"))))))


def frame_likelihood(rows: DataFrame, utt: str, frame: str, log: str = "lp") -> DataFrame:
    """(utt, score): the best state's value at each frame, added up."""
    return rows.groupBy(utt, frame).agg(F.max(log).alias("_m")).groupBy(utt).agg(F.sum("_m").alias("score"))


def mixture_scores(frames: DataFrame, states: DataFrame, feature: str = "feature") -> DataFrame:
    """``frames`` with scores, a map of name and state to log-likelihood; the model is broadcast as arrays."""
    rows = states.toPandas().sort_values(["name", "state", "mix"])
    groups = [(f"{n}/{s}", np.stack(g["mean"]), np.stack(g["var"]), g["log_weight"].to_numpy()) for (n, s), g in rows.groupby(["name", "state"])]
    shared = frames.sparkSession.sparkContext.broadcast(groups)

    @F.arrow_udf("map<string,double>")
    def score(x: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.map_(pa.string(), pa.float64()))
        v = np.asarray(x.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(x), -1)
        got = np.stack([K.mixture_logs(v, m, s, w) for _, m, s, w in shared.value], 1)
        names = [g[0] for g in shared.value]
        return pa.MapArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(names), pa.array(names * len(x)), pa.array(got.ravel()))

    return frames.withColumn("scores", score(F.col(feature)))


def class_priors(counts: DataFrame, n_classes: int, cls: str = "cls", n: str = "n") -> DataFrame:
    """(cls, log_prior) of every class; one without frames has the floor ln(1 / (10 total))."""
    every = counts.sparkSession.range(n_classes).select(F.col("id").cast("int").alias(cls))
    total = counts.agg(F.sum(n).alias("_t"))
    prior = F.when(F.coalesce(F.col(n), F.lit(0)) > 0, F.log(F.col(n) / F.col("_t"))).otherwise(F.log(F.lit(1.0) / (10.0 * F.col("_t"))))
    return every.join(counts, cls, "left").crossJoin(F.broadcast(total)).select(cls, prior.alias("log_prior"))


# ---------------------------------------------------------------- EM
def _sum_arrays(name: str, size: int) -> Column:
    return F.array(*[F.sum(F.get(F.col(name), F.lit(i))) for i in range(size)]).alias(name)


def em_statistics(segments: DataFrame, model: Model, name: str = "name", features: str = "features") -> DataFrame:
    """(name, state, mix, ll, moves, occupancy, first, second) over all segments (name, features).

    A partition adds up per model before anything is shuffled; only vectors of the feature size go over the network.
    """
    if not model:
        raise ValueError("an empty model")
    shared = segments.sparkSession.sparkContext.broadcast(model)
    dim = next(iter(model.values())).mean.shape[2]
    schema = "name string, state int, mix int, ll double, n long, moves array<double>, occupancy double, first array<double>, second array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, K.Statistics] = {}
        count: dict[str, int] = {}
        for b in batches:
            for key, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                h = shared.value.get(key)
                if h is None or not x.is_valid or not len(x.values):
                    continue
                held[key] = held.get(key, K.empty_statistics(h)) + K.statistics(h, matrix(x))
                count[key] = count.get(key, 0) + 1
        rows = []
        for key, s in held.items():
            for i in range(K.STATES):
                for m in range(s.occupancy.shape[1]):
                    once = i == 0 and m == 0
                    rows.append((key, i + 1, m, s.ll if once else 0.0, count[key] if once else 0, s.moves[i].tolist() if m == 0 else [0.0] * 4, float(s.occupancy[i, m]), s.first[i, m].tolist(), s.second[i, m].tolist()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    parts = segments.select(F.col(name).alias("name"), F.col(features).alias("features")).mapInArrow(run, schema)
    return parts.groupBy("name", "state", "mix").agg(F.sum("ll").alias("ll"), F.sum("n").alias("n"), _sum_arrays("moves", 4), F.sum("occupancy").alias("occupancy"), _sum_arrays("first", dim), _sum_arrays("second", dim))


def train(segments: DataFrame, model: Model, iterations: int = 20, threshold: float = 0.01, floor: float = 0.01, name: str = "name", features: str = "features") -> tuple[Model, dict[str, list[float]]]:
    """All models at once; one job per iteration, and only the models that haven't converged go on.

    ``segments`` is read once per iteration: keep it in a table. Statistics that reach the driver have the model's size.
    """
    model, history, todo = dict(model), {n: [] for n in model}, set(model)
    for i in range(iterations):
        active = {n: model[n] for n in todo}
        if not active:
            break
        rows = em_statistics(segments.where(F.col(name).isin(sorted(active))), active, name, features).toPandas()
        todo = set()
        for n, g in rows.sort_values(["state", "mix"]).groupby("name"):
            h, m = model[n], model[n].log_weight.shape[1]
            stack = lambda c: np.stack(g[c].to_numpy())  # noqa: B023, E731
            s = K.Statistics(float(g["ll"].sum()), stack("moves").reshape(3, m, 4).sum(1), g["occupancy"].to_numpy().reshape(3, m), stack("first").reshape(3, m, -1), stack("second").reshape(3, m, -1))
            history[n].append(s.ll)
            if i and history[n][-1] - history[n][-2] < threshold:
                continue
            model[n] = K.re_estimated(h, s, floor)
            todo.add(n)
    return model, history


# ---------------------------------------------------------------- alignment
ALIGN_SCHEMA = "segments array<struct<pos:int,phoneme:string,start:int,end:int>>, states array<int>, error string"


def forced_alignment(utterances: DataFrame, model: Model, key: str = "utt_id") -> DataFrame:
    """(key, segments, states, error) of (key, phonemes, features).

    ``states`` is position * 3 + state - 1 per frame. An utterance that can't be aligned has an error and null elsewhere (Q8).
    """
    shared = utterances.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(f"struct<{ALIGN_SCHEMA.replace(' array', ':array').replace(' string', ':string')}>")
    def run(phonemes: pa.Array, features: pa.Array) -> pa.Array:
        out = []
        for ph, x in zip(phonemes.to_pylist(), features, strict=True):
            try:
                feats = matrix(x) if x.is_valid else np.zeros((0, 0))
                unknown = [p for p in ph or [] if p not in shared.value]
                if unknown:
                    raise ValueError(f"unknown phoneme {unknown[0]}")
                hmms = [shared.value[p] for p in ph or []]
                if len(feats) < len(hmms) or not hmms:
                    K.align(hmms, feats)  # raises
                cache = {p: K.emissions(shared.value[p], feats) for p in set(ph)}
                path = K.align(hmms, np.concatenate([cache[p] for p in ph], 1))
                out.append({"segments": [{"pos": p, "phoneme": ph[p], "start": a, "end": b} for p, a, b in K.segments(path)], "states": path.tolist(), "error": None})
            except ValueError as e:
                out.append({"segments": None, "states": None, "error": str(e)})
        seg = pa.list_(pa.struct([("pos", pa.int32()), ("phoneme", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array(out, pa.struct([("segments", seg), ("states", pa.list_(pa.int32())), ("error", pa.string())]))

    return utterances.select(key, run("phonemes", "features").alias("a")).select(key, "a.segments", "a.states", "a.error")


def cut_segments(rows: DataFrame, min_frames: int = 3) -> DataFrame:
    """(name, features): the frames of each of ``segments`` (phoneme, start, end) that is long enough."""
    one = rows.select("features", F.explode("segments").alias("s")).where(F.col("s.end") - F.col("s.start") >= min_frames)
    return one.select(F.col("s.phoneme").alias("name"), F.slice("features", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("features"))


def uniform(utterances: DataFrame) -> DataFrame:
    """Segments of utterances without any model."""
    from phonoflow.operators.features import uniform_segments

    return utterances.withColumn("segments", uniform_segments(F.col("phonemes"), F.transform("features", lambda f: F.get(f, F.lit(0)))))


def realigned(utterances: DataFrame, model: Model, key: str = "utt_id") -> DataFrame:
    """Segments by alignment; evenly dealt frames, edges and all, where that fails."""
    got = forced_alignment(utterances, model, key).select(F.col(key).alias("_k"), F.transform("segments", lambda s: F.struct(s.phoneme.alias("phoneme"), s.start.alias("start"), s.end.alias("end"))).alias("_s"))
    n, total = F.size("phonemes"), F.size("features")
    each, rest = F.floor(total / n).cast("int"), F.pmod(total, n)
    even = F.when((n > 0) & (total >= n), F.transform("phonemes", lambda p, i: F.struct(p.alias("phoneme"), (i * each + F.least(i, rest)).cast("int").alias("start"), ((i + 1) * each + F.least(i + 1, rest)).cast("int").alias("end"))))
    return utterances.join(got, F.col(key) == F.col("_k")).withColumn("segments", F.coalesce("_s", even)).drop("_k", "_s")


def coverage(segments: DataFrame, phonemes: DataFrame) -> DataFrame:
    """(phoneme, n_segments) of every phoneme, those without any too."""
    return phonemes.select("phoneme").join(segments.groupBy(F.col("name").alias("phoneme")).agg(F.count("*").alias("n")), "phoneme", "left").select("phoneme", F.coalesce("n", F.lit(0)).alias("n_segments"))


def train_monophones(utterances: DataFrame, phonemes: list[str], mixtures: int, iterations: int = 20, alignments: int = 0, seed: int = 0, key: str = "utt_id") -> Model:
    """From even segments, then from ``alignments`` rounds of re-alignment."""
    from phonoflow.session import cut_lineage

    utts = cut_lineage(utterances.where(F.size("features") >= F.size("phonemes")))
    first = utts.select(F.size(F.get("features", F.lit(0))).alias("d")).where("d > 0").first()
    if first is None:
        raise ValueError("no utterance with enough frames")
    model = new_model(phonemes, first["d"], mixtures, seed)
    for i in range(alignments + 1):
        rows = cut_segments(uniform(utts) if i == 0 else realigned(utts, model, key))
        model, _ = train(cut_lineage(rows), model, iterations)
    return model


def triphone_segments(utterances: DataFrame, model: Model, key: str = "utt_id", min_frames: int = 3) -> DataFrame:
    """(name, features) by triphone; utterances (key, phonemes, word_phonemes, features) with silence at both ends.

    Words' triphones and aligned segments meet by position, the first segment being the silence.
    """
    tri = F.flatten(F.transform("word_phonemes", P.word_triphones))
    got = forced_alignment(utterances, model, key).where("error is null").select(F.col(key).alias("_k"), F.col("segments").alias("_s"))
    rows = utterances.join(got, F.col(key) == F.col("_k")).select("features", "_s", F.posexplode(tri).alias("i", "name"))
    one = rows.select("name", "features", F.get("_s", F.col("i") + 1).alias("s")).where(F.col("s.end") - F.col("s.start") >= min_frames)
    return one.select("name", F.slice("features", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("features"))


def train_triphones(segments: DataFrame, mono: Model, mixtures: int | None = None, min_segments: int = 10, iterations: int = 20, seed: int = 0) -> Model:
    """Monophones and the triphones with enough segments; clones of their centre, or fresh for another number of mixtures."""
    base = next(iter(mono.values()))
    mixtures = mixtures or min(4, base.log_weight.shape[1])
    enough = [r["name"] for r in segments.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= min_segments).select("name").collect()]
    fresh = {}
    for n in sorted(enough):
        center = n.partition("-")[2].rpartition("+")[0]
        if center in mono:
            same = mixtures == base.log_weight.shape[1]
            fresh[n] = mono[center].clone() if same else K.new_hmm(center, base.mean.shape[2], mixtures, seed)
    if not fresh:
        return dict(mono)
    got, _ = train(segments.where(F.col("name").isin(sorted(fresh))), fresh, iterations)
    return mono | got


# ---------------------------------------------------------------- hard assignment and one soft step, relational
def gaussian_statistics(rows: DataFrame, by: str, vector: str, floor: float = 0.01) -> DataFrame:
    """A12, A13 with given states: (by, dim, n, mean, var) per dimension, variances with a floor."""
    long = rows.select(by, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "v"))
    stats = long.groupBy(by, "dim").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.avg(F.col("v") * F.col("v")).alias("second"))
    return stats.select(by, "dim", "n", "mean", F.greatest(F.col("second") - F.col("mean") * F.col("mean"), F.lit(floor)).alias("var"))


def total_statistics(parts: list[K.Statistics]) -> K.Statistics:
    """A10: partial sums to one."""
    return reduce(lambda a, b: a + b, parts)


def hmm_recursions(sequences: DataFrame, model: Model, key: str = "seq") -> DataFrame:
    """(key, total, total_with_exit) of (key, name, features); null for an unknown model or no frames."""
    shared = sequences.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("total double, total_with_exit double")
    def run(name: pd.Series, features: pd.Series) -> pd.DataFrame:
        out = []
        for n, x in zip(name, features, strict=True):
            h = shared.value.get(n)
            if h is None or x is None or not len(x):
                out.append((None, None))
                continue
            a = K.forward(h.trans, e := K.emissions(h, np.stack(x).astype(float)))
            out.append((K.total_likelihood(a), float(K.log_sum_exp(a[-1] + K.backward(h.trans, e)[-1]))))
        return pd.DataFrame(out, columns=["total", "total_with_exit"])

    return sequences.select(key, run("name", "features").alias("r")).select(key, "r.total", "r.total_with_exit")
