"""Model queries: embeddings as observations of the classes in ``label``, events as sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoflow.functions import kernels as K
from phonoflow.functions import network as N
from phonoflow.functions import search as S
from phonoflow.operators import acoustic as A
from phonoflow.operators import decoder
from phonoflow.operators import network as NN
from phonoflow.plans.register import query
from phonoflow.plans.register import source as table
from phonoflow.plans.signal_queries import _U, _X, by_user, embeddings

CLASSES = 12
_LONG = "o AS (SELECT vec_id, label, i, x[i] AS v FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM e))"
_STATS = "g AS (SELECT label AS cls, i, count(*) AS n, avg(v) AS mean, greatest(avg(v * v) - avg(v) * avg(v), 0.01) AS var FROM o GROUP BY label, i)"
_LOGS = "c AS (SELECT o.vec_id, o.label, g.cls, -0.5 * sum(ln(2 * pi()) + ln(g.var) + (o.v - g.mean) * (o.v - g.mean) / g.var) AS lp FROM o JOIN g USING (i) GROUP BY ALL)"


@query(f"WITH {_X}, {_LONG}, {_STATS} SELECT cls AS label, CAST(i - 1 AS INTEGER) AS dim, n, round(mean, 6) + 0.0 AS mean, round(var, 6) AS var FROM g")
def gaussian_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A12, A13 with given states."""
    got = A.gaussian_statistics(embeddings(spark, sf), "label", "x")
    return got.select("label", "dim", "n", (F.round("mean", 6) + 0.0).alias("mean"), F.round("var", 6).alias("var"))


def class_logs(spark: SparkSession, sf: str) -> DataFrame:
    """(vec_id, label, cls, lp): every vector under every class's Gaussian."""
    e = embeddings(spark, sf)
    stats = A.gaussian_statistics(e, "label", "x").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("dim", "mean", "var"))).alias("s"))
    models = stats.select(F.col("label").alias("cls"), F.transform("s", lambda r: r["mean"]).alias("mean"), F.transform("s", lambda r: r["var"]).alias("var"))
    return e.crossJoin(F.broadcast(models)).select("vec_id", "label", "cls", A.gaussian_log(F.col("x"), F.col("mean"), F.col("var")).alias("lp"))  # a row per class


@query(f"WITH {_X}, {_LONG}, {_STATS}, {_LOGS} SELECT vec_id, cls, round(lp, 4) AS lp FROM c")
def gaussian_loglik(spark: SparkSession, sf: str) -> DataFrame:
    """M1."""
    return class_logs(spark, sf).select("vec_id", "cls", F.round("lp", 4).alias("lp"))


@query(f"WITH {_X}, {_LONG}, {_STATS}, {_LOGS}, t AS (SELECT *, max(lp) OVER (PARTITION BY vec_id) AS top FROM c) SELECT vec_id, round(any_value(top) + ln(sum(exp(lp - top))) - ln(count(*)), 4) AS lp FROM t GROUP BY vec_id")
def gmm_logsumexp(spark: SparkSession, sf: str) -> DataFrame:
    """The classes as equal mixtures."""
    got = A.mixture_log(class_logs(spark, sf), ["vec_id"])
    return got.select("vec_id", F.round(F.col("lp") - F.log("n"), 4).alias("lp"))


@query(f"WITH {_X}, {_LONG}, {_STATS}, {_LOGS} SELECT label, round(sum(m), 3) AS score FROM (SELECT label, vec_id, max(lp) AS m FROM c GROUP BY label, vec_id) GROUP BY label")
def frame_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    """A label's vectors as the frames of an utterance."""
    return A.frame_likelihood(class_logs(spark, sf), "label", "vec_id").select("label", F.round("score", 3).alias("score"))


@query(
    f"""WITH {_X}, {_LONG}, m AS (SELECT CASE WHEN label < 5 THEN 0 ELSE 1 END AS mix, i, avg(v) AS mean, greatest(avg(v * v) - avg(v) * avg(v), 0.01) AS var FROM o GROUP BY ALL),
c AS (SELECT vec_id, mix, -0.5 * sum(ln(2 * pi()) + ln(var) + (v - mean) * (v - mean) / var) - ln(2) AS lp FROM o JOIN m USING (i) GROUP BY ALL),
t AS (SELECT *, max(lp) OVER (PARTITION BY vec_id) AS top FROM c), r AS (SELECT vec_id, mix, exp(lp - top) / sum(exp(lp - top)) OVER (PARTITION BY vec_id) AS post FROM t)
SELECT CAST(mix AS INTEGER) AS mix, CAST(i - 1 AS INTEGER) AS dim, round(sum(post), 5) AS occupancy, round(sum(post * v) / sum(post), 5) + 0.0 AS mean, round(greatest(sum(post * v * v) / sum(post) - power(sum(post * v) / sum(post), 2), 0.01), 5) AS var FROM r JOIN o USING (vec_id) GROUP BY mix, i"""
)
def em_step(spark: SparkSession, sf: str) -> DataFrame:
    """One soft step of a mixture of two."""
    e = embeddings(spark, sf).withColumn("mix", F.when(F.col("label") < 5, 0).otherwise(1))
    stats = A.gaussian_statistics(e, "mix", "x").groupBy("mix").agg(F.sort_array(F.collect_list(F.struct("dim", "mean", "var"))).alias("s"))
    models = stats.select("mix", F.transform("s", lambda r: r["mean"]).alias("mean"), F.transform("s", lambda r: r["var"]).alias("var"))
    logs = e.drop("mix").crossJoin(F.broadcast(models)).select("vec_id", "x", "mix", (A.gaussian_log(F.col("x"), F.col("mean"), F.col("var")) - F.log(F.lit(2.0))).alias("lp"))
    # a vector's mixtures are one small array, so its total and its shares come from one evaluation
    mixes = logs.groupBy("vec_id").agg(F.first("x").alias("x"), F.collect_list(F.struct("mix", "lp")).alias("m"))
    shares = mixes.select("x", F.explode(A.posteriors(F.col("m"))).alias("r"))
    post = shares.select("r.mix", "r.p", F.posexplode("x").alias("dim", "v"))
    g = post.groupBy("mix", "dim").agg(F.sum("p").alias("o"), F.sum(F.col("p") * F.col("v")).alias("a"), F.sum(F.col("p") * F.col("v") * F.col("v")).alias("b"))
    mean = F.col("a") / F.col("o")
    return g.select("mix", "dim", F.round("o", 5).alias("occupancy"), (F.round(mean, 5) + 0.0).alias("mean"), F.round(F.greatest(F.col("b") / F.col("o") - mean * mean, F.lit(0.01)), 5).alias("var"))


@query(f"WITH h AS (SELECT label AS cls, count(*) AS n FROM embeddings GROUP BY label), t AS (SELECT sum(n) AS total FROM h) SELECT CAST(k AS INTEGER) AS cls, round(CASE WHEN n > 0 THEN ln(n / total) ELSE ln(1 / (10.0::DOUBLE * total)) END, 6) AS log_prior FROM (SELECT unnest(range(0, {CLASSES})) AS k) LEFT JOIN h ON h.cls = k, t")
def class_prior(spark: SparkSession, sf: str) -> DataFrame:
    """Two of the classes have no frames."""
    counts = table(spark, sf, "embeddings").groupBy(F.col("label").alias("cls")).agg(F.count("*").alias("n"))
    return A.class_priors(counts, CLASSES).withColumn("log_prior", F.round("log_prior", 6))


# ---------------------------------------------------------------- hidden Markov models
_HMM = K.Hmm("a", np.array([[[20.0]], [[60.0]], [[120.0]]]), np.full((3, 1, 1), 900.0), np.zeros((3, 1)))
_EMIT = ", ".join(f"-0.5 * (ln(2 * pi()) + ln(900.0) + power(v - {m}, 2) / 900.0) AS e{s}" for s, m in ((1, 20.0), (2, 60.0), (3, 120.0)))
_LSE = lambda a, b: f"greatest({a}, {b}) + ln(1 + exp(least({a}, {b}) - greatest({a}, {b})))"


@query(
    f"""WITH RECURSIVE {_U}, v AS (SELECT user_id, t, len(x) AS n, x[t] AS v FROM (SELECT *, unnest(range(1, len(x) + 1)) AS t FROM u)), e AS (SELECT user_id, t, n, {_EMIT} FROM v),
a AS (SELECT user_id, t, n, e1 AS a1, -1e30::DOUBLE AS a2, -1e30::DOUBLE AS a3 FROM e WHERE t = 1
 UNION ALL SELECT e.user_id, e.t, e.n, a.a1 + ln(0.5) + e.e1, {_LSE('a.a1 + ln(0.5)', 'a.a2 + ln(0.5)')} + e.e2, {_LSE('a.a2 + ln(0.5)', 'a.a3 + ln(0.5)')} + e.e3 FROM a JOIN e ON e.user_id = a.user_id AND e.t = a.t + 1)
SELECT user_id, round(greatest(a1, a2, a3) + ln(exp(a1 - greatest(a1, a2, a3)) + exp(a2 - greatest(a1, a2, a3)) + exp(a3 - greatest(a1, a2, a3))), 5) AS total,
 CASE WHEN a3 > -1e29 THEN round(a3 + ln(0.5), 5) ELSE -1e30 END AS total_with_exit FROM a WHERE t = n"""
)
def forward_backward(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's values under one model of three states."""
    rows = by_user(spark, sf).select("user_id", F.lit("a").alias("name"), F.transform("x", lambda v: F.array(v)).alias("features"))
    got = A.hmm_recursions(rows, {"a": _HMM}, "user_id")
    return got.select("user_id", F.round("total", 5).alias("total"), F.when(F.col("total_with_exit") > -1e29, F.round("total_with_exit", 5)).otherwise(F.lit(-1e30)).alias("total_with_exit"))


def _as_frames(spark: SparkSession, sf: str, dim: int) -> DataFrame:
    """(vec_id, label, features): a vector as frames of ``dim`` values."""
    return embeddings(spark, sf).select("vec_id", "label", F.transform(F.sequence(F.lit(0), F.floor(F.size("x") / dim).cast("int") - 1), lambda i: F.slice("x", i * dim + 1, dim)).alias("features"))


def _two_models(dim: int) -> A.Model:
    return {p: K.new_hmm(p, dim, 2, 3) for p in ("a", "k", "i", "sil")}


@query()
def em_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of one iteration over all vectors, as sequences of 16 frames."""
    rows = _as_frames(spark, sf, 4).select(F.when(F.col("label") < 5, "a").otherwise("i").alias("name"), "features")
    got = A.em_statistics(rows, _two_models(4))
    return got.select("name", "state", "mix", "n", F.round("ll", 3).alias("ll"), F.round("occupancy", 4).alias("occupancy"), F.transform("first", lambda v: F.round(v, 4)).alias("first"))


_ALIGNED = ("sil", "a", "k", "sil")


def _means() -> str:
    """(pos, phoneme, state, mix, dim, mean) of the models of _ALIGNED: states and dimensions from 1."""
    model = _two_models(4)
    rows = [f"({p * 3 + s + 1}, {m}, {d + 1}, {float(model[name].mean[s, m, d])!r}::DOUBLE)" for p, name in enumerate(_ALIGNED) for s in range(3) for m in range(2) for d in range(4)]
    return "(VALUES " + ", ".join(rows) + ") AS q(s, mix, dim, mean)"


_ALIGN_SQL = f"""WITH RECURSIVE {_X}, o AS (SELECT vec_id, t, dim, x[(t - 1) * 4 + dim] AS v FROM e, (SELECT unnest(range(1, 17)) AS t), (SELECT unnest(range(1, 5)) AS dim)),
g AS (SELECT vec_id, t, s, mix, -0.5 * (4 * ln(2 * pi()) + sum((v - mean) * (v - mean))) + ln(0.5) AS lp FROM o JOIN {_means()} USING (dim) GROUP BY vec_id, t, s, mix),
b AS (SELECT vec_id, t, s, max(lp) + ln(sum(exp(lp - top))) AS lp FROM (SELECT *, max(lp) OVER (PARTITION BY vec_id, t, s) AS top FROM g) GROUP BY vec_id, t, s),
m AS (SELECT vec_id, t, list(lp ORDER BY s) AS em FROM b GROUP BY vec_id, t),
r AS (SELECT vec_id, t, list_transform(range(1, 13), lambda s: CASE WHEN s = 1 THEN em[1] ELSE -1e30::DOUBLE END) AS score, list_transform(range(1, 13), lambda s: [s]) AS path FROM m WHERE t = 1
 UNION ALL SELECT m.vec_id, m.t,
  list_transform(range(1, 13), lambda s: CASE WHEN greatest(r.score[s], CASE WHEN s > 1 THEN r.score[s - 1] ELSE -1e30 END) + ln(0.5) > -1e30 + 1 THEN greatest(r.score[s], CASE WHEN s > 1 THEN r.score[s - 1] ELSE -1e30 END) + ln(0.5) + m.em[s] ELSE -1e30 END),
  list_transform(range(1, 13), lambda s: CASE WHEN s > 1 AND r.score[s - 1] + ln(0.5) > greatest(r.score[s] + ln(0.5), -1e30) THEN list_append(r.path[s - 1], s) ELSE list_append(r.path[s], s) END)
  FROM r JOIN m ON m.vec_id = r.vec_id AND m.t = r.t + 1),
z AS (SELECT vec_id, path[CASE WHEN score[10] >= score[11] AND score[10] >= score[12] THEN 10 WHEN score[11] >= score[12] THEN 11 ELSE 12 END] AS path FROM r WHERE t = 16)"""


@query(f"{_ALIGN_SQL} SELECT vec_id, CAST(pos AS INTEGER) AS pos, ['sil', 'a', 'k', 'sil'][pos + 1] AS phoneme, CAST(min(t) - 1 AS INTEGER) AS \"start\", CAST(max(t) AS INTEGER) AS \"end\" FROM (SELECT vec_id, t, (path[t] - 1) // 3 AS pos FROM z, (SELECT unnest(range(1, 17)) AS t)) GROUP BY vec_id, pos")
def viterbi_align(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as 16 frames, aligned with four phonemes."""
    rows = _as_frames(spark, sf, 4).withColumn("phonemes", F.array(*[F.lit(p) for p in _ALIGNED]))
    got = A.forced_alignment(rows, _two_models(4), "vec_id")
    return got.select("vec_id", F.explode("segments").alias("s")).select("vec_id", "s.pos", "s.phoneme", "s.start", "s.end")


@query(f"{_ALIGN_SQL} SELECT vec_id, CAST(t - 1 AS INTEGER) AS frame, CAST(path[t] - 1 AS INTEGER) AS state FROM z, (SELECT unnest(range(1, 17)) AS t)")
def viterbi_states(spark: SparkSession, sf: str) -> DataFrame:
    """The best path's state at every frame."""
    rows = _as_frames(spark, sf, 4).withColumn("phonemes", F.array(*[F.lit(p) for p in _ALIGNED]))
    return A.forced_alignment(rows, _two_models(4), "vec_id").select("vec_id", F.posexplode("states").alias("frame", "state"))


@query("SELECT vec_id, CASE WHEN vec_id % 9 = 8 THEN 'unknown phoneme zz' WHEN vec_id % 9 = 0 THEN 'empty phoneme sequence' WHEN vec_id % 9 > 4 THEN 'too few frames (4) for ' || vec_id % 9 || ' phonemes' WHEN vec_id % 9 > 2 THEN 'no valid path' END AS error FROM embeddings")
def alignment_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Four frames for none to seven phonemes, and an unknown one."""
    n = F.pmod("vec_id", F.lit(9)).cast("int")
    phonemes = F.when(n == 8, F.array(F.lit("a"), F.lit("zz"))).when(n == 0, F.array().cast("array<string>")).otherwise(F.array_repeat(F.lit("a"), n))
    rows = _as_frames(spark, sf, 16).withColumn("phonemes", phonemes)
    return A.forced_alignment(rows, {"a": K.new_hmm("a", 16, 1, 3)}, "vec_id").select("vec_id", "error")


@query(f"WITH {_X}, s AS (SELECT vec_id, x, n, 2 + (vec_id + n) % 4 AS len, 3 * n AS a FROM e, (SELECT unnest(range(0, 4)) AS n)) SELECT vec_id, 'p' || n AS name, CAST(len AS INTEGER) AS n_frames, round(list_sum(x[a * 4 + 1:(a + len) * 4]), 6) + 0.0 AS total FROM s WHERE len >= 3")
def frames_of_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The frames of each segment that is long enough."""
    seg = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda n: F.struct(F.concat(F.lit("p"), n.cast("string")).alias("phoneme"), (n * 3).alias("start"), (n * 3 + 2 + F.pmod(F.col("vec_id") + n, F.lit(4)).cast("int")).alias("end")))
    rows = _as_frames(spark, sf, 4).withColumn("segments", seg)
    tagged = rows.withColumn("features", F.transform("features", lambda f: F.concat(f, F.array(F.col("vec_id").cast("double")))))
    got = A.cut_segments(tagged)
    total = F.aggregate("features", F.lit(0.0), lambda s, f: s + F.get(f, F.lit(0)) + F.get(f, F.lit(1)) + F.get(f, F.lit(2)) + F.get(f, F.lit(3)))
    return got.select(F.get(F.get("features", F.lit(0)), F.lit(4)).cast("long").alias("vec_id"), "name", F.size("features").alias("n_frames"), (F.round(total, 6) + 0.0).alias("total"))


@query(f"WITH {_X}, {_LONG}, {_STATS}, {_LOGS} SELECT vec_id, cls, round(lp, 4) AS lp FROM c")
def batched_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    """All classes' Gaussians as matrix products over batches."""
    e = embeddings(spark, sf)
    stats = A.gaussian_statistics(e, "label", "x").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("dim", "mean", "var"))).alias("s"))
    states = stats.select(F.col("label").cast("string").alias("name"), F.lit(1).alias("state"), F.lit(0).alias("mix"), F.transform("s", lambda r: r["mean"]).alias("mean"), F.transform("s", lambda r: r["var"]).alias("var"), F.lit(0.0).alias("log_weight"))
    rows = A.mixture_scores(e, states, "x").select("vec_id", F.explode("scores").alias("k", "lp"))
    return rows.select("vec_id", F.substring_index("k", "/", 1).cast("int").alias("cls"), F.round("lp", 4).alias("lp"))


@query("SELECT * FROM (VALUES ('a-k+i', 'a-k+i'), ('i-k+a', 'k'), ('k', 'k'), ('#-a+#', 'a'), ('a-zz+i', 'none'), ('zz', 'none')) AS t(name, found)")
def resolved_models(spark: SparkSession, sf: str) -> DataFrame:
    """A triphone's model, else its centre's."""
    model = A.new_model(["a", "k"], 2, 1) | {"a-k+i": K.new_hmm("a-k+i", 2, 1)}
    names = ["a-k+i", "i-k+a", "k", "#-a+#", "a-zz+i", "zz"]
    return spark.createDataFrame([(n, "none" if (h := A.resolved(model, n)) is None else h.phoneme) for n in names], "name string, found string")


@query("SELECT CAST(i AS INTEGER) AS i, CAST(s AS INTEGER) AS state, CAST(CASE WHEN i < 29 THEN i * 3 + s - 1 ELSE -1 END AS INTEGER) AS cls FROM (SELECT unnest(range(0, 30)) AS i), (SELECT unnest([1, 2, 3]) AS s)")
def state_classes(spark: SparkSession, sf: str) -> DataFrame:
    """The class of every phoneme's states, and of an unknown one."""
    from phonoflow.functions import phonemes as P

    rows = spark.createDataFrame([(i, p) for i, p in enumerate([*P.PHONEMES, "zz"])], "i int, phoneme string")
    return rows.select("i", "phoneme", F.explode(F.array(*[F.lit(s) for s in (1, 2, 3)])).alias("state")).select("i", "state", P.state_class(F.col("phoneme"), F.col("state")).alias("cls"))


@query("SELECT CAST(i AS INTEGER) AS from_state, CAST(j AS INTEGER) AS to_state, CASE WHEN i = 0 AND j = 1 THEN 0.0 WHEN i BETWEEN 1 AND 3 AND j IN (i, i + 1) THEN round(ln(0.5), 9) ELSE -1e30 END AS log_prob FROM (SELECT unnest(range(0, 5)) AS i), (SELECT unnest(range(0, 5)) AS j)")
def model_transitions(spark: SparkSession, sf: str) -> DataFrame:
    """M5: in by the first state; stay or go on with one half."""
    t = K.default_transitions()
    return spark.createDataFrame([(i, j, float(t[i, j]) if t[i, j] < -1e29 else round(float(t[i, j]), 9)) for i in range(5) for j in range(5)], "from_state int, to_state int, log_prob double")


# ---------------------------------------------------------------- networks
def formula_network() -> N.Network:
    """64 - 8 - 4 with weights by a formula, so that SQL has them too."""
    w1 = np.sin(0.1 * (np.arange(8)[:, None] * 64 + np.arange(1, 65)))
    w2 = np.cos(0.3 * (np.arange(4)[:, None] * 8 + np.arange(1, 9)))
    return N.Network([w1, w2], [0.01 * np.arange(8), 0.02 * np.arange(4)], 0, log_prior=-np.arange(1.0, 5.0), phonemes=[])


@query(
    f"""WITH {_X}, h AS (SELECT vec_id, j, greatest(list_sum(list_transform(range(1, 65), lambda i: x[i] * sin(0.1 * (j * 64 + i)))) + 0.01 * j, 0) AS a FROM e, (SELECT unnest(range(0, 8)) AS j)),
z AS (SELECT vec_id, k, sum(a * cos(0.3 * (k * 8 + j + 1))) + 0.02 * k AS z FROM h, (SELECT unnest(range(0, 4)) AS k) GROUP BY vec_id, k),
t AS (SELECT *, max(z) OVER (PARTITION BY vec_id) AS top FROM z)
SELECT vec_id, CAST(k AS INTEGER) AS k, round(z - top - ln(sum(exp(z - top)) OVER (PARTITION BY vec_id)) + k + 1, 5) + 0.0 AS v FROM t"""
)
def dnn_forward(spark: SparkSession, sf: str) -> DataFrame:
    """N2, N3."""
    net = formula_network()
    prior = F.array(*[F.lit(float(p)) for p in net.log_prior])
    rows = NN.log_posteriors(embeddings(spark, sf), net, "x")
    return rows.select("vec_id", F.posexplode(F.zip_with("log_post", prior, lambda a, b: a - b)).alias("k", "v")).withColumn("v", F.round("v", 5) + 0.0)


_NET = f"""{_X}, h AS (SELECT vec_id, label, j, greatest(list_sum(list_transform(range(1, 65), lambda i: x[i] * sin(0.1 * (j * 64 + i)))) + 0.01 * j, 0) AS a FROM e, (SELECT unnest(range(0, 8)) AS j)),
z AS (SELECT vec_id, label % 4 AS y, k, sum(a * cos(0.3 * (k * 8 + j + 1))) + 0.02 * k AS z FROM h, (SELECT unnest(range(0, 4)) AS k) GROUP BY vec_id, label, k),
t AS (SELECT *, max(z) OVER (PARTITION BY vec_id) AS top, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, k) AS r FROM z), p AS (SELECT vec_id, y, k, r, z - top - ln(sum(exp(z - top)) OVER (PARTITION BY vec_id)) AS lp FROM t)"""


@query(f"WITH {_NET}, s AS (SELECT -sum(lp) FILTER (k = y) AS loss, count(*) FILTER (k = y AND r = 1) AS hits, count(*) FILTER (k = y) AS n FROM p) SELECT CAST(k AS INTEGER) AS k, round(sum(exp(lp) - CASE WHEN k = y THEN 1 ELSE 0 END), 4) + 0.0 AS g, round(any_value(loss), 3) AS loss, any_value(hits) AS hits, any_value(n) AS n FROM p, s GROUP BY k")
def network_gradients(spark: SparkSession, sf: str) -> DataFrame:
    """The cross-entropy's gradient by the last layer's biases, loss and hits, added over partitions."""

    def run(batches):  # noqa: ANN001, ANN202
        net, total = formula_network(), None
        for b in batches:
            g = N.gradients(net, np.stack(list(b["x"])), b["label"].to_numpy() % 4) if len(b) else None
            total = g if total is None else total if g is None else total + g
        if total is not None:
            yield pd.DataFrame({"k": np.arange(4), "g": total.g[3], "loss": total.loss, "hits": total.hits, "n": total.rows})

    got = embeddings(spark, sf).select("x", "label").mapInPandas(run, "k int, g double, loss double, hits long, n long")
    return got.groupBy("k").agg((F.round(F.sum("g"), 4) + 0.0).alias("g"), F.round(F.sum("loss"), 3).alias("loss"), F.sum("hits").cast("long").alias("hits"), F.sum("n").cast("long").alias("n"))


@query(f"WITH {_X}, b AS (SELECT CAST(i AS INTEGER) AS i, avg(x[i + 1]) AS mean, var_pop(x[i + 1]) AS var FROM e, (SELECT unnest(range(0, 64)) AS i) GROUP BY i) SELECT i, round(0.1 * mean, 9) + 0.0 AS running_mean, round(1 + 0.1 * (var - 1), 9) AS running_var FROM b")
def batch_norm_step(spark: SparkSession, sf: str) -> DataFrame:
    """Running statistics after one step over the whole table as one batch, by an identity layer."""
    moments = embeddings(spark, sf).select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"), F.count("*").alias("n")).orderBy("i").toPandas()
    n = int(moments["n"].iloc[0])
    net = N.Network([np.eye(64), np.ones((2, 64))], [np.zeros(64), np.zeros(2)], 0, bn=[[np.ones(64), np.zeros(64), np.zeros(64), np.ones(64)]], log_prior=np.zeros(2), phonemes=[])
    g = N.Gradients([np.zeros_like(p) for p in net.parameters()], 0.0, 0, n, [(moments["mean"].to_numpy() * n, moments["var"].to_numpy() * n)])
    N.update(net, N.Adam(), g, 0.001)
    return spark.createDataFrame([(i, round(float(m), 9) + 0.0, round(float(v), 9)) for i, (m, v) in enumerate(zip(net.bn[0][2], net.bn[0][3], strict=True))], "i int, running_mean double, running_var double")


@query(f"WITH {_X} SELECT vec_id, CAST(k AS INTEGER) AS k, round(z - ln(exp(a) + exp(b)), 6) + 0.0 AS v FROM (SELECT vec_id, a, b, unnest([0, 1]) AS k, unnest([a, b]) AS z FROM (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: greatest(2 * (x[i] - 0.1) / sqrt(0.5 + 1e-5) + 0.05, 0))) AS a, list_sum(list_transform(range(1, 65), lambda i: i / 64.0::DOUBLE * greatest(2 * (x[i] - 0.1) / sqrt(0.5 + 1e-5) + 0.05, 0))) AS b FROM e))")
def batch_norm_inference(spark: SparkSession, sf: str) -> DataFrame:
    """A layer with batch norm by its running statistics."""
    bn = [[np.full(64, 2.0), np.full(64, 0.05), np.full(64, 0.1), np.full(64, 0.5)]]
    net = N.Network([np.eye(64), np.stack([np.ones(64), np.arange(1, 65) / 64])], [np.zeros(64), np.zeros(2)], 0, bn=bn, log_prior=np.zeros(2), phonemes=[])
    return NN.log_posteriors(embeddings(spark, sf), net, "x").select("vec_id", F.posexplode("log_post").alias("k", "v")).withColumn("v", F.round("v", 6) + 0.0)


@query("SELECT CAST(e AS INTEGER) AS epoch, round(0.00001 + (0.001 - 0.00001) * 0.5 * (1 + cos(pi() * e / 50)), 9) AS rate FROM (SELECT unnest(range(0, 51)) AS e)")
def cosine_rate(spark: SparkSession, sf: str) -> DataFrame:
    """N4."""
    return spark.createDataFrame([(e, round(N.cosine_rate(0.001, e, 50), 9)) for e in range(51)], "epoch int, rate double")


@query(f"WITH {_X} SELECT vec_id, CAST(i AS INTEGER) AS i, round(x[i + 1] - 0.001 * x[i + 33] / (abs(x[i + 33]) + 1e-8), 9) + 0.0 AS w FROM e, (SELECT unnest(range(0, 32)) AS i)")
def adam_step(spark: SparkSession, sf: str) -> DataFrame:
    """The first step of 32 weights by 32 gradients a row; both bias corrections cancel, so g / |g| is left."""

    def step(batches):  # noqa: ANN001, ANN202
        for b in batches:
            if not len(b):
                continue
            x = np.stack(list(b["x"]))
            w = x[:, :32].copy()
            N.Adam().step([w], [x[:, 32:]], 1.0)
            yield pd.DataFrame({"vec_id": np.repeat(b["vec_id"].to_numpy(), 32), "i": np.tile(np.arange(32, dtype=np.int32), len(b)), "w": w.ravel().round(9) + 0.0})

    return embeddings(spark, sf).select("vec_id", "x").mapInPandas(step, "vec_id long, i int, w double")


# ---------------------------------------------------------------- search
def tiny_recognizer() -> decoder.Recognizer:
    """Two words of one phoneme each, over the first two dimensions of what it is given."""
    one = lambda p, m: K.Hmm(p, np.full((3, 1, 2), m), np.full((3, 1, 2), 0.5), np.zeros((3, 1)))
    lp = lambda x: x * 2.302585092994046
    lm = S.LanguageModel(2, {"</s>": (lp(-1), 0.0), "<s>": (lp(-1), 0.0), "あ": (lp(-0.5), 0.0), "い": (lp(-0.5), 0.0)}, {("<s>", "あ"): (lp(-0.3), 0.0), ("<s>", "い"): (lp(-0.3), 0.0), ("あ", "い"): (lp(-0.3), 0.0), ("い", "あ"): (lp(-0.3), 0.0)})
    return decoder.Recognizer({"a": one("a", -0.1), "i": one("i", 0.1)}, lm, {"あ": ["a"], "い": ["i"]}, search=S.SearchConfig(lm_weight=1.0, word_penalty=-2.0))


_GAUSS = lambda m: f"-0.5 * (2 * ln(2 * pi()) + 2 * ln(0.5) + (power(x[2 * t + 1] - ({m}), 2) + power(x[2 * t + 2] - ({m}), 2)) / 0.5)"
_BOUND = "-0.3 * 2.302585092994046"
_ENTER = lambda k: f"{{'node': {k}, 'st': 1, 'last': r.node, 'score': r.score + ln(0.5) - ({_BOUND}) + 2.302585092994046 * CASE WHEN r.last = r.node THEN -0.5 ELSE -0.3 END - 2.0 + {'ea' if k == 1 else 'ei'} + ({_BOUND}), 'text': concat_ws(' ', nullif(r.text, ''), w)}}"


@query(
    f"""WITH RECURSIVE {_X}, em AS (SELECT vec_id, t, {_GAUSS(-0.1)} AS ea, {_GAUSS(0.1)} AS ei FROM e, (SELECT unnest(range(0, 32)) AS t)),
r AS (SELECT vec_id, t, node, 1 AS st, 0 AS last, CASE node WHEN 1 THEN ea ELSE ei END + ({_BOUND}) AS score, '' AS text FROM em, (SELECT unnest([1, 2]) AS node) WHERE t = 0
 UNION ALL SELECT vec_id, t, k.node, k.st, k.last, max(k.score), arg_max(k.text, k.score) FROM (
  SELECT vec_id, t, unnest([
   {{'node': r.node, 'st': r.st, 'last': r.last, 'score': r.score + ln(0.5) + own, 'text': r.text}}, {{'node': r.node, 'st': r.st + 1, 'last': r.last, 'score': r.score + ln(0.5) + own, 'text': r.text}}, {_ENTER(1)}, {_ENTER(2)}]) AS k
  FROM (SELECT r.*, CASE r.node WHEN 1 THEN 'あ' ELSE 'い' END AS w, em.t AS t, ea, ei, CASE r.node WHEN 1 THEN ea ELSE ei END AS own FROM (SELECT vec_id, t AS before, node, st, last, score, text FROM r) r JOIN em ON em.vec_id = r.vec_id AND em.t = r.before + 1) r) WHERE k.st <= 3 GROUP BY vec_id, t, k.node, k.st, k.last),
z AS (SELECT vec_id, max(score) AS score, arg_max(concat_ws(' ', nullif(text, ''), CASE node WHEN 1 THEN 'あ' ELSE 'い' END), score) AS text FROM r WHERE t = 31 GROUP BY vec_id)
SELECT vec_id, text, round(score, 4) AS score, CAST(len(string_split(text, ' ')) AS INTEGER) AS n_words FROM z"""
)
def beam_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as 32 frames of two values, decoded; the beam is wide enough for an exact search."""
    got = decoder.decoded(_as_frames(spark, sf, 2), tiny_recognizer())
    return got.select("vec_id", "result.text", F.round("result.score", 4).alias("score"), F.size("result.words").alias("n_words"))


@query()
def parameter_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The decoder over a grid, the expected text being one word by the label."""
    cases = _as_frames(spark, sf, 2).select("features", F.when(F.col("label") < 5, "あ").otherwise("い").alias("expected"))
    return decoder.tuned(cases, decoder.grid(spark, [1.0, 2.0], [-20.0, -2.0], [100], [0, 2]), tiny_recognizer())
