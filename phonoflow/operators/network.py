"""Networks over DataFrames: inference in Arrow batches, training by gradients of partitions, weights as tables.

N2-N4, A11, A17-A19, D23, K3, S18. Data of any size is trained on where it lies: in a step each partition adds up the
gradients of its own batches, a tree aggregation of one row per partition adds the partitions, the driver takes one Adam
step. A step is a mini-batch as on one machine. What moves per step has the size of the weights. :func:`phonoflow.functions.network.fit` is the loop on one machine.
"""

from __future__ import annotations

import math
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoflow.functions import network as N
from phonoflow.functions import signal as D
from phonoflow.operators.features import matrix, to_lists
from phonoflow.session import cut_lineage, ensure_checkpoint_dir


def network_likelihoods(utterances: DataFrame, net: N.Network, features: str = "features") -> DataFrame:
    """``utterances`` with class_scores, frames x classes."""
    shared = utterances.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("array<array<double>>")
    def run(x: pa.Array) -> pa.Array:
        return to_lists([N.likelihoods(shared.value, matrix(v)) if v.is_valid and len(v.values) else None for v in x])

    return utterances.withColumn("class_scores", run(F.col(features)))


def log_posteriors(rows: DataFrame, net: N.Network, x: str = "x") -> DataFrame:
    """N2 of rows that are windows already: ``rows`` with log_post."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    @F.arrow_udf("array<double>")
    def run(v: pa.Array) -> pa.Array:
        if not len(v):
            return pa.array([], pa.list_(pa.float64()))
        out = N.forward(shared.value, np.asarray(v.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(v), -1))
        return pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * out.shape[1], pa.array(out.ravel()))

    return rows.withColumn("log_post", run(F.col(x)))


def training_rows(aligned: DataFrame, context: int, classes: list[str] | None = None) -> DataFrame:
    """(x, target): a row per frame of (features, phonemes, states); an unknown phoneme falls back to class 0."""
    from phonoflow.functions import phonemes as P

    every = P.PHONEMES if classes is None else classes
    spread = aligned.select("phonemes", "states", F.posexplode(D.context_stack(F.col("features"), context)).alias("t", "x"))
    at = F.get("states", F.col("t"))
    cls = P.state_class(F.get("phonemes", F.floor(at / 3).cast("int")), at % 3 + 1, every)
    return spread.select("x", F.greatest(cls, F.lit(0)).alias("target"))


def train(rows: DataFrame, net: N.Network, epochs: int = 20, rate: float = 0.001, batch: int = 256, workers: int = 8, steps: int | None = None, held_out: float = 0.1, patience: int = 3, smooth: float = 0.0, schedule: str = "", seed: int = 0) -> list[tuple[float, float, float, float]]:
    """N4 over (x, target) rows: Adam steps on mini-batches; ``net`` changes in place.

    A step takes ``workers`` batches of ``batch`` rows, so an epoch has as many steps as the rows fill, unless ``steps`` is
    given. Rows are dealt once by a seeded hash of their content into held-out rows and a share a step, and written to the
    shared folder by shares, so that a step reads its own files only. Epochs take the shares in an order of their own.
    """
    spark = rows.sparkSession
    dealt = cut_lineage(rows.select(F.col("x").cast("array<double>").alias("x"), F.col("target").cast("int").alias("target")).withColumn("_u", F.pmod(F.xxhash64("x", "target", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)))
    steps = steps or max(1, math.ceil(dealt.where(F.col("_u") >= held_out).count() / (batch * workers)))
    share = F.when(F.col("_u") < held_out, F.lit(-1)).otherwise(F.floor((F.col("_u") - held_out) / (1 - held_out) * steps).cast("int"))
    folder = f"{ensure_checkpoint_dir(spark)}/shares-{uuid.uuid4().hex}"
    dealt.withColumn("share", share).drop("_u").repartition("share").write.partitionBy("share").parquet(folder)
    table = spark.read.schema("x array<double>, target int, share int").parquet(folder)
    adam, best, bad, log = N.Adam(rate), math.inf, 0, []

    def partial(part: DataFrame, f) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for s in range(0, b.num_rows, batch):
                    c = b.slice(s, batch)
                    x = np.asarray(c.column(0).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(c.num_rows, -1)
                    got = f(x, c.column(1).to_numpy())
                    total = got if total is None else total + got
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["p"])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for x in b.column(0).to_pylist():
                    total = pickle.loads(x) if total is None else total + pickle.loads(x)  # noqa: S301
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["p"])

        df = part.select("x", "target").mapInArrow(run, "p binary")
        merged = df.repartition(max(1, min(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))).mapInArrow(merge, "p binary")
        return [pickle.loads(r[0]) for r in merged.collect()]  # noqa: S301

    for epoch in range(epochs):
        lr = N.cosine_rate(rate, epoch, epochs) if schedule == "cosine" else rate
        loss, hits, n = 0.0, 0, 0
        for step in np.random.default_rng([seed, epoch]).permutation(steps).tolist():
            shared = spark.sparkContext.broadcast(net)
            seeds = seed + 1000 * epoch + step
            got = partial(table.where(F.col("share") == step), lambda x, y, s=shared, k=seeds: N.gradients(s.value, x, y, smooth, np.random.default_rng(k)))
            if got:
                total = got[0]
                for g in got[1:]:
                    total = total + g
                N.update(net, adam, total, lr)
                loss, hits, n = loss + total.loss, hits + total.hits, n + total.rows
            shared.unpersist()
        shared = spark.sparkContext.broadcast(net)
        held = partial(table.where("share = -1"), lambda x, y, s=shared: np.array([-N.forward(s.value, x)[np.arange(len(y)), y].sum(), (N.forward(s.value, x).argmax(1) == y).sum(), len(y)]))
        sums = sum(held, np.zeros(3)) if held else np.array([0.0, 0.0, 1.0])
        log.append((loss / max(1, n), hits / max(1, n), float(sums[0] / sums[2]), float(sums[1] / sums[2])))
        if patience > 0:
            best, bad = (log[-1][2], 0) if log[-1][2] < best - 1e-4 else (best, bad + 1)
            if bad >= patience:
                break
    return log


WEIGHTS = "kind string, layer int, shape array<int>, value array<double>"


def save_network(spark: SparkSession, net: N.Network, path: str) -> None:
    """K3: a row per array; the version tells whether there is batch norm; the dropout rate isn't kept."""
    rows = [("version", 3 if net.bn else 2, [1], [float(net.context)]), ("prior", 0, list(net.log_prior.shape), net.log_prior.tolist())]
    for kind, arrays in (("w", net.w), ("b", net.b)):
        rows += [(kind, i, list(a.shape), a.ravel().tolist()) for i, a in enumerate(arrays)]
    for i, g in enumerate(net.bn or []):
        rows += [(k, i, list(a.shape), a.tolist()) for k, a in zip(("gamma", "beta", "mean", "variance"), g, strict=True)]
    spark.createDataFrame(rows, WEIGHTS).write.mode("overwrite").parquet(f"{path}/weights")
    spark.createDataFrame(list(enumerate(net.phonemes)), "i int, phoneme string").write.mode("overwrite").parquet(f"{path}/phonemes")


def load_network(spark: SparkSession, path: str) -> N.Network:
    """S18."""
    got = {(r["kind"], r["layer"]): np.array(r["value"]).reshape(r["shape"]) for r in spark.read.parquet(f"{path}/weights").collect()}
    names = [r["phoneme"] for r in spark.read.parquet(f"{path}/phonemes").orderBy("i").collect()]
    layers = lambda k: [got[k, i] for i in range(sum(a == k for a, _ in got))]
    version, context = next((i, v[0]) for (k, i), v in got.items() if k == "version")
    bn = [list(x) for x in zip(*(layers(k) for k in ("gamma", "beta", "mean", "variance")), strict=True)] if version == 3 else None
    return N.Network(layers("w"), layers("b"), int(context), 0.0, bn, got["prior", 0], names)
