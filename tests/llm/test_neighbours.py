"""Approximate neighbours against brute force over all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phonoflow.llm import neighbours as N
from phonoflow.session import table


def test_hadamard_is_orthogonal():
    h = N.hadamard(np.eye(16, dtype=np.float32))
    assert np.allclose(h @ h.T, np.eye(16), atol=1e-6)
    assert np.allclose(np.abs(h), 0.25)


def isotropic(spark, n, dim, seed=2):
    """n random vectors as a table and as unit rows."""
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    batch = pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), dim).cast(pa.list_(pa.float32()))})
    return spark.createDataFrame(batch), x / np.linalg.norm(x, axis=1, keepdims=True)


def recall(found, unit, queries, k=N.K):
    got = found.toPandas().groupby("vec_id")["neighbour_id"].agg(set).to_dict()
    hits = 0
    for at in range(0, len(queries), 100):
        q = queries[at : at + 100]
        sim = unit[q] @ unit.T
        sim[np.arange(len(q)), q] = -2
        top = np.argpartition(-sim, k, axis=1)[:, :k]
        hits += sum(len(got.get(int(i), set()) & set(t.tolist())) for i, t in zip(q, top, strict=True))
    return hits / len(queries) / k


def test_recall_on_the_given_table(spark, sf="/root/testdata/sf0.1"):
    pdf = table(spark, sf, "embeddings").toPandas().sort_values("vec_id")
    unit = np.stack(pdf["embedding"]).astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert pdf["vec_id"].tolist() == list(range(len(pdf)))
    found = N.op5_nearest_neighbours(spark, sf)
    rows = found.toPandas()
    assert rows.groupby("vec_id").size().eq(N.K).all()
    assert set(rows["vec_id"]) == set(range(0, len(pdf), 20))
    assert recall(found, unit, np.arange(0, len(pdf), 20)) >= 0.9
    assert all(abs(unit[r.vec_id] @ unit[r.neighbour_id] - r.cosine) < 1e-5 for r in rows.itertuples())


@pytest.mark.parametrize("plan", [(1, 2, 24), (2, 3, 1200)])
def test_every_candidate_of_the_probed_cells_is_ranked(spark, plan):
    """The result is exactly the k best among the rows that share a probed cell in any table."""
    df, unit = isotropic(spark, 3000, 32)
    got = N.nearest(df, ask=F.col("vec_id") % 50 == 0, plan=plan).toPandas()
    q = np.arange(0, 3000, 50)
    seen = np.zeros((len(q), 3000), bool)
    for t in range(plan[1]):
        seen |= (N.cells(unit[q], t, plan[0], plan[2])[:, :, None] == N.cells(unit, t, plan[0], 1)[None, None, :, 0]).any(1)
    sim = np.round(unit[q].astype(np.float64) @ unit.T.astype(np.float64), 6)
    for i, rows in zip(q, range(len(q)), strict=True):
        others = [j for j in np.flatnonzero(seen[rows]) if j != i]
        want = sorted(others, key=lambda j: (-sim[rows, j], j))[: N.K]
        mine = got[got["vec_id"] == i].sort_values(["cosine", "neighbour_id"], ascending=[False, True])
        assert mine["neighbour_id"].tolist() == want


def test_recall_among_half_a_million(spark):
    df, unit = isotropic(spark, 520_000, 64)
    queries = np.arange(0, 520_000, 1000)
    assert recall(N.nearest(df, ask=F.col("vec_id") % 1000 == 0), unit, queries) >= 0.9


def test_a_hot_cell_is_split(spark):
    """A third of all rows are one vector; ties go to the smallest ids."""
    n = 60_000
    x = np.random.default_rng(5).normal(size=(n, 16)).astype(np.float32)
    x[::3] = x[0]
    batch = pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 16).cast(pa.list_(pa.float32()))})
    got = N.nearest(spark.createDataFrame(batch), ask=F.col("vec_id") % 600 == 0, plan=(1, 2, 4)).toPandas()
    near = got.sort_values(["cosine", "neighbour_id"], ascending=[False, True]).groupby("vec_id")["neighbour_id"].agg(list)
    assert all(near[i] == [j for j in range(0, 34, 3) if j != i][: N.K] for i in range(0, n, 600))


def test_odd_rows(spark):
    v = [1.0, 0.0, 2.0]
    rows = [(1, v, "a"), (2, v, "a"), (3, [2.0, 0.0, 4.0], None), (4, None, "a"), (5, [0.0, 0.0, 0.0], "a"), (6, [1.0, None, 2.0], "a"), (7, [float("nan"), 1.0, 1.0], "a"), (None, v, "a"), (8, [1.0], "a"), (9, [0.0, 1.0, 0.0], "a"), (9, [0.0, 1.0, 0.0], "b"), (10, [], "a"), (11, [float("inf"), 1.0, 1.0], "a")]
    got = N.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, grp string"), k=2, plan=(1, 4, 8)).collect()
    near = {}
    for r in sorted(got, key=lambda r: (-r["cosine"], r["neighbour_id"])):
        near.setdefault(r["vec_id"], []).append(r["neighbour_id"])
    assert near == {1: [2, 3], 2: [1, 3], 3: [1, 2], 9: [1, 2]}
    assert N.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize("n", [1, 3])
def test_fewer_rows_than_k(spark, n):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(n)], "vec_id long, embedding array<double>")
    assert N.nearest(df).count() == n * (n - 1)


@pytest.mark.parametrize("n", [5, 12])
def test_all_come_in_many_dimensions(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for more in ({}, {"plan": (1, 1, 1)}):
        assert N.nearest(df, k=20, **more).count() == n * (n - 1)


@pytest.mark.parametrize(("n", "dim"), [(100, 64), (2_000, 64), (2_500, 256)])
def test_recall_follows_dimension_and_rows(spark, n, dim):
    df, unit = isotropic(spark, n, dim)
    assert recall(N.nearest(df), unit, np.arange(n)) >= 0.9
