"""5. Approximate nearest neighbours by cross-polytope hashing.

Unit vectors go through pseudo-rotations (three rounds of random signs and a fast Hadamard transform); the nearest signed
axis is a vector's hash, one of twice the dimension. A table's cell is made of one hash or of two. A vector lies in one cell
of each table; a query looks into the probed cells, those whose axes it is nearest to. All candidates met there are reranked
exactly; none is dropped.

The plan is measured, not fixed: the true neighbours of SAMPLE queries are found by one pass over all vectors; of all
(hashes, tables, probes) by which RECALL of them are met, that of the least work is taken, counting the copies of vectors
and the candidates, whose share is measured on a sample of rows. Where none meets them with less than MOST_PAIRS of all
pairs, as among few rows, queries are held against all vectors, in blocks.

Layout: cells that share a first axis lie side by side, in groups of some ten thousand vectors and more, as probes share
axes. A vector goes to one group a table; a group that the sample shows to be larger is split by a hash of the id. A query
goes once to each group that has one of its cells. Partitions are sorted so that a group's vectors come before its queries,
which stream by: memory is bounded by a group's vectors. Of equal vectors only those with the k + 1 smallest ids are looked
at, before the shuffle and again in the group, as ties go by the id. Of each group the k best are kept, and one aggregation by query
joins the groups'. Queries that meet fewer than k others are held against all vectors.

Defined results: rows with a null vec_id or vector, a null or non-finite element or zero length, or of a size other than
the most frequent (of equally frequent ones the smallest), have no neighbours and are none. Rows that repeat a vec_id count
once (the least vector). A vector isn't its own neighbour; equal vectors of other ids are. Cosines are rounded to six
places; equal ones go by the smaller id. With fewer than k others all come. An empty table gives no row. Other columns
aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoflow.session import cut_lineage, table

K = 10
#: queries whose true neighbours are looked for, the share of those to be met (0.9 and a margin for the sample), and rows for the share of candidates
SAMPLE = 200
RECALL = 0.94
SAMPLE_ROWS = 4096
MOST_PAIRS = 0.75
MAX_PROBES = 4096
_TABLES = {1: 8, 2: 16}
#: microseconds: a copy of a vector or a query that is shuffled, a candidate that is compared
_COPY_COST, _PAIR_COST = 20.0, 0.02
#: rows a split of groups is estimated from
_LAYOUT_ROWS = 200_000
_NEAR = 3e-6


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised fast Hadamard transform of the rows; their size is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        x = x.reshape(-1, n // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(-1, n)
        h *= 2
    return x / np.float32(np.sqrt(n))


def axes(x: np.ndarray, seed: int) -> np.ndarray:
    """Nearness to the signed axes after a pseudo-rotation: rows x twice the padded size."""
    size = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), size), np.float32)
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng(seed)
    for _ in range(3):
        y = hadamard(y * rng.choice(np.array([-1, 1], np.float32), size))
    return np.concatenate([y, -y], axis=1)


def axis_count(dim: int) -> int:
    """The signed axes of a dimension padded to a power of two."""
    return 2 << max(0, dim - 1).bit_length()


def cells(x: np.ndarray, t: int, hashes: int, probes: int) -> np.ndarray:
    """rows x probes: the cells of table ``t`` by nearness; the first is the vector's own."""
    first = axes(x, 1000 + 2 * t)
    n = first.shape[1]
    if hashes == 1:
        return first.argmax(1)[:, None] if probes == 1 else np.argsort(-first, axis=1, kind="stable")[:, : min(probes, n)]
    second = axes(x, 1001 + 2 * t)
    if probes == 1:
        return (first.argmax(1) * n + second.argmax(1))[:, None]
    # a pair among the nearest `probes` uses an axis of rank r only with axes of rank under probes / r
    width = min(n, probes)
    a, b = (np.argsort(-z, axis=1, kind="stable")[:, :width] for z in (first, second))
    va, vb = np.take_along_axis(first, a, 1), np.take_along_axis(second, b, 1)
    i, j = (z.ravel() for z in np.meshgrid(np.arange(width), np.arange(width), indexing="ij"))
    use = (i + 1) * (j + 1) <= probes
    i, j = i[use], j[use]
    loss = (va[:, :1] - va[:, i]) ** 2 + (vb[:, :1] - vb[:, j]) ** 2
    best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
    return np.take_along_axis(a[:, i], best, 1) * n + np.take_along_axis(b[:, j], best, 1)


def _unit(vectors: pa.Array, dim: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
    return x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32)


def _first_of_equals(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that have at most k rows of the same vector with smaller ids. No query's k best have any other, as ties go by the id."""
    _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 4)))[:, 0], return_inverse=True)
    order = np.lexsort((ids, same))
    head = np.flatnonzero(np.r_[True, np.diff(same[order]) != 0])
    rank = np.arange(len(ids)) - np.repeat(head, np.diff(np.r_[head, len(ids)]))
    return np.sort(order[rank <= k])


# ---------------------------------------------------------------- layout
class Layout:
    """Which group a cell belongs to: (table, block of cells, part). ``hashes`` 0 is one cell for all, dealt into parts alone."""

    def __init__(self, rows: int, dim: int, hashes: int, tables: int, probes: int) -> None:
        self.dim, self.hashes, self.tables, self.probes = dim, hashes, tables, probes
        self.axes = axis_count(dim)
        # more rows a group with more rows in all, so that copies of queries grow slower than groups would
        self.target = int(min(250_000, 8_192 * max(1.0, (rows / 50_000) ** 0.5)))
        groups = max(1, -(-rows // self.target))
        self.per_axis = min(self.axes, -(-groups // self.axes)) if hashes == 2 else 1
        self.axis_groups = min(groups, self.axes)
        self.parts = np.full((max(1, tables), self.blocks), groups if not hashes else 1, np.int64)

    @property
    def blocks(self) -> int:
        return self.axis_groups * self.per_axis if self.hashes else 1

    def block(self, cell: np.ndarray) -> np.ndarray:
        if not self.hashes:
            return np.zeros_like(cell)
        a, b = (cell, 0) if self.hashes == 1 else np.divmod(cell, self.axes)
        return a * self.axis_groups // self.axes * self.per_axis + b * self.per_axis // self.axes

    def own(self, x: np.ndarray, t: int) -> np.ndarray:
        return cells(x, t, self.hashes, 1)[:, 0] if self.hashes else np.zeros(len(x), np.int64)

    def probed(self, x: np.ndarray, t: int) -> np.ndarray:
        return cells(x, t, self.hashes, self.probes) if self.hashes else np.zeros((len(x), 1), np.int64)

    def split(self, counts: list[tuple[int, int, int]], share: float) -> None:
        """Parts for blocks that hold more than the target, by (table, block, rows of a sample that is a ``share`` of all)."""
        for t, block, n in counts:
            self.parts[t, block] = max(1, int(np.ceil(n / share / (2 * self.target))))


_SCHEMA = "grp long, kind int, id long, cells array<long>, vec array<float>"


def _rows(grp: np.ndarray, kind: int, ids: np.ndarray, count: np.ndarray, cell: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(np.r_[0, np.cumsum(count)].astype(np.int32), pa.array(cell.astype(np.int64)))
    vec = pa.ListArray.from_arrays(np.arange(len(ids) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(grp.astype(np.int64)), pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids), lists, vec], ["grp", "kind", "id", "cells", "vec"])


def _deal(layout: Layout, k: int):
    """Rows (vec_id, vector, ask) to a row of kind 0 for each table, but for equal vectors that can't be among the k best, and, where they ask, of kind 1 for each probed group."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                ids, ask = b.column(0).to_numpy(), np.flatnonzero(b.column(2).to_numpy(zero_copy_only=False))
                x = _unit(b.column(1), layout.dim)
                use = _first_of_equals(ids, x, k)
                salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                for t in range(max(1, layout.tables)):
                    own = layout.own(x[use], t)
                    block = layout.block(own)
                    yield _rows((t << 48) | (block << 20) | salt[use] % layout.parts[t][block], 0, ids[use], np.ones(len(use), np.int64), own, x[use])
                    if not len(ask):
                        continue
                    c = layout.probed(x[ask], t)
                    who = np.repeat(np.arange(len(ask)), c.shape[1])
                    key = who * layout.blocks + layout.block(c).ravel()
                    order = np.argsort(key, kind="stable")
                    pair, first = np.unique(key[order], return_index=True)
                    count = np.diff(np.r_[first, len(key)])
                    q, g = np.divmod(pair, layout.blocks)
                    flat = c.ravel()[order]
                    parts = layout.parts[t][g]
                    for part in range(int(parts.max())):
                        to = parts > part
                        yield _rows((t << 48) | (g[to] << 20) | part, 1, ids[ask][q[to]], count[to], flat[np.repeat(to, count)], x[ask][q[to]])

    return deal


def _blocks(layout: Layout):
    """Vectors to (table, block, rows): how many of a task's vectors lie where."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((layout.tables, layout.blocks), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                x = _unit(batch.column(0).slice(at, 1024), layout.dim)
                for t in range(layout.tables):
                    seen[t] += np.bincount(layout.block(layout.own(x, t)), minlength=layout.blocks)
        t, b = np.nonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(b), pa.array(seen[t, b])], ["t", "block", "n"])

    return count


# ---------------------------------------------------------------- search
class Group:
    """The vectors of one group by cell, for exact search among those of given cells."""

    def __init__(self, ids: np.ndarray, cell: np.ndarray, x: np.ndarray, k: int) -> None:
        use = _first_of_equals(ids, x, k)
        ids, cell, x = ids[use], cell[use], x[use]
        order = np.argsort(cell, kind="stable")
        self.ids, self.x, self.k = ids[order], x[order], k
        self.cells, self.first = np.unique(cell[order], return_index=True)
        self.last = np.r_[self.first[1:], len(ids)]

    def best(self, ids: np.ndarray, x: np.ndarray, count: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, neighbour, cosine) of the k best of each query; query i looks into the next ``count[i]`` of ``cell``."""
        k = self.k
        order = np.argsort(cell, kind="stable")
        asks, cell = np.repeat(np.arange(len(ids)), count)[order], cell[order]
        limit = np.full(len(ids), -np.inf, np.float32)
        q, n, cos = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for c, s, e in zip(self.cells, self.first, self.last, strict=True):
            lo, hi = np.searchsorted(cell, [c, c + 1])
            step = max(1, (1 << 21) // (e - s))
            for at in range(lo, hi, step):
                who = asks[at : min(hi, at + step)]
                sim = x[who] @ self.x[s:e].T
                sim[ids[who][:, None] == self.ids[s:e][None, :]] = -np.inf
                fresh = np.flatnonzero(limit[who] == -np.inf)
                if e - s > k and len(fresh):
                    limit[who[fresh]] = np.partition(sim[fresh], e - s - k, axis=1)[:, e - s - k]
                i, j = np.nonzero(sim >= np.maximum(limit[who] - np.float32(_NEAR), np.float32(-2))[:, None])
                if not len(i):
                    continue
                i, j = who[i], s + j
                exact = np.empty(len(i))
                for a in range(0, len(i), 1 << 16):  # alike in whatever group the pair meets
                    exact[a : a + (1 << 16)] = np.einsum("ij,ij->i", x[i[a : a + (1 << 16)]].astype(np.float64), self.x[j[a : a + (1 << 16)]].astype(np.float64))
                q, n, cos = np.r_[q, i], np.r_[n, self.ids[j]], np.r_[cos, np.round(exact, 6)]
                order = np.lexsort((n, -cos, q))
                q, n, cos = q[order], n[order], cos[order]
                head = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
                rank = np.arange(len(q)) - np.repeat(head, np.diff(np.r_[head, len(q)]))
                full = np.flatnonzero(rank == k - 1)
                limit[q[full]] = np.maximum(limit[q[full]], cos[full].astype(np.float32))
                q, n, cos = q[rank < k], n[rank < k], cos[rank < k]
        return q, n, cos


def _search(dim: int, k: int):
    """Rows sorted by (grp, kind) to (vec_id, neighbour_id, cosine): the k best of each query in each group."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, group = None, [], None
        for batch in batches:
            grp, kind, ids = (batch.column(i).to_numpy() for i in range(3))
            cut = np.flatnonzero(np.r_[True, (grp[1:] != grp[:-1]) | (kind[1:] != kind[:-1])]) if len(grp) else []
            for s, e in zip(cut, [*cut[1:], len(grp)], strict=True):
                if grp[s] != now:
                    now, parts, group = grp[s], [], None
                rows = batch.slice(s, e - s)
                x = rows.column(4).flatten().to_numpy().reshape(-1, dim)
                cell = rows.column(3).flatten().to_numpy()
                if kind[s] == 0:
                    parts.append((ids[s:e], cell, x))
                    continue
                if group is None:
                    if not parts:
                        continue
                    group, parts = Group(*(np.concatenate(p) for p in zip(*parts, strict=True)), k), parts[:1]
                count = np.diff(rows.column(3).offsets.to_numpy())
                q, n, cos = group.best(ids[s:e], x, count, cell)
                yield pa.RecordBatch.from_arrays([pa.array(ids[s:e][q]), pa.array(n), pa.array(cos)], ["vec_id", "neighbour_id", "cosine"])

    return search


# ---------------------------------------------------------------- the measured plan
def _best_of_sample(queries: np.ndarray, names: np.ndarray, k: int):
    """Rows (vec_id, vector) to the k nearest of each query among a task's: (query, cosine less than 0, vec_id, unit vector)."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sims, ids, near = np.full((len(queries), k), -np.inf, np.float32), np.full((len(queries), k), -1, np.int64), np.zeros((len(queries), k, queries.shape[1]), np.float32)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                b = batch.slice(at, 1024)
                who, x = b.column(0).to_numpy(), _unit(b.column(1), queries.shape[1])
                sim = queries @ x.T
                sim[names[:, None] == who[None, :]] = -np.inf
                top = np.argpartition(-sim, k - 1, axis=1)[:, :k] if len(x) > k else np.broadcast_to(np.arange(len(x)), sim.shape)
                both, who2 = np.concatenate([sims, np.take_along_axis(sim, top, 1)], 1), np.concatenate([ids, who[top]], 1)
                pick = np.argsort(-both, axis=1)[:, :k]
                near = np.take_along_axis(np.concatenate([near, x[top]], 1), pick[:, :, None], 1)
                sims, ids = np.take_along_axis(both, pick, 1), np.take_along_axis(who2, pick, 1)
        q, c = np.nonzero(np.isfinite(sims))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(-sims[q, c]), pa.array(ids[q, c]), pa.array(list(near[q, c]), pa.list_(pa.float32()))], ["q", "c", "n", "vec"])

    return best


def _best_of_all(k: int):
    """Rows (q, c, n, vec) of whole queries to the k best of each; they stream by."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for q, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = held.setdefault(q, [])
                mine.append(tuple(row))
                if len(mine) > 4 * k:
                    held[q] = sorted(mine)[:k]
        rows = [(q, *r) for q, mine in held.items() for r in sorted(mine)[:k]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.float32(), pa.int64(), pa.list_(pa.float32())), strict=True)], ["q", "c", "n", "vec"])

    return best


def _ranks(probes: np.ndarray, asks: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The place of the cell ``own[i]`` among the probes of query ``asks[i]``; a huge one where it isn't among them."""
    out = np.full(len(own), 1 << 30, np.int64)
    for q in np.unique(asks):
        at = np.flatnonzero(asks == q)
        order = np.argsort(probes[q])
        place = order[np.minimum(np.searchsorted(probes[q], own[at], sorter=order), len(order) - 1)]
        hit = probes[q][place] == own[at]
        out[at[hit]] = place[hit]
    return out


def measured_plan(one: DataFrame, rows: int, asking: int, dim: int, k: int) -> tuple[int, int, int] | None:
    """(hashes, tables, probes) by which RECALL of the true neighbours of a sample are met at the least work; None where that takes MOST_PAIRS of all pairs."""
    sample = one.where("ask").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "embedding").collect()
    if not sample or rows <= k:
        return None
    names = np.array([r["vec_id"] for r in sample])
    queries = _unit(pa.array([r["embedding"] for r in sample], pa.list_(pa.float32())), dim)
    schema = "q long, c float, n long, vec array<float>"
    found = one.select("vec_id", "embedding").mapInArrow(_best_of_sample(queries, names, k), schema)
    parts = max(1, min(SAMPLE, int(one.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    best = found.repartition(parts, "q").mapInArrow(_best_of_all(k), schema).select("q", "vec").collect()
    asks = np.array([r["q"] for r in best])
    near = np.array([r["vec"] for r in best], np.float32)
    some = one.sample(min(1.0, SAMPLE_ROWS / rows), seed=3).select("embedding").limit(2 * SAMPLE_ROWS).collect()
    if not some or not len(asks):
        return None
    others = _unit(pa.array([r["embedding"] for r in some], pa.list_(pa.float32())), dim)
    few = np.arange(0, len(queries), max(1, len(queries) // 32))
    pair_q = np.repeat(few, len(others))
    least, plan = np.inf, None
    for hashes, most in _TABLES.items():
        count = axis_count(dim) ** hashes
        met, seen = np.full(len(asks), 1 << 30), np.full(len(pair_q), 1 << 30)
        for t in range(1, most + 1):
            if _COPY_COST * t * rows >= least:
                break
            probed = cells(queries, t - 1, hashes, MAX_PROBES)
            met = np.minimum(met, _ranks(probed, asks, cells(near, t - 1, hashes, 1)[:, 0]))
            seen = np.minimum(seen, _ranks(probed, pair_q, np.tile(cells(others, t - 1, hashes, 1)[:, 0], len(few))))
            probes = int(np.sort(met)[int(np.ceil(RECALL * len(met))) - 1]) + 1
            if probes > min(count, MAX_PROBES):
                continue
            share = float((seen < probes).mean())
            layout = Layout(rows, dim, hashes, t, probes)
            copies = t * (rows + asking * min(probes, layout.blocks))
            work = _COPY_COST * copies + _PAIR_COST * share * rows * asking * dim / 64
            if share < MOST_PAIRS and work < least:
                least, plan = work, (hashes, t, probes)
    return plan


# ---------------------------------------------------------------- the operator
def _cleaned(vectors: DataFrame, ask: Column | None) -> DataFrame:
    """(vec_id, embedding, ask): rows that count, one for each vec_id. Vectors are shuffled only where ids repeat."""
    good = "vec_id is not null and embedding is not null and size(embedding) > 0 and not exists(embedding, v -> v is null or isnan(v) or abs(v) = double('inf')) and exists(embedding, v -> v <> 0)"
    clean = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<float>").alias("embedding"), (F.lit(True) if ask is None else F.coalesce(ask, F.lit(False))).alias("ask")).where(good)
    again = cut_lineage(clean.groupBy("vec_id").count().where("count > 1").select(F.col("vec_id").alias("_again")))
    if again.isEmpty():
        return clean
    same = F.col("vec_id") == F.col("_again")
    single, repeated = (clean.join(again, same, how) for how in ("left_anti", "left_semi"))
    return cut_lineage(single.unionByName(repeated.groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("ask").alias("ask"))))


def nearest(vectors: DataFrame, k: int = K, ask: Column | None = None, plan: tuple[int, int, int] | None = None) -> DataFrame:
    """(vec_id, neighbour_id, cosine): about the k nearest of every vector, or of those where ``ask`` holds, among all vectors."""
    spark = vectors.sparkSession
    one = _cleaned(vectors, ask)
    sizes = sorted((-r[1], r[0], r[2]) for r in one.groupBy(F.size("embedding")).agg(F.count("*"), F.count_if("ask")).collect())
    if not sizes:
        return one.select("vec_id", F.col("vec_id").alias("neighbour_id"), F.lit(0.0).alias("cosine")).where("false")
    rows, dim, asking = -sizes[0][0], sizes[0][1], sizes[0][2]
    one = one.where(F.size("embedding") == dim)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    item = F.struct((-F.col("cosine")).alias("c"), F.col("neighbour_id").alias("n"))

    def searched(dealt: DataFrame) -> DataFrame:
        found = dealt.repartition(tasks, "grp").sortWithinPartitions("grp", "kind").mapInArrow(_search(dim, k), "vec_id long, neighbour_id long, cosine double")
        return found.groupBy("vec_id").agg(F.slice(F.sort_array(F.collect_set(item)), 1, k).alias("best"))

    plan = plan or measured_plan(one, rows, asking, dim, k)
    if plan:
        layout = Layout(rows, dim, *plan)
        share = min(1.0, _LAYOUT_ROWS / rows)
        some = one.sample(share, seed=4).select("embedding").mapInArrow(_blocks(layout), "t int, block long, n long")
        layout.split([tuple(r) for r in some.groupBy("t", "block").agg(F.sum("n")).collect()], share)
        best = cut_lineage(searched(one.mapInArrow(_deal(layout, k), _SCHEMA)))
        full = best.where(F.size("best") >= min(k, rows - 1))
        if full.count() < asking:
            rest = one.join(full.select(F.col("vec_id").alias("_full")), F.col("vec_id") == F.col("_full"), "left").withColumn("ask", F.col("ask") & F.col("_full").isNull()).select("vec_id", "embedding", "ask")
            best = full.unionByName(searched(rest.mapInArrow(_deal(Layout(rows, dim, 0, 1, 1), k), _SCHEMA)))
    else:
        best = searched(one.mapInArrow(_deal(Layout(rows, dim, 0, 1, 1), k), _SCHEMA))
    return best.select("vec_id", F.explode("best").alias("b")).select("vec_id", F.col("b.n").alias("neighbour_id"), (-F.col("b.c")).alias("cosine"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The K nearest, among all embeddings, of every one whose vec_id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, ask=vectors["vec_id"] % 20 == 0)
