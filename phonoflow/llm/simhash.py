"""1. SimHash near-dedup by bit-sliced comparison.

Plan: a 256-bit signature per document over its distinct words -> one row per distinct signature -> bucket tables keyed
by fixed samples of signature bits -> inside each bucket, signatures lie as vertical bit planes, and one query's distances
to 64 signatures per machine word are counted by carry-save adders; a block of words is abandoned as soon as all its
distances exceed the radius -> spanning edges -> connected components. The buckets may miss a pair, so an exact pass over
all pairs of signatures of different components follows: of the 16 parts of 16 bits of a pair within the radius, one at
least differs in so few bits that all keys this near can be looked up (multi-index hashing); blocks of signatures meet
in tasks, and what they find links components.

Only doc_id and 32 bytes a document are shuffled, never texts. Identical signatures collapse before any comparison, and a
bucket gives at most one edge for each of its signatures, so groups of thousands of copies cost what they weigh. There is
no cap on bucket or group sizes.

Recall: every pair of signatures within the radius is linked. In the tables, two signatures at the radius share a bucket
with a probability of at least ``recall``, which decides how much is left to the exact pass, not what is found: the more
of a dense group is one component already, the less of it is compared there. The exact pass compares some
3 of 100 pairs for random bits, more for uneven ones, so its work grows with the square of the distinct signatures.

Defined results: a null or empty text, and a row without doc_id, are never duplicates and stay. Texts without any word
compare by all their bytes. Of a group the smallest doc_id stays. Of rows that repeat both doc_id and text one stays;
rows that share a doc_id but not the text are kept or dropped together, by the doc_id. Other columns aren't looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoflow.llm.hashing import distinct_per_text, mix64, text_buffers, words
from phonoflow.plans.register import source
from phonoflow.session import bound_batches, cut_lineage

BITS = 256
RADIUS = 46
RECALL = 0.9
#: Ids of eight bytes that a broadcast may hold.
BROADCAST_IDS = 2_000_000
#: Signatures of a block of the exact pass, and parts of a signature that are keys there.
BLOCK = 1 << 19
PARTS = BITS // 16
#: Components with more signatures in a task are held against the others alone; candidates that are compared at once.
LARGE = 4096
_CANDIDATES = 1 << 17
_WORDS = BITS // 64
_BITS_OF = np.bitwise_count(np.arange(1 << 16, dtype=np.uint32))
_SEEDS = [np.uint64((0x632BE59BD9B4E019 * (i + 1)) & (2**64 - 1)) for i in range(_WORDS)]
#: The eight bits of a byte, each in a byte of its own.
_SPREAD = np.array([sum(((b >> (7 - i)) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


# ---------------------------------------------------------------- signatures
def majority_bits(text: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """n x _WORDS uint64: each bit is what most features of the text have there. ``text`` ascends."""
    out = np.zeros((n, _WORDS), np.uint64)
    if not len(h):
        return out
    first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    size = np.diff(np.r_[first, len(text)])
    # runs of at most 255 features, so that eight byte counters fit one uint64 sum
    parts = (size + 254) // 255
    run = np.repeat(first, parts) + 255 * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    head = np.cumsum(parts) - parts
    for w in range(_WORDS):
        y = mix64(h + _SEEDS[w]).view(np.uint8).reshape(-1, 8)
        bits = np.empty((len(first), 64), np.uint8)
        for k in range(8):
            counts = np.add.reduceat(_SPREAD[y[:, k]], run).view(np.uint8).reshape(-1, 8).astype(np.int32)
            bits[:, 8 * k : 8 * k + 8] = 2 * np.add.reduceat(counts, head, axis=0) > size[:, None]
        out[text[first], w] = np.packbits(bits, axis=1).view(np.uint64)[:, 0]
    return out


def signatures(column: pa.Array) -> pa.Array:
    """The 32-byte signature of each text; null for a null or empty one."""
    data, offsets = text_buffers(column)
    n = len(offsets) - 1
    sig = np.zeros((n, _WORDS), np.uint64)
    some = np.zeros(n, bool)
    for at, to, text, _, _, h in words(data, offsets):
        text, h = distinct_per_text(text, h)
        sig[at:to] = majority_bits(text, h, to - at)
        some[at + text] = True
    for i in np.flatnonzero(~some & (np.diff(offsets) > 0)):  # no word: all bytes are one feature
        raw = data[offsets[i] : offsets[i + 1]].tobytes()
        h = pd.util.hash_array(np.array([raw.hex()], object), categorize=False).astype(np.uint64)
        sig[i] = [mix64(h + s)[0] for s in _SEEDS]
    rows = sig.view(np.uint8).reshape(n, 8 * _WORDS) if n else np.zeros((0, 8 * _WORDS), np.uint8)
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * _WORDS), n, [None, pa.py_buffer(rows.tobytes())])
    return pa.compute.if_else(pa.array(np.diff(offsets) > 0), fixed.cast(pa.binary()), pa.scalar(None, pa.binary()))


def _signature_udf():
    @F.arrow_udf("binary")
    def simhash(text: pa.Array) -> pa.Array:
        return signatures(text)

    return simhash


# ---------------------------------------------------------------- tables
def plan_tables(rows: int, radius: int = RADIUS, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a key, tables): buckets of about 4,096 signatures, and so many tables that a pair at the radius meets with probability ``recall``; :func:`missed_links` has the rest."""
    width = max(8, min(28, math.ceil(math.log2(max(rows, 1))) - 12))
    meet = math.prod((BITS - radius - i) / (BITS - i) for i in range(width))
    return width, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def table_keys(sig: np.ndarray, width: int, tables: int) -> np.ndarray:
    """rows x tables int64: table number and the sampled bits of each signature."""
    bits = np.unpackbits(sig.view(np.uint8).reshape(len(sig), -1), axis=1)
    rng = np.random.default_rng(20)
    out = np.empty((len(sig), tables), np.int64)
    weight = 1 << np.arange(width, dtype=np.int64)
    for t in range(tables):
        out[:, t] = (bits[:, rng.choice(BITS, width, replace=False)].astype(np.int64) @ weight) | (t << 32)
    return out


# ---------------------------------------------------------------- bit-sliced comparison
def planes(sig: np.ndarray) -> np.ndarray:
    """BITS x ceil(rows / 64) uint64: bit j of all signatures side by side."""
    n = len(sig)
    bits = np.zeros((BITS, (n + 63) // 64 * 64), np.uint8)
    bits[:, :n] = np.unpackbits(sig.view(np.uint8).reshape(n, BITS // 8), axis=1).T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def near_blocks(plane: np.ndarray, query: np.ndarray, radius: int, step: int = 32) -> np.ndarray:
    """queries x words: bits of the columns of ``plane`` whose distance to the query is at most ``radius``.

    ``query`` is BITS x queries, all bits of an entry set or none. Differences go into vertical counters by carry-save
    addition, ``step`` planes at a time; then blocks of 64 columns that have none left within the radius are abandoned.
    """
    n, words_ = query.shape[1], plane.shape[1]
    width = int(radius + step).bit_length()
    left = np.full(n * words_, np.uint64(2**64 - 1))
    counter = [np.zeros(n * words_, np.uint64) for _ in range(width)]
    at = None  # flat places of the blocks that are left, once most are gone
    for p in range(0, BITS, step):
        if at is None:
            todo = [(plane[j][None, :] ^ query[j][:, None]).ravel() for j in range(p, p + step)]
        else:
            q, w = np.divmod(at, words_)
            todo = [plane[j][w] ^ query[j][q] for j in range(p, p + step)]
        for level in range(width):
            todo.append(counter[level])
            carry = []
            while len(todo) > 2:  # full adder: three of one weight to one of it and one of the next
                a, b, c = todo.pop(), todo.pop(), todo.pop()
                u = a ^ b
                todo.append(u ^ c)
                carry.append((a & b) | (u & c))
            if len(todo) == 2:
                a, b = todo
                todo = [a ^ b]
                carry.append(a & b)
            counter[level] = todo[0]
            if not carry:
                break
            todo = carry
        over, same = np.zeros(len(left), np.uint64), np.full(len(left), np.uint64(2**64 - 1))
        for k in range(width - 1, -1, -1):  # counter > radius, from the highest bit
            if (radius >> k) & 1:
                same &= counter[k]
            else:
                over |= same & counter[k]
                same &= ~counter[k]
        left &= ~over
        if p + step < BITS:
            counter = [c & left for c in counter]
            stay = left != 0
            some = int(stay.sum())
            if not some:
                return np.zeros((n, words_), np.uint64)
            if 2 * some < len(left):
                at = np.flatnonzero(stay) if at is None else at[stay]
                left, counter = left[stay], [c[stay] for c in counter]
    if at is None:
        return left.reshape(n, words_)
    out = np.zeros(n * words_, np.uint64)
    out[at] = left
    return out.reshape(n, words_)


def _columns(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(mask.view(np.uint8), bitorder="little"))


def _closed_components(sig: np.ndarray, plane: np.ndarray, query: np.ndarray, radius: int) -> tuple[list, np.ndarray]:
    """Edges of whole components found from single seeds, while those are large; rows that no such component has.

    Every member of a component is held against all rows that nothing has reached, so a component is closed when its queue
    is empty, and what is left has no pair with it.
    """
    n = len(sig)
    free = np.ones(n, bool)
    edges, poor = [], 0
    while poor < 8 and free.any():
        seed = int(np.flatnonzero(free)[0])
        free[seed] = False
        todo, size = [seed], 1
        while todo and free.any():
            block, todo = todo[:64], todo[64:]
            at = np.flatnonzero(free)
            hit = near_blocks(planes(sig[at]) if len(at) < n // 2 else plane, query[:, block], radius)
            for q, mask in zip(block, hit, strict=True):
                near = _columns(mask)
                near = at[near[near < len(at)]] if len(at) < n // 2 else near[near < n]
                near = near[free[near]]
                free[near] = False
                edges += [(q, int(x)) for x in near]
                todo += near.tolist()
                size += len(near)
        poor = poor + 1 if size * 100 < n else 0
    return edges, np.flatnonzero(free)


def spanning_edges(sig: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A forest over the rows of ``sig`` that has the components of the graph of all pairs within the radius. Exact."""
    n = len(sig)
    edges: list[tuple[int, int]] = []
    rows = np.arange(n)
    near: dict[int, np.ndarray] = {}
    if n <= 64:  # less than a machine word a plane: nothing to slice
        d = np.bitwise_count(sig[:, None, :] ^ sig[None, :, :]).sum(2) <= radius
        np.fill_diagonal(d, False)
        near = {int(i): np.flatnonzero(d[i]) for i in np.flatnonzero(d.any(1))}
    else:
        full = np.uint64(2**64 - 1)
        query = np.unpackbits(sig.view(np.uint8).reshape(n, -1), axis=1).T * full
        plane = planes(sig)
        if n > 2048:
            edges, rows = _closed_components(sig, plane, query, radius)
            if len(rows) < n:
                plane, query = planes(sig[rows]), query[:, rows]
        m = len(rows)
        at = 0
        while at < m:
            w0 = at // 64
            to = min(m, at + max(8, 4096 // max(1, plane.shape[1] - w0)))
            hit = near_blocks(plane[:, w0:], query[:, at:to], radius)
            for i in np.flatnonzero(np.bitwise_count(hit).sum(1) > 1):
                x = _columns(hit[i]) + 64 * w0
                x = x[(x > at + i) & (x < m)]
                if len(x):
                    near[at + int(i)] = x
            at = to
        back: dict[int, list] = {}
        for i, xs in near.items():
            for x in xs.tolist():
                back.setdefault(x, []).append(i)
        near = {i: np.concatenate([near.get(i, np.zeros(0, np.int64)), np.array(back.get(i, []), np.int64)]) for i in near.keys() | back.keys()}
    seen = np.zeros(len(rows), bool)
    for seed in sorted(near):
        if seen[seed]:
            continue
        seen[seed] = True
        todo = [seed]
        while todo:
            q = todo.pop()
            x = near[q]
            x = x[~seen[x]]
            seen[x] = True
            edges += [(int(rows[q]), int(rows[y])) for y in x]
            todo += x.tolist()
    return edges


def _bucket_edges(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(key: np.ndarray, ids: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = []
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for s, e in zip(cut, np.r_[cut[1:], len(key)], strict=True):
                if e - s > 1:
                    found += [(ids[s + i], ids[s + j]) for i, j in spanning_edges(sig[s:e], radius)]
            if found:
                ab = np.sort(np.array(found, np.int64), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

        held = None  # rows of the key that the last batch ended in
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            here = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint64).reshape(n, _WORDS))
            if held is not None:
                here = tuple(np.concatenate(x) for x in zip(held, here, strict=True))
            last = int(np.searchsorted(here[0], here[0][-1], "left"))
            if last:
                yield from close(*(x[:last] for x in here))
            held = tuple(x[last:] for x in here)
        if held is not None:
            yield from close(*held)

    return run


# ---------------------------------------------------------------- the exact pass
def close_pairs(a: np.ndarray, b: np.ndarray | None, radius: int, parts: Iterable[int] = range(PARTS)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of a, rows of b) of all pairs within the radius, some of them more than once; without ``b``, the pairs in ``a``.

    Where the distances of PARTS parts add up to the radius at most, one part p has (radius - PARTS + 1 + p) // PARTS at
    most: if all had one more, their sum would be above the radius. ``parts``: the pairs that these tell.
    """
    for p in parts:
        reach = (radius - PARTS + 1 + p) // PARTS
        if reach < 0:
            continue
        words_ = [(p // 4 + k) % _WORDS for k in (1, 2, 3, 0)]  # that of the part last: it tells least
        row_a = np.argsort(a.view(np.uint16)[:, p], kind="stable")
        key, left = a.view(np.uint16)[row_a, p], [a[row_a, w] for w in words_]
        row_b, key_b, right = row_a, key, left
        if b is not None:
            row_b = np.argsort(b.view(np.uint16)[:, p], kind="stable")
            key_b, right = b.view(np.uint16)[row_b, p], [b[row_b, w] for w in words_]
        count = np.bincount(key_b, minlength=1 << 16)
        first = np.cumsum(count) - count
        for mask in np.flatnonzero(reach >= _BITS_OF).tolist():
            partner = key ^ np.uint16(mask)
            n, start = count[partner], first[partner]
            if b is None and mask:  # each pair of keys from its smaller one
                n = np.where(key & np.uint16(1 << (mask.bit_length() - 1)), 0, n)
            elif b is None:
                n, start = start + n - np.arange(1, len(key) + 1), np.arange(1, len(key) + 1)
            end = np.cumsum(n)
            at, done = 0, 0
            while at < len(n) and done < end[-1]:
                to = max(at + 1, int(np.searchsorted(end, done + _CANDIDATES, "right")))
                times, stop = n[at:to], int(end[to - 1])
                y = np.repeat(start[at:to] - (end[at:to] - times - done), times) + np.arange(stop - done)
                d = np.bitwise_count(np.repeat(left[0][at:to], times) ^ right[0][y]) + np.bitwise_count(np.repeat(left[1][at:to], times) ^ right[1][y])
                near = np.flatnonzero(d <= radius)
                if len(near):
                    x, y = at + np.searchsorted(end[at:to] - done, near, "right"), y[near]
                    hit = d[near].astype(np.int64) + np.bitwise_count(left[2][x] ^ right[2][y]) + np.bitwise_count(left[3][x] ^ right[3][y]) <= radius
                    yield row_a[x[hit]], row_b[y[hit]]
                at, done = to, stop


def linked_roots(sig: np.ndarray, root: np.ndarray, late: np.ndarray, radius: int, parts: Iterable[int] = range(PARTS)) -> np.ndarray:
    """pairs x 2, without repetition: the different roots, smaller first, of signatures within the radius.

    Where some are ``late``, those against the others only. Pairs of one large component are not looked at.
    """
    _, which, size = np.unique(root, return_inverse=True, return_counts=True)
    large, small = np.flatnonzero(size > LARGE), size[which] <= LARGE
    if late.any():
        jobs = [(np.flatnonzero(small & ~late), np.flatnonzero(late))]
        jobs += [(np.flatnonzero((which == g) & ~late), np.flatnonzero((which != g) & late)) for g in large]
    else:
        jobs = [(np.flatnonzero(small), None)]
        jobs += [(np.flatnonzero(which == g), np.flatnonzero(small | (which > g))) for g in large]
    out, held, n = np.zeros((0, 2), np.int64), [], 0
    for a, b in jobs:
        if not len(a) or (b is not None and not len(b)):
            continue
        rows_b = a if b is None else b
        for x, y in close_pairs(sig[a], None if b is None else sig[b], radius, parts):
            ends = np.stack([root[a[x]], root[rows_b[y]]], axis=1)
            ends = ends[ends[:, 0] != ends[:, 1]]
            held.append(np.sort(ends, axis=1))
            n += len(ends)
            if n > 1 << 20:
                out, held, n = np.unique(np.concatenate([out, *held]), axis=0), [], 0
    return np.unique(np.concatenate([out, *held]), axis=0)


def _task_links(radius: int, shares: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            task, root, late = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint64).reshape(n, _WORDS)
            for t in np.unique(task):
                here = task == t
                held.setdefault(int(t), []).append((sig[here], root[here], late[here]))
        for t in sorted(held):
            found = linked_roots(*(np.concatenate(x) for x in zip(*held.pop(t), strict=True)), radius, range(t % shares, PARTS, shares))
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return run


def missed_links(labelled: DataFrame, radius: int) -> DataFrame:
    """(a, b), a < b: the roots of all signatures of ``labelled`` (sig, root) that are within the radius and not of one root.

    A task for each pair of blocks of signatures; while those are few, tasks share the parts of a signature.
    """
    blocks = max(1, math.ceil(labelled.count() / BLOCK))
    pairs = blocks * (blocks + 1) // 2
    shares = min(PARTS, math.ceil(64 / pairs))
    placed = labelled.select("root", "sig", F.pmod(F.xxhash64("sig"), F.lit(blocks)).alias("block")).withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(blocks * shares - 1))))
    low, high = (f"{f}(block, to div {shares})" for f in ("least", "greatest"))
    task = F.expr(f"int(({high} * ({high} + 1) div 2 + {low}) * {shares} + to % {shares})")
    dealt = placed.select(task.alias("task"), "root", F.expr(f"block > to div {shares}").alias("late"), "sig").repartitionById(pairs * shares, "task")
    return dealt.mapInArrow(_task_links(radius, shares), "a long, b long").distinct()


# ---------------------------------------------------------------- components
def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a < b): the smallest node of its component.

    Alternating large-star and small-star steps, each one shuffle of the edges; a checkpoint cuts the lineage of each round.
    """
    edges = cut_lineage(edges.select("a", "b").where("a < b").distinct())
    before = None
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # an aggregation and a join in place of a window: a hot node is added up in parts, and its edges may be split
        large = both.join(both.groupBy("u").agg(F.min("v").alias("m")), "u").where("v > u").select(F.least("u", "m").alias("a"), F.col("v").alias("b")).distinct()
        small = large.join(large.groupBy("b").agg(F.min("a").alias("m")), "b")
        star = small.select(F.explode(F.array("a", "b")).alias("b"), F.col("m").alias("a")).where("a < b").select("a", "b").distinct()
        edges = cut_lineage(star)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = state


# ---------------------------------------------------------------- the operator
def near_duplicates(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL) -> DataFrame:
    """(doc_id, duplicate_of): every document that is a near copy of another, with the smallest doc_id of its group."""
    spark = docs.sparkSession
    bound_batches(spark)
    sig = _signature_udf()
    marked = docs.select(F.col("doc_id").cast("long").alias("id"), sig(F.col("text")).alias("sig")).where("id is not null and sig is not null")
    per_doc = cut_lineage(marked)
    same = per_doc.groupBy("sig").agg(F.min("id").alias("rep"))
    width, tables = plan_tables(per_doc.count(), radius, recall)
    keys = _keys_udf(width, tables)
    rows = same.select(F.explode(keys("sig")).alias("key"), "rep", "sig")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    pairs = rows.repartition(n, "key").sortWithinPartitions("key", "rep").mapInArrow(_bucket_edges(radius), "a long, b long")
    # exact copies take no part in the rounds: they follow the first of their signature
    roots = components(pairs)
    labelled = cut_lineage(same.join(roots, F.col("rep") == F.col("node"), "left").select("sig", F.coalesce("root", "rep").alias("root")))
    missed = cut_lineage(missed_links(labelled, radius))
    if not missed.isEmpty():
        joined = components(missed).select("node", F.col("root").alias("first"))
        labelled = labelled.join(joined, F.col("root") == F.col("node"), "left").select("sig", F.coalesce("first", "root").alias("root"))
    return per_doc.join(labelled, "sig").select(F.col("id").alias("doc_id"), F.col("root").alias("duplicate_of")).distinct().where("doc_id <> duplicate_of")


def _keys_udf(width: int, tables: int):
    @F.arrow_udf("array<bigint>")
    def keys(sig: pa.Array) -> pa.Array:
        if not len(sig):
            return pa.array([], pa.list_(pa.int64()))
        s = np.frombuffer(b"".join(sig.to_pylist()), np.uint64).reshape(len(sig), _WORDS)
        k = table_keys(s, width, tables)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * tables), pa.array(k.ravel()))

    return keys


def one_of_each_group(docs: DataFrame, radius: int = RADIUS, recall: float = RECALL) -> DataFrame:
    """``docs`` without the documents that :func:`near_duplicates` names; columns as they were.

    The ids that go are broadcast up to BROADCAST_IDS of them; beyond that the join is a sort-merge join.
    """
    drop = cut_lineage(near_duplicates(docs, radius, recall).select(F.col("doc_id").alias("_dropped_id")))
    again = cut_lineage(docs.groupBy(F.col("doc_id").cast("long").alias("_again_id")).agg(F.count("*").alias("_rows")).where("_rows > 1 and _again_id is not null").select("_again_id"))
    small = lambda ids, n: F.broadcast(ids) if n <= BROADCAST_IDS else ids
    kept = docs.join(small(drop, drop.count()), docs["doc_id"].cast("long") == drop["_dropped_id"], "left_anti")
    n = again.count()
    if not n:
        return kept
    same = kept["doc_id"].cast("long") == again["_again_id"]
    single, repeated = (kept.join(small(again, n), same, how) for how in ("left_anti", "left_semi"))
    return single.unionByName(repeated.dropDuplicates(["doc_id", "text"]))


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that go, each with the one of its group that stays."""
    return near_duplicates(source(spark, sf_dir, "documents"))
