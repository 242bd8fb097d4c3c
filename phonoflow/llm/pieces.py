"""10. SentencePiece encoding by forward filtering and backward sampling, and decoding.

A text's chunks (a space run with what follows it; a line feed) hold whole pieces, as no piece has a space behind another
character. The lattice of a chunk has an arc for every vocabulary piece that matches at a place, and byte arcs for a
character that has no piece. Forward: log sums of path weights up to every place. Backward: from the end, an arc is drawn
with its share of the forward weight. A path's probability is proportional to the product of its pieces' weights,
1/(2 + merge rank) to the power ALPHA, so a larger ALPHA keeps nearer to the best path.

The draws come from a counter hash of (seed, row key, chunk number, step): a row gives the same pieces in any partitioning,
on any machine, at any retry. Everything is done for all chunks of a slice at once on byte arrays, long chunks one by one;
equal chunks share their lattice. One Arrow pass, no shuffle.

Decoding joins the pieces' bytes and takes off the space that encoding puts in front; it gives back every text byte by
byte: spaces aren't collapsed, nothing is normalised, and a literal U+2581 goes by bytes.

Defined results: null stays null; the empty text has no pieces. A null key counts as 0. Rows with one key and text are
encoded alike. Extra columns aren't looked at.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoflow.llm.hashing import mix64, text_buffers
from phonoflow.llm.tokens import TOKENIZER_DIR
from phonoflow.plans.register import source
from phonoflow.session import bound_batches

MODEL = "piece_bpe_32k.model"
ALPHA = 1.0
SEED = 17
_SLICE = 1 << 20
_BYTE_WEIGHT = -12.0
#: Bytes from which a chunk is sampled by itself: a step for all chunks at once would serve it alone.
LONG_CHUNK = 256
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """The pieces as bytes (a space for U+2581), their log weights, and a trie of them as a sorted edge list."""

    def __init__(self, path: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces: list[bytes] = []
        self.weight = np.zeros(n)
        self.byte_id = np.full(256, -1, np.int32)
        words: dict[bytes, int] = {}
        for i in range(n):
            if sp.is_byte(i):
                b = bytes([int(sp.id_to_piece(i)[3:5], 16)])
                self.byte_id[b[0]] = i
                self.weight[i] = _BYTE_WEIGHT
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                b = b""
            else:
                b = sp.id_to_piece(i).replace("▁", " ").encode()
                score = sp.get_score(i)
                self.weight[i] = -np.log(2 - score) if score > -1e8 else -np.log(1000)
                words[b] = i
            self.pieces.append(b)
        if (self.byte_id < 0).any():
            raise ValueError("the model has no byte pieces")
        prefixes = sorted({w[:k] for w in words for k in range(1, len(w) + 1)}, key=lambda p: (len(p), p))
        node = {b"": 0}
        edges = []
        for k, p in enumerate(prefixes, 1):
            node[p] = k
            edges.append((node[p[:-1]] << 8) | p[-1])
        key = np.array(edges, np.int64)
        order = np.argsort(key)
        self.edge, self.child = key[order], order + 1
        self.term = np.full(len(prefixes) + 1, -1, np.int32)
        for w, i in words.items():
            self.term[node[w]] = i
        self.length = np.array([len(p) for p in self.pieces], np.int64)
        self.start = np.r_[0, np.cumsum(self.length)][:-1]
        self.bytes = np.frombuffer(b"".join(self.pieces), np.uint8)


@lru_cache(maxsize=2)
def vocabulary(folder: str = TOKENIZER_DIR, model: str = MODEL) -> Vocabulary:
    """One vocabulary per process."""
    return Vocabulary(str(Path(folder, model)))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p = np.full(n + 1, _GOLDEN, np.uint64)
    p[0] = 1
    q = np.full(n + 1, np.uint64(pow(int(_GOLDEN), -1, 1 << 64)), np.uint64)
    q[0] = 1
    return np.multiply.accumulate(p), np.multiply.accumulate(q)


_POWERS = lru_cache(maxsize=1)(lambda: _powers(2 * _SLICE))


def _chunk_starts(d: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where the chunks of texts that start at ``heads`` start."""
    start = np.zeros(len(d), bool)
    start[heads] = True
    start[1:] |= (d[1:] == 32) & (d[:-1] != 32)
    line = d == 10
    start |= line
    start[1:] |= line[:-1]
    return np.flatnonzero(start)


def _lattice(d: np.ndarray, begin: np.ndarray, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of all arcs over the bytes ``d`` of chunks that begin at ``begin``."""
    n = len(d)
    chunk = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, n]))
    stop = np.r_[begin[1:], n][chunk]
    head = (d & 0xC0) != 0x80
    head[begin] = True
    at = np.flatnonzero(head)
    size = np.diff(np.r_[at, n])  # of the character
    covered = np.zeros(n, bool)
    starts, ends, ids = [], [], []
    pos, node, limit, char = at, np.zeros(len(at), np.int64), stop[at], size
    depth = 0
    while len(pos):
        key = (node << 8) | d[pos + depth]
        e = np.searchsorted(voc.edge, key)
        e[e == len(voc.edge)] = 0
        ok = voc.edge[e] == key
        pos, node, limit, char = pos[ok], voc.child[e[ok]], limit[ok], char[ok]
        depth += 1
        piece = voc.term[node]
        hit = piece >= 0
        starts.append(pos[hit])
        ends.append(pos[hit] + depth)
        ids.append(piece[hit])
        covered[pos[hit & (char == depth)]] = True
        more = pos + depth < limit
        pos, node, limit, char = pos[more], node[more], limit[more], char[more]
    bare = np.repeat(~covered[at], size)  # bytes of characters without a piece
    b = np.flatnonzero(bare)
    return np.concatenate([*starts, b]), np.concatenate([*ends, b + 1]), np.concatenate([*ids, voc.byte_id[d[b]]])


def _sampled(d: np.ndarray, begin: np.ndarray, inverse: np.ndarray, noise: np.ndarray, voc: Vocabulary, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, their number) of every occurrence; occurrence i is of chunk ``inverse[i]`` and draws from ``noise[i]``."""
    s, e, piece = _lattice(d, begin, voc)
    n_chunks = len(begin)
    length = np.diff(np.r_[begin, len(d)])
    chunk = np.repeat(np.arange(n_chunks), length)[s]
    first = begin + np.arange(n_chunks)  # a chunk of n bytes has n + 1 nodes
    s, e = s + chunk, e + chunk
    order = np.argsort(e * 1024 + (e - s))  # by end, then length: no two arcs share both
    s, e, piece, chunk = s[order], e[order], piece[order], chunk[order]
    weight = alpha * voc.weight[piece]
    # forward filtering, by the distance of an arc's end from its chunk's start; long chunks one by one
    total = np.full(len(d) + n_chunks, -np.inf)
    total[first] = 0.0
    # scaled sums need the weights within an arc's reach to be numbers
    long = (length > LONG_CHUNK) & (-float(weight.min()) * int((e - s).max()) < 600)
    for c in np.flatnonzero(long):
        lo, hi = np.searchsorted(e, [first[c], first[c] + length[c] + 1])
        total[first[c] : first[c] + length[c] + 1] = _forward(s[lo:hi] - first[c], e[lo:hi] - first[c], weight[lo:hi], int(length[c]))
    depth, deepest = e - first[chunk], int(length[~long].max()) if not long.all() else 0
    order = np.argsort(depth.astype(np.uint16 if length.max() < 1 << 16 else np.int64), kind="stable")
    order = order[~long[chunk[order]]] if long.any() else order
    so, eo, wo, depth = s[order], e[order], weight[order], depth[order]
    cut = np.searchsorted(depth, np.arange(1, deepest + 2))
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if a == b:
            continue
        v = total[so[a:b]] + wo[a:b]
        ends = eo[a:b]
        g = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
        top = np.maximum.reduceat(v, g)
        top = np.where(np.isfinite(top), top, 0.0)
        size = np.diff(np.r_[g, b - a])
        with np.errstate(divide="ignore"):
            total[ends[g]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, size)), g))
    # each node's arcs by cumulative share, node number + share as one ascending key
    reach = np.isfinite(total[s]) & np.isfinite(total[e])
    if not reach.all():
        s, e, piece, weight = s[reach], e[reach], piece[reach], weight[reach]
    share = np.exp(total[s] + weight - total[e])
    g = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
    size = np.diff(np.r_[g, len(e)])
    run = np.cumsum(share)
    run -= np.repeat(run[g] - share[g], size)
    key = e + np.minimum(run / np.repeat(run[g + size - 1], size), 1.0)
    key[g + size - 1] = e[g + size - 1] + 1.0
    # backward sampling of all occurrences at once, but for those of long chunks
    occ = np.argsort(inverse, kind="stable")
    ends_of = first + length
    late = occ[long[inverse[occ]]]
    occ = occ[~long[inverse[occ]]]
    at, floor, base = ends_of[inverse[occ]], first[inverse[occ]], noise[occ]
    count = np.zeros(len(inverse), np.int64)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    step = 0
    while len(occ):
        arc = np.searchsorted(key, at + _draws(base, np.uint64(step)), side="right")
        arc = np.minimum(arc, len(key) - 1)
        arc -= e[arc] > at  # the sum may have rounded up to the next node
        steps.append((occ, piece[arc]))
        count[occ] += 1
        at = s[arc]
        more = at > floor
        occ, at, floor, base = occ[more], at[more], floor[more], base[more]
        step += 1
    alone: list[tuple[int, np.ndarray]] = []
    lists, listed = ([], [], []), -1
    for o in late.tolist():
        c = int(inverse[o])
        lo, hi = np.searchsorted(e, [first[c], ends_of[c] + 1])
        if c != listed:  # equal chunks lie side by side
            lists, listed = (key[lo:hi].tolist(), s[lo:hi].tolist(), e[lo:hi].tolist()), c
        picked = _backward(*lists, int(first[c]), int(ends_of[c]), _draws(noise[o], np.arange(int(length[c]), dtype=np.uint64)).tolist())
        alone.append((o, piece[lo + np.array(picked, np.int64)]))
        count[o] = len(picked)
    end = np.cumsum(count)
    out = np.empty(int(end[-1]) if len(end) else 0, np.int32)
    for k, (o, p) in enumerate(steps):
        out[end[o] - 1 - k] = p
    for o, p in alone:
        out[end[o] - len(p) : end[o]] = p[::-1]
    return out, count


def _draws(base: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Uniform draws in [0, 1) by a counter hash."""
    with np.errstate(over="ignore"):
        return (mix64(base + step * np.uint64(0xD1342543DE82EF95)) >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _forward(s: np.ndarray, e: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Log sums of path weights from node 0 to each of n + 1; arcs come by their ends.

    Sums are kept as numbers, not logs, and those within an arc's reach are scaled whenever they get small or large.
    """
    sums, value, scaled = [1.0] + [0.0] * n, [1.0] + [0.0] * n, [0.0] * (n + 1)
    at, scale, reach = 0, 0.0, int((e - s).max())
    for a, b, w in zip(s.tolist(), e.tolist(), np.exp(weight).tolist(), strict=True):
        if b != at:
            x = value[at] = sums[at]
            scaled[at] = scale
            if 0.0 < x < 1e-100 or x > 1e100:
                for k in range(max(0, at - reach), at + 1):
                    sums[k] /= x
                scale += math.log(x)
            at = b
        sums[b] += sums[a] * w
    value[at], scaled[at] = sums[at], scale
    with np.errstate(divide="ignore"):
        return np.log(np.array(value)) + np.array(scaled)


def _backward(key: list[float], s: list[int], e: list[int], first: int, last: int, draws: list[float]) -> list[int]:
    """The arcs of one path, from its end."""
    at, picked = last, []
    for u in draws:
        arc = min(bisect_right(key, at + u), len(key) - 1)
        arc -= e[arc] > at
        picked.append(arc)
        at = s[arc]
        if at <= first:
            break
    return picked


def encode_slice(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, voc: Vocabulary, seed: int = SEED, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, their number by text) of texts by their bytes and offsets."""
    size = np.diff(offsets)
    n = len(size)
    some = np.flatnonzero(size > 0)
    if not len(some):
        return np.zeros(0, np.int32), np.zeros(n, np.int64)
    head = offsets[some] + np.arange(len(some))  # a space goes in front of every text
    d = np.full(len(data) + len(some), 32, np.uint8)
    body = np.ones(len(d), bool)
    body[head] = False
    d[body] = data
    begin = _chunk_starts(d, head)
    stop = np.r_[begin[1:], len(d)]
    text = np.searchsorted(head, begin, "right") - 1
    power, back = _POWERS() if len(d) <= 2 * _SLICE else _powers(len(d))
    sums = np.empty(len(d) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((d.astype(np.uint64) + np.uint64(1)) * power[: len(d)], out=sums[1:])
    h = mix64((sums[stop] - sums[begin]) * back[begin] + (stop - begin).astype(np.uint64))
    _, pick, inverse = np.unique(h, return_index=True, return_inverse=True)
    length = (stop - begin)[pick]
    first = np.r_[0, np.cumsum(length)][:-1]
    own = d[np.repeat(begin[pick] - first, length) + np.arange(int(length.sum()))]
    ordinal = (np.arange(len(begin)) - np.searchsorted(begin, head)[text]).astype(np.uint64)
    noise = mix64(mix64(keys[some].astype(np.uint64) ^ np.uint64(seed))[text] + ordinal * _GOLDEN)
    pieces, count = _sampled(own, first, inverse, noise, voc, alpha)
    by_text = np.zeros(n, np.int64)
    by_text[some] = np.add.reduceat(count, np.searchsorted(begin, head))
    return pieces, by_text


def decode_slice(pieces: np.ndarray, count: np.ndarray, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of piece runs."""
    size = voc.length[pieces]
    first = np.cumsum(size) - size
    out = voc.bytes[np.repeat(voc.start[pieces] - first, size) + np.arange(int(size.sum()))]
    text = np.repeat(np.arange(len(count)), count)
    total = np.bincount(text, weights=size, minlength=len(count)).astype(np.int64)
    some = total > 0
    keep = np.ones(len(out), bool)
    keep[(np.cumsum(total) - total)[some]] = False  # the space in front
    return out[keep], np.r_[0, np.cumsum(total - some)]


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _SLICE, "right")) - 1)
        yield at, min(to, n)
        at = to


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, alpha: float = ALPHA, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, pieces, lossless) of every row; lossless tells that decoding gives back the text's bytes."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(folder)
        for b in batches:
            if not b.num_rows:
                continue
            data, offsets = text_buffers(b.column(1))
            keys = b.column(0).fill_null(0).to_numpy().view(np.uint64)
            null = b.column(1).is_null().to_numpy(zero_copy_only=False)
            for at, to in _slices(offsets):
                part, off = data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
                pieces, count = encode_slice(part, off, keys[at:to], voc, seed, alpha)
                back, cut = decode_slice(pieces, count, voc)
                same = np.array_equal(cut, off) and np.array_equal(back, part)
                ok = np.full(to - at, True) if same else np.array([back[cut[i] : cut[i + 1]].tobytes() == part[off[i] : off[i + 1]].tobytes() for i in range(to - at)])
                ends = np.r_[0, np.cumsum(count)].astype(np.int32)
                lists = pa.ListArray.from_arrays(ends, pa.array(pieces), mask=pa.array(null[at:to]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), lists, pa.array(ok, mask=null[at:to])], ["key", "pieces", "lossless"])

    out = docs.select(docs[key].cast("long").alias("key"), docs[text].alias("text")).mapInArrow(run, "key long, pieces array<int>, lossless boolean")
    return out.withColumnRenamed("key", key)


def decoded(rows: DataFrame, key: str = "doc_id", pieces: str = "pieces", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, text) of rows of piece ids; null stays null."""

    @F.arrow_udf("string")
    def text(ids: pa.Array) -> pa.Array:
        count = pa.compute.list_value_length(ids).fill_null(0).to_numpy().astype(np.int64)
        data, offsets = decode_slice(ids.flatten().to_numpy(zero_copy_only=False), count, vocabulary(folder))
        raw = data.tobytes()
        null = ids.is_null().to_pylist()
        return pa.array([None if null[i] else raw[offsets[i] : offsets[i + 1]].decode() for i in range(len(ids))], pa.string())

    return rows.select(rows[key].alias(key), text(rows[pieces]).alias("text"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sampled pieces, decoded again for the lossless flag."""
    return encoded(source(spark, sf_dir, "documents"))
