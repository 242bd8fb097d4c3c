"""Counting n-grams in Arrow passes: tables of words with sums, folded before and after one exchange of packed blocks.

Words are numbers within a chunk of text, in the order of their bytes; a null is -1. What is exchanged is a block of Arrow
columns for each chunk and bucket, sorted and compressed, so a shuffle moves a few bytes an n-gram instead of a row of
strings. A bucket is folded by one task, LIMIT rows at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

START, END = "<s>", "</s>"
#: Words, and bytes of words, that a chunk of text holds; a longer sentence comes alone, its n-grams LIMIT at a time.
LIMIT, CHUNK_BYTES = 1 << 20, 32 << 20
#: Bytes of an Arrow batch that is handed back.
OUT_BYTES = 4 << 20
_PACK = pa.ipc.IpcWriteOptions(compression="zstd")
_TEXT = pa.large_string()


class Grams:
    """Rows of word numbers (one array for each place) with sums (one column for each value)."""

    def __init__(self, words: pa.Array, keys: list[np.ndarray], values: np.ndarray) -> None:
        self.words, self.keys, self.values = words, keys, values

    def __len__(self) -> int:
        return len(self.values)

    def group(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For sorted rows: where groups of equal first ``n`` words start, and the group of each row."""
        new = np.zeros(len(self), bool)
        new[:1] = True
        for k in self.keys[:n]:
            new[1:] |= k[1:] != k[:-1]
        return np.flatnonzero(new), np.cumsum(new) - 1

    def columns(self, rows: np.ndarray | slice = slice(None)) -> list[pa.Array]:
        """The words of each place."""
        return [self.words.take(pa.array(k[rows], mask=k[rows] < 0)) for k in self.keys]


def number(columns: list[pa.Array], joined: bool = False) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct words of all columns, by bytes, and the columns as their numbers; as one where ``joined``."""
    coded = pa.concat_arrays(columns).dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order) + 1, np.int64)
    rank[order], rank[-1] = np.arange(len(order)), -1
    codes = rank[coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)]
    return coded.dictionary.take(pa.array(order)), [codes] if joined else np.split(codes, np.cumsum([len(c) for c in columns])[:-1])


def packed_key(keys: list[np.ndarray], size: int) -> np.ndarray:
    """One number a row that orders as the rows do."""
    key, span = keys[0] + 1, size + 1
    for k in keys[1:]:
        if span > (1 << 62) // (size + 1):
            found, key = np.unique(key, return_inverse=True)
            span = len(found)
        key, span = key * (size + 1) + k + 1, span * (size + 1)
    return key


def folded(g: Grams) -> Grams:
    """Equal rows as one, their values added up, in order."""
    if not len(g):
        return g
    key = packed_key(g.keys, len(g.words))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return Grams(g.words, [k[order[first]] for k in g.keys], np.add.reduceat(g.values[order], first, axis=0))


def blocks(g: Grams, by: list[int], buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, block) of folded rows; the words at ``by`` make the bucket."""
    if not len(g):
        return
    crc = np.array([*map(zlib.crc32, g.words.cast(pa.large_binary()).to_pylist()), 0], np.uint64)
    mixed = np.zeros(len(g), np.uint64)
    for k in by:
        mixed = (mixed ^ crc[g.keys[k]]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    bucket = (mixed % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    whole = pa.RecordBatch.from_arrays([*g.columns(order), *(pa.array(v) for v in g.values[order].T)], [str(i) for i in range(len(g.keys) + g.values.shape[1])])
    head = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ids, data, held = [], [], 0
    for a, b in zip(head, [*head[1:], len(bucket)], strict=True):
        data.append(_block(whole.slice(a, b - a)))
        ids.append(bucket[a])
        held += len(data[-1])
        if held >= OUT_BYTES:
            yield _rows(ids, data)
            ids, data, held = [], [], 0
    if ids:
        yield _rows(ids, data)


def _block(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=_PACK) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _rows(ids: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(data, pa.binary())], ["bucket", "block"])


def ngrams(lists: list[pa.Array], n: int, pad: int = 0, among: list[pa.Array] | None = None) -> Iterator[Grams]:
    """Folded counts of the n-grams of sentences between their marks, ``pad`` nulls around them; LIMIT n-grams at a time.

    With ``among`` only those whose first words are a row of it.
    """
    sizes = np.concatenate([np.asarray(x.value_lengths()) for x in lists]).astype(np.int64)
    words, [codes] = number([*(x.flatten().cast(_TEXT) for x in lists), pa.array([START, END], _TEXT)], joined=True)
    length = sizes + 2 + 2 * pad
    at = np.cumsum(length) - length
    line = np.full(int(length.sum()), -1, np.int64)
    line[at + pad], line[at + length - 1 - pad] = codes[-2:]
    line[np.repeat(at + pad + 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(codes) - 2)] = codes[:-2]
    each = np.maximum(length - n + 1, 0)
    starts = np.repeat(at - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    asked = None
    if among is not None:
        found = [pc.index_in(x.cast(_TEXT), words) for x in among]
        known = np.logical_and.reduce([np.asarray(f.is_valid()) for f in found])
        asked = packed_key([np.asarray(f.fill_null(0))[known].astype(np.int64) for f in found], len(words))
    for a in range(0, len(starts), LIMIT):
        keys = [line[starts[a : a + LIMIT] + k] for k in range(n)]
        if asked is not None:
            keep = np.isin(packed_key(keys[: len(among)], len(words)), asked)
            keys = [k[keep] for k in keys]
        yield folded(Grams(words, keys, np.ones((len(keys[0]), 1), np.int64)))


def counted(batches: Iterator[pa.RecordBatch], n: int, by: list[int], buckets: int, pad: int = 0, among: list[pa.Array] | None = None) -> Iterator[pa.RecordBatch]:
    """Blocks of the n-grams of a column of arrays of words."""
    held, size, room = [], 0, 0

    def flush() -> Iterator[pa.RecordBatch]:
        for g in ngrams(held, n, pad, among):
            yield from blocks(g, by, buckets)

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b.column(0))
        size, room = size + len(held[-1].flatten()), room + b.nbytes
        if size >= LIMIT or room >= CHUNK_BYTES:
            yield from flush()
            held, size, room = [], 0, 0
    if held:
        yield from flush()


def merged(batches: Iterator[pa.RecordBatch], n: int) -> Grams | None:
    """All blocks of a bucket as one, folded whenever as much has come as is held."""
    whole, parts, rows, size = None, [], 0, 0

    def fold() -> Grams:
        tables = [*([] if whole is None else [[*whole.columns(), *(pa.array(v) for v in whole.values.T)]]), *([*p.columns] for p in parts)]
        words, keys = number([pa.concat_arrays([t[k] for t in tables]) for k in range(n)])
        return folded(Grams(words, keys, np.stack([np.concatenate([np.asarray(t[k]) for t in tables]) for k in range(n, len(tables[0]))], 1)))

    for b in batches:
        for block in b.column(0):
            parts.append(pa.ipc.open_stream(block.as_buffer()).read_next_batch())
            rows, size = rows + parts[-1].num_rows, size + parts[-1].nbytes
            if rows >= max(LIMIT, 0 if whole is None else len(whole)) or size >= max(2 * CHUNK_BYTES, 0 if whole is None else whole.words.nbytes):
                whole = fold()
                parts, rows, size = [], 0, 0
    return fold() if parts else whole


def handed_back(g: Grams, more: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of words and of ``more``, in batches of OUT_BYTES."""
    if not len(g):
        return
    length = np.r_[np.asarray(pc.binary_length(g.words)), 0].astype(np.int64)
    total = np.cumsum(sum(length[k] + 8 for k in g.keys) + 8 * len(more))
    at = 0
    while at < len(g):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + OUT_BYTES)))
        yield pa.RecordBatch.from_arrays([*(c.cast(pa.string()) for c in g.columns(slice(at, to))), *(pa.array(m[at:to]) for m in more)], names)
        at = to


def count_rows(g: Grams, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The words and how often they occur."""
    return handed_back(g, [g.values[:, 0]], names)


def smooth(g: Grams) -> np.ndarray:
    """A4: c / (N(h) + T(h)) of each row; all rows of a history are in one bucket. 1 for rows of one word."""
    c = g.values[:, 0]
    if len(g.keys) == 1:
        return np.ones(len(c))
    first, group = g.group(len(g.keys) - 1)
    return c / (np.add.reduceat(c, first) + np.diff(np.r_[first, len(c)]))[group]


def smoothed_rows(g: Grams, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The words and their probability."""
    return handed_back(g, [smooth(g)], names)


def sum_rows(g: Grams, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The words, their probability and all sums."""
    return handed_back(g, [smooth(g), *g.values.T], names)


def histories(g: Grams) -> Grams:
    """Of padded n-grams by their last words: (history, c, n, t, l): its places, those with a successor, its successors, and how often these occur behind its last words."""
    tail = g.keys[1:]
    _, group = np.unique(packed_key(tail, len(g.words)), return_inverse=True)
    c, follows = g.values[:, 0], g.keys[-1] >= 0
    lower = np.bincount(group, c).astype(np.int64)[group]  # exact: below 2**53
    real = g.keys[0] >= 0
    values = np.stack([c, c * follows, follows.astype(np.int64), lower * follows], 1)[real]
    return folded(Grams(g.words, [k[real] for k in g.keys[:-1]], values))


def reduced(n: int, use: Callable[[Grams], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``use`` of a bucket's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = merged(batches, n)
        if g is not None and len(g):
            yield from use(g)

    return run
