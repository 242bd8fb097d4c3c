"""Vectorised hashing of the words of Arrow string columns, on their byte buffers.

Words are maximal runs of ASCII letters and digits (lower-cased) and of bytes above 127, so any language in UTF-8 is
covered. Prefix sums of a polynomial modulo 2**64 give every word's hash without making a Python string of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15
_SLICE = 1 << 20
_LOWER = np.zeros(256, np.uint8)
for _c in range(256):
    _LOWER[_c] = _c if _c >= 128 else ord(chr(_c).lower()) if chr(_c).isalnum() else 0


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser over uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    def of(b: int) -> np.ndarray:
        p = np.full(_SLICE + 1, b, np.uint64)
        p[0] = 1
        return np.multiply.accumulate(p)

    return of(_BASE), of(pow(_BASE, -1, 1 << 64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets of a string column; a null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and len(column) else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def _slice_words(low: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of lowered bytes; ``cut`` holds the places where a new text starts."""
    word = low != 0
    start = word.copy()
    start[1:] &= ~word[:-1]
    start[cut] |= word[cut]
    s = np.flatnonzero(start)
    end = word.copy()
    end[:-1] &= ~word[1:]
    before = cut[cut > 0] - 1
    end[before] |= word[before]
    e = np.flatnonzero(end) + 1
    power, inverse = _powers()
    total = np.empty(len(low) + 1, np.uint64)
    total[0] = 0
    np.cumsum(low * power[: len(low)], out=total[1:])
    return s, e, mix64((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, text after the last, text number, start, end, hash of every word) by slices of whole texts.

    A text longer than a slice comes alone; its words are hashed by sub-slices that end between words. A word longer
    than a sub-slice is cut there, alike wherever it occurs.
    """
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _SLICE, "right")) - 1)
        to = min(to, n)
        base, stop = int(offsets[at]), int(offsets[to])
        starts, ends, hashes = [], [], []
        p = base
        while p < stop:
            q = min(stop, p + _SLICE)
            low = _LOWER[data[p:q]]
            if q < stop:
                gap = np.flatnonzero(low == 0)
                if len(gap):  # a separator in front alone goes by itself, so that an endless word starts its sub-slice
                    q = p + max(1, int(gap[-1]))
                    low = low[: q - p]
            cut = offsets[at:to] - p
            s, e, h = _slice_words(low, cut[(cut >= 0) & (cut < len(low))])
            starts.append(s + p)
            ends.append(e + p)
            hashes.append(h)
            p = q
        z = np.zeros(0, np.int64)
        s, e = (np.concatenate(x) if x else z for x in (starts, ends))
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        yield at, to, np.searchsorted(offsets[at:to], s, "right") - 1, s, e, h
        at = to


def distinct_per_text(text: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text number, hash) pairs in order; hashes keep their upper 48 bits while the texts are fewer than 2**16."""
    if not len(h):
        return text, h
    if int(text.max()) < 1 << 16:
        key = np.sort((text.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
        keep = np.empty(len(key), bool)
        keep[0] = True
        np.not_equal(key[1:], key[:-1], out=keep[1:])
        key = key[keep]
        return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1)
    order = np.lexsort((h, text))
    text, h = text[order], h[order] >> np.uint64(16)
    keep = np.ones(len(h), bool)
    keep[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    return text[keep], h[keep]
