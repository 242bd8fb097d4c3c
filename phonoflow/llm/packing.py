"""4. Best-fit decreasing packing of token sequences, over all documents at once.

Best-fit decreasing never looks at more than the sizes. There are at most ``capacity`` different ones, so it runs on their
histogram: equal bins lie together as an interval of bin numbers at their remaining capacity, a segment tree over the
capacities finds the tightest open one in logarithmic time, and a run of equal documents fills a run of equal bins in one
step. The outcome is that of placing the documents one by one, at any number of them: a list of runs whose length depends
on the capacity alone.

Plan: token counts by one Arrow pass over the texts -> only (doc_id, piece, n_tokens) goes on, so no text is shuffled ->
one range shuffle puts the pieces in the order of placement, which gives each its rank -> the histogram (at most
``capacity`` rows) is packed on the driver -> each piece finds its bin by its rank in the broadcast runs. With ``texts``
the pieces' texts are written first, and joined to their bins by a number of their own, one for one.

A document takes its tokens and one end mark. One longer than a bin is cut into full bins and a rest, so every token is
packed once and none is left out. Result: a row per piece with the bin it lies in and its place there. The texts of a
document's pieces, in order, give the document; a character whose tokens two pieces share goes with the first.

Defined results: a null or empty text is a document of the end mark alone. A null doc_id packs like any other value and
comes first. Repeated rows are packed each. Equal lengths go by doc_id, then by piece; of equally tight bins the oldest is
taken. Texts of any length and kind are counted whole. An empty table gives no row. Other columns aren't looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoflow.llm.tokens import TOKENIZER_DIR, encoding, token_ids
from phonoflow.plans.register import source
from phonoflow.session import bound_batches, cut_lineage, ensure_checkpoint_dir

CAPACITY = 2048


class OpenBins:
    """Open bins by remaining capacity: a segment tree of counts over 0..capacity, and a heap of (first bin, bins) for each value."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << max(0, capacity).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def put(self, left: int, first: int, bins: int) -> None:
        heappush(self.bins[left], (first, bins))
        i = left + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take_tightest(self, size: int) -> tuple[int, int, int] | None:
        """(first bin, bins, their remaining capacity): the oldest of those with the least capacity of at least ``size``."""
        count, i = self.count, size + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up to the first right neighbour that holds a bin
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i *= 2
                if not count[i]:
                    i += 1
        left = i - self.leaves
        first, bins = heappop(self.bins[left])
        while i:
            count[i] -= 1
            i >>= 1
        return first, bins, left


def packed_runs(histogram: list[tuple[int, int]], capacity: int) -> np.ndarray:
    """Best-fit decreasing of (size, pieces of it) as runs x (first rank, first bin, pieces a bin, offset of the first, size); ranks count pieces from the largest."""
    tree, opened, rank = OpenBins(capacity), 0, 0
    runs = []
    for size, n in sorted(histogram, reverse=True):
        while n:
            found = tree.take_tightest(size)
            if found is None:
                found = opened, -(-n // (capacity // size)), capacity
                opened += found[1]
            first, bins, left = found
            each = left // size  # a bin that is the tightest stays so until the size no longer fits
            full = min(bins, n // each)
            rest = n - full * each if full < bins else 0  # less than another bin takes
            for at, many, k in ((first, full, each), (first + full, 1, rest)):
                if many and k:
                    runs.append((rank, at, k, capacity - left, size))
                    rank += many * k
                    if left > k * size:
                        tree.put(left - k * size, at, many)
            n -= full * each + rest
            used = full + (rest > 0)
            if used < bins:
                tree.put(left, first + used, bins - used)
    return np.array(runs, np.int64).reshape(-1, 5)


def places(runs: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of the pieces of the given ranks."""
    if not len(rank):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start, first, each, offset, size = runs[np.searchsorted(runs[:, 0], rank, "right") - 1].T
    nth, place = np.divmod(rank - start, each)
    return first + nth, offset + place * size


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each piece; ``sizes`` descend and are at most ``capacity``."""
    size, n = np.unique(sizes, return_counts=True)
    return places(packed_runs(list(zip(size.tolist(), n.tolist(), strict=True)), capacity), np.arange(len(sizes)))


def _cut_text(text: str, ids: list[int], pieces: int, capacity: int, length: np.ndarray) -> list[str]:
    """The text by pieces of ``capacity`` tokens; cuts inside a character move behind it."""
    raw = text.encode()
    ends = np.cumsum(length[np.array(ids, np.int64)])
    cuts = [0]
    for k in range(1, pieces):
        at = int(ends[k * capacity - 1]) if k * capacity <= len(ids) else len(raw)
        while at < len(raw) and raw[at] & 0xC0 == 0x80:
            at += 1
        cuts.append(at)
    return [raw[a:b].decode() for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True)]


def _pieces(capacity: int, folder: str, texts: bool):
    """Rows (doc_id, text) to (doc_id, piece, n_tokens[, text])."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder)
        length = np.array([len(enc.decode_single_token_bytes(i)) for i in range(enc.n_vocab)], np.int64) if texts else None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                total, parts = np.empty(part.num_rows, np.int64), []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = token_ids(text, folder) if text else []
                    total[i] = len(ids) + 1  # the end mark
                    if texts:
                        parts += _cut_text(text, ids, -(-(len(ids) + 1) // capacity), capacity, length) if len(ids) >= capacity else [text or ""]
                pieces = -(-total // capacity)
                row = np.repeat(np.arange(len(total)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                size = np.minimum(capacity, total[row] - piece * capacity)
                columns = [part.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(size.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.string())] if texts else columns, ["doc_id", "piece", "n_tokens", "text"][: 3 + texts])

    return cut


def packed(docs: DataFrame, capacity: int = CAPACITY, folder: str = TOKENIZER_DIR, texts: bool = False) -> DataFrame:
    """A row per piece: (doc_id, piece, token_start, n_tokens, bin_id, bin_offset), with ``texts`` its text, too."""
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = docs.sparkSession
    bound_batches(spark)
    schema = "doc_id long, piece int, n_tokens int" + (", text string" if texts else "")
    found = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(_pieces(capacity, folder, texts), schema).withColumn("uid", F.monotonically_increasing_id())
    if texts:
        path = f"{ensure_checkpoint_dir(spark)}/pieces-{uuid.uuid4().hex}"
        found.write.parquet(path)
        found = spark.read.parquet(path)
        pieces = found.drop("text")
    else:
        pieces = cut_lineage(found)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("n_tokens").desc(), F.col("doc_id").asc_nulls_first(), F.col("piece"), F.col("uid")]
    # the id holds the partition, above bit 33, and the row's place in it: ranges are in order, so that is the rank
    ranked = cut_lineage(pieces.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    runs = packed_runs([(r[0], r[1]) for r in ranked.groupBy("n_tokens").count().collect()], capacity)
    before = np.zeros(parts + 1, np.int64)
    for part, n in ranked.groupBy(F.shiftright("_at", 33)).count().collect():
        before[part + 1] = n
    # both have a bounded size: runs by the capacity, ranges by the number of partitions
    shared = spark.sparkContext.broadcast((runs, np.cumsum(before)))

    @F.arrow_udf("struct<bin_id: bigint, bin_offset: int>")
    def place(at: pa.Array) -> pa.Array:
        runs, before = shared.value
        at = at.to_numpy()
        bins, offset = places(runs, before[at >> 33] + (at & ((1 << 33) - 1)))
        return pa.StructArray.from_arrays([pa.array(bins), pa.array(offset.astype(np.int32))], ["bin_id", "bin_offset"])

    placed = ranked.withColumn("_place", place("_at"))
    columns = ["doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("token_start"), "n_tokens", F.col("_place.bin_id").alias("bin_id"), F.col("_place.bin_offset").alias("bin_offset")]
    if not texts:
        return placed.select(*columns)
    return placed.select("uid", *columns).join(found.select("uid", "text"), "uid").drop("uid")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in bins of CAPACITY tokens."""
    return packed(source(spark, sf_dir, "documents"))
