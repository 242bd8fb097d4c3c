"""6. Quality classifier: a factorisation machine.

Features of a document: its distinct words, hashed (weight 1/sqrt of their number), binned structure statistics, and the
hashed metadata lang and source. The score is w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2): the
sum-of-squares identity makes all pairwise interactions linear in the number of features.

Fitting: on at most MAX_TRAIN_ROWS labelled documents, taken by a hash of the doc_id (a documented bound: the model has a
fixed size, so more rows don't need to reach the driver). Their features are computed by the executors and fetched some
FETCH_BYTES at a time into a temporary file, so the driver's memory doesn't grow with the length of the texts; Adagrad runs in
numpy with a fixed seed, rows in the order of a hash of the doc_id, then of the doc_id, so a fit is reproducible. Scoring: one Arrow pass over whole texts
with the weights broadcast (a fixed 5 MB); no shuffle.

Defined results: a null or empty text scores 0. A null or missing lang or source is the empty string. Labels without
doc_id or quality don't count; of contradicting labels the mean decides. Of different texts under one
labelled doc_id the one with the least hash of text, lang and source is learned from. With no labelled document of either class the
score is 0.5 everywhere. Repeated rows score alike; extra columns stay.
"""

from __future__ import annotations

import math
import mmap
import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phonoflow.llm.hashing import distinct_per_text, mix64, text_buffers, words
from phonoflow.plans.register import source
from phonoflow.session import bound_batches, cut_lineage, table

BUCKETS = 1 << 17
RANK = 8
MAX_TRAIN_ROWS = 20_000
THRESHOLD = 0.5
SEED = 11
#: Bytes of features that the driver fetches at once; a text with more comes alone.
FETCH_BYTES = 4 << 20
#: Features that a step of the fit holds at once; a batch with more is added up in pieces.
PIECE = 1 << 19
_BINS = 16
_STATS = 10
_META = 512
DIM = BUCKETS + _STATS * _BINS + 2 * _META
_FIELD_WEIGHT = 0.5
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_CLASS[list(b"0123456789")] = 2
_CLASS[list(b" \t\r")] = 3
_CLASS[10] = 4
_CLASS[list(b"!?")] = 5
_CLASS[list(b".,;:'\"()-")] = 6
_CLASS[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = 7


def _log_bin(share: np.ndarray) -> np.ndarray:
    """Bins of a share of 0..1: 0 for none, then by halves."""
    return np.where(share > 0, np.clip(np.floor(-np.log2(np.maximum(share, 1e-9)) + 1), 1, 12), 0).astype(np.int64)


def features(text: pa.Array, lang: pa.Array, source: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """By slices of rows: (row, feature, value, rows in the slice), rows from 0 in each slice and ascending."""
    data, offsets = text_buffers(text)
    meta = np.array([[zlib.crc32(f"{k}={v or ''}".encode()) % _META + k * _META for k, v in enumerate(pair)] for pair in zip(lang.to_pylist(), source.to_pylist(), strict=True)], np.int64).reshape(-1, 2)
    for at, to, word_row, start, end, h in words(data, offsets):
        n = to - at
        size = np.diff(offsets[at : to + 1]).astype(np.float64)
        full = np.flatnonzero(size > 0)
        counts = np.zeros((n, 8))
        if len(full):
            kind = _CLASS[data[offsets[at] : offsets[to]]]
            heads = offsets[at + full] - offsets[at]
            for k in range(1, 8):
                counts[full, k] = np.add.reduceat((kind == k).view(np.uint8), heads, dtype=np.int64)
        n_words = np.bincount(word_row, minlength=n).astype(np.float64)
        chars = np.bincount(word_row, weights=end - start, minlength=n)
        runs = np.zeros(n)
        if len(h) > 1:
            runs = np.bincount(word_row[1:], weights=(h[1:] == h[:-1]) & (word_row[1:] == word_row[:-1]), minlength=n)
        row, distinct = distinct_per_text(word_row, h)
        n_distinct = np.bincount(row, minlength=n)
        size, w = np.maximum(size, 1), np.maximum(n_words, 1)
        bins = np.stack([
            np.clip(np.log2(size).astype(np.int64), 0, 15), np.clip((chars / w).astype(np.int64), 0, 15), np.clip(np.log2(w).astype(np.int64), 0, 15),
            _log_bin(counts[:, 1] / size), _log_bin(counts[:, 2] / size), _log_bin(counts[:, 4] / size), _log_bin(counts[:, 5] / size), _log_bin(counts[:, 7] / size),
            np.clip(16 * n_distinct / w, 0, 15).astype(np.int64), _log_bin(runs / w),
        ], axis=1)
        fields = np.concatenate([BUCKETS + np.arange(_STATS) * _BINS + bins, BUCKETS + _STATS * _BINS + meta[at:to]], axis=1)
        k = fields.shape[1]
        rows = np.concatenate([row, np.repeat(np.arange(n), k)])
        index = np.concatenate([(distinct % np.uint64(BUCKETS)).astype(np.int64), fields.ravel()])
        value = np.concatenate([1 / np.sqrt(n_distinct[row]), np.full(n * k, _FIELD_WEIGHT)]).astype(np.float32)
        order = np.argsort(rows, kind="stable")
        yield rows[order], index[order], value[order], n


class FactorisationMachine:
    """Weights of a fitted model; ``w0 is None`` means that there was nothing to fit."""

    def __init__(self, w0: float | None = None, w: np.ndarray | None = None, v: np.ndarray | None = None) -> None:
        self.w0, self.w, self.v = w0, w, v

    def logits(self, row: np.ndarray, index: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        """Scores of n rows in time linear in the features; ``row`` ascends and has every row."""
        head = np.searchsorted(row, np.arange(n))
        vx = self.v[index] * value[:, None]
        total = np.add.reduceat(vx, head, axis=0)
        np.multiply(vx, vx, out=vx)
        pairs = 0.5 * (total * total - np.add.reduceat(vx, head, axis=0)).sum(1)
        return self.w0 + np.add.reduceat(self.w[index] * value, head) + pairs

    def score(self, text: pa.Array, lang: pa.Array, source: pa.Array) -> np.ndarray:
        """Probabilities of good quality."""
        size = np.diff(text_buffers(text)[1])
        if self.w0 is None:
            return np.where(size > 0, 0.5, 0.0)
        parts = [1 / (1 + np.exp(-self.logits(*x).astype(np.float64))) for x in features(text, lang, source)]
        return np.where(size > 0, np.concatenate(parts) if parts else np.zeros(0), 0.0)


def fit_rows(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, rate: float = 0.1, decay: float = 1e-6, batch: int = 256) -> FactorisationMachine:
    """Adagrad on the logistic loss. ``rows`` holds (features, values) of each row."""
    if not len(label) or label.min() == label.max():
        return FactorisationMachine()
    rng = np.random.default_rng(SEED)
    share = label.mean()
    fm = FactorisationMachine(float(np.log(share / (1 - share))), np.zeros(DIM, np.float32), rng.normal(0, 0.05, (DIM, RANK)).astype(np.float32))
    gw, gv, g0 = np.full(DIM, 1e-4, np.float32), np.full((DIM, RANK), 1e-4, np.float32), 1e-4
    sum_w, sum_v = np.zeros(DIM, np.float32), np.zeros((DIM, RANK), np.float32)
    for _ in range(int(np.clip(80_000 / len(label), 4, 40))):
        order = rng.permutation(len(label))
        for at in range(0, len(order), batch):
            ids = order[at : at + batch]

            def gather(piece: list[tuple[int, int, int]], ids=ids) -> tuple[np.ndarray, ...]:
                index, value = (np.concatenate([rows[ids[i]][k][a:b] for i, a, b in piece]) for k in (0, 1))
                size = np.array([b - a for _, a, b in piece])
                who = np.array([i for i, _, _ in piece])
                return index, value, who, np.cumsum(size) - size, np.repeat(who, size), fm.v[index] * value[:, None]

            pieces = _pieces([len(rows[i][0]) for i in ids])
            held = [gather(pieces[0])] if len(pieces) == 1 else None
            total, square, linear = np.zeros((len(ids), RANK), np.float32), np.zeros((len(ids), RANK), np.float32), np.zeros(len(ids), np.float32)
            for index, value, who, head, _, vx in held or map(gather, pieces):
                total[who] += np.add.reduceat(vx, head, axis=0)
                square[who] += np.add.reduceat(vx * vx, head, axis=0)
                linear[who] += np.add.reduceat(fm.w[index] * value, head)
            score = fm.w0 + linear + 0.5 * (total**2 - square).sum(1)
            g = ((1 / (1 + np.exp(-score)) - label[ids]) / len(ids)).astype(np.float32)
            touched = []
            for index, value, _, _, row, vx in held or map(gather, pieces):
                gx = g[row] * value
                by = np.argsort(index, kind="stable")
                first = np.flatnonzero(np.r_[True, np.diff(index[by]) != 0])
                touched.append(index[by][first])
                sum_w[touched[-1]] += np.add.reduceat(gx[by], first)
                sum_v[touched[-1]] += np.add.reduceat((gx[:, None] * (total[row] - vx))[by], first, axis=0)
            at_w = touched[0] if len(touched) == 1 else np.unique(np.concatenate(touched))
            dw = sum_w[at_w] + decay * fm.w[at_w]
            dv = sum_v[at_w] + decay * fm.v[at_w]
            sum_w[at_w], sum_v[at_w] = 0, 0
            gw[at_w] += dw * dw
            gv[at_w] += dv * dv
            fm.w[at_w] -= rate * dw / np.sqrt(gw[at_w])
            fm.v[at_w] -= 0.5 * rate * dv / np.sqrt(gv[at_w])
            g0 += float(g.sum()) ** 2
            fm.w0 -= rate * float(g.sum()) / g0**0.5
    return fm


def _pieces(sizes: list[int]) -> list[list[tuple[int, int, int]]]:
    """(row, from, to) of all features of rows of these sizes, in lists of at most PIECE features."""
    out, room = [[]], PIECE
    for i, size in enumerate(sizes):
        at = 0
        while at < size:
            if not room:
                out.append([])
                room = PIECE
            to = min(size, at + room)
            out[-1].append((i, at, to))
            room -= to - at
            at = to
    return out


def _columns(docs: DataFrame) -> list[Column]:
    return [docs["text"], *(F.coalesce(docs[c].cast("string"), F.lit("")) if c in docs.columns else F.lit("") for c in ("lang", "source"))]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> FactorisationMachine:
    """A model of quality from the labelled documents; at most ``max_rows`` labels are used."""
    bound_batches(docs.sparkSession)
    some = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("_label_id"))
        .agg(F.avg("quality").alias("_label"))
        .orderBy(F.xxhash64("_label_id", F.lit(SEED)), "_label_id")
        .limit(max_rows)
    )
    text, lang, source = _columns(docs)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for row, index, value, n in features(b.column(2), b.column(3), b.column(4)):
                cut = pa.py_buffer((4 * np.searchsorted(row, np.arange(n + 1))).astype(np.int32))
                both = [pa.Array.from_buffers(pa.binary(), n, [None, cut, pa.py_buffer(x)]) for x in (index.astype(np.int32), value)]
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(at, n) for k in range(2)), *both], ["id", "label", "feature", "value"])
                at += n

    # max_rows bounds the broadcast side: 16 bytes a label
    labelled = docs.select(docs["doc_id"].cast("long").alias("_id"), text.alias("_text"), lang.alias("_lang"), source.alias("_source")).where("_text is not null and _text <> ''")
    # one text a label, added up before the shuffle: what reaches the driver is bounded however often an id occurs
    first = F.min(F.struct(F.xxhash64("_text", "_lang", "_source").alias("key"), "_text", "_lang", "_source")).alias("one")
    picked = labelled.join(F.broadcast(some), F.col("_id") == F.col("_label_id")).groupBy("_id", "_label").agg(first).select("_id", "_label", "one._text", "one._lang", "one._source")
    found = cut_lineage(picked.mapInArrow(rows, "id long, label double, feature binary, value binary"))
    n_bytes = found.agg(F.sum(F.length("feature").cast("long") + F.length("value"))).first()[0] or 0
    ids, label, size = [], [], []
    with tempfile.TemporaryFile() as file:
        for i, quality, feature, value in found.repartition(max(1, math.ceil(n_bytes / FETCH_BYTES)), "id").toLocalIterator():
            file.write(feature)
            file.write(value)
            ids.append(i)
            label.append(quality)
            size.append(len(feature) // 4)
        if not ids:
            return FactorisationMachine()
        file.flush()
        raw = np.frombuffer(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ), np.int32)
    start = 2 * (np.cumsum(size) - size)
    ids = np.array(ids, np.int64)
    order = np.lexsort((ids, mix64(ids.view(np.uint64))))
    data = [(raw[start[i] : start[i] + size[i]], raw[start[i] + size[i] : start[i] + 2 * size[i]].view(np.float32)) for i in order]
    return fit_rows(data, (np.array(label)[order] >= 0.5).astype(np.float32))


def score_column(docs: DataFrame, model: FactorisationMachine) -> Column:
    """The score as a column of ``docs``."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(text: pa.Array, lang: pa.Array, source: pa.Array) -> pa.Array:
        return pa.array(shared.value.score(text, lang, source))

    return score(*_columns(docs))


def accepted_by(docs: DataFrame, model: FactorisationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score, rounded to six places, is at least ``threshold``; columns as they were."""
    return docs.where(F.round(score_column(docs, model), 6) >= threshold)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """:func:`accepted_by` a model fitted on the labelled ones among ``docs``."""
    return accepted_by(docs, fit(docs, labels, max_rows), threshold)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted documents with their scores."""
    docs = source(spark, sf_dir, "documents")
    score = score_column(docs, fit(docs, table(spark, sf_dir, "labels")))
    return docs.select("doc_id", F.round(score, 6).alias("quality_score")).where(F.col("quality_score") >= THRESHOLD)
