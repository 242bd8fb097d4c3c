"""Sampled segmentations against enumeration of the lattice, and round trips."""

from __future__ import annotations

import math
import time
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from phonoflow.llm import pieces as P
from phonoflow.session import table


def encode(texts, keys=None, alpha=P.ALPHA, seed=P.SEED):
    voc = P.vocabulary()
    raw = [t.encode() for t in texts]
    offsets = np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
    keys = np.arange(len(texts)) if keys is None else np.asarray(keys)
    ids, count = P.encode_slice(np.frombuffer(b"".join(raw), np.uint8), offsets, keys.astype(np.uint64), voc, seed, alpha)
    return ids, count


def decode(ids, count):
    data, offsets = P.decode_slice(ids, count, P.vocabulary())
    raw = data.tobytes()
    return [raw[a:b].decode() for a, b in zip(offsets, offsets[1:], strict=False)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_round_trip(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    ids, count = encode(texts)
    assert decode(ids, count) == texts


def paths(text: str):
    """All segmentations of the one chunk of a text, with their log weights."""
    voc = P.vocabulary()
    raw = b" " + text.encode()
    words = {w: i for i, w in enumerate(voc.pieces) if w and voc.byte_id[w[0]] != i}
    chars = {raw.decode()[:k].encode().__len__() for k in range(len(raw.decode()) + 1)}
    out = []

    def grow(at: int, ids: tuple, weight: float) -> None:
        if at == len(raw):
            out.append((ids, weight))
            return
        for end in range(at + 1, len(raw) + 1):
            if at in chars and end in chars and raw[at:end] in words:
                i = words[raw[at:end]]
                grow(end, (*ids, i), weight + voc.weight[i])

    grow(0, (), 0.0)
    return out


def test_distribution_of_samples():
    text, n = "lower", 20_000
    every = paths(text)
    total = np.logaddexp.reduce([w for _, w in every])
    want = {ids: math.exp(w - total) for ids, w in every}
    ids, count = encode([text] * n)
    cut = np.r_[0, np.cumsum(count)]
    got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(cut, cut[1:], strict=False))
    assert set(got) <= set(want)
    for k, p in want.items():
        assert abs(got[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_alpha_nears_the_best_path():
    best = max(paths("walking"), key=lambda x: x[1])[0]
    ids, count = encode(["walking"] * 50, alpha=200.0)
    assert (count == len(best)).all()
    assert ids.reshape(50, -1).tolist() == [list(best)] * 50


def test_rows_are_reproducible(spark, sf):
    docs = table(spark, sf, "documents")
    a = {r["doc_id"]: r["pieces"] for r in P.encoded(docs).collect()}
    b = {r["doc_id"]: r["pieces"] for r in P.encoded(docs.repartition(9)).collect()}
    assert a == b
    other = {r["doc_id"]: r["pieces"] for r in P.encoded(docs, seed=P.SEED + 1).collect()}
    assert sum(a[i] != other[i] for i in a) > 0.9 * len(a)


def test_query_round_trip(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").select("doc_id", "text").collect()}
    enc = P.op10_sentencepiece(spark, sf)
    assert {r["doc_id"]: r["text"] for r in P.decoded(enc).collect()} == docs
    assert enc.where("not lossless").count() == 0


def test_odd_rows(odd_docs, no_docs):
    enc = P.encoded(odd_docs)
    rows = enc.collect()
    assert len(rows) == odd_docs.count()
    assert [r["pieces"] for r in rows if r["doc_id"] == 2] == [[]]
    assert [r["pieces"] for r in rows if r["doc_id"] == 1] == [None]
    pair = [r["pieces"] for r in rows if r["doc_id"] == 5]
    assert pair[0] == pair[1]
    back = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in P.decoded(enc).collect())
    assert back == sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in odd_docs.collect())
    assert P.encoded(no_docs).count() == 0
    assert P.decoded(P.encoded(no_docs)).count() == 0


def test_long_chunks_give_the_same_pieces(monkeypatch):
    """Texts without a space, sampled alone and with all chunks at once."""
    rng = np.random.default_rng(9)
    voc = P.vocabulary()
    texts = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 3000)) + " abc " + "漢字かな" * 200, "a" * 2000, "a" * 2000, "\n" + "x1" * 700 + "🙂" * 90]
    data, offsets = P.text_buffers(pa.array(texts))
    keys = np.array([5, 6, 7, 8], np.uint64)
    for alpha in (1.0, 0.3, 40.0):
        alone = P.encode_slice(data, offsets, keys, voc, alpha=alpha)
        with monkeypatch.context() as m:
            m.setattr(P, "LONG_CHUNK", 1 << 40)
            together = P.encode_slice(data, offsets, keys, voc, alpha=alpha)
        assert np.array_equal(alone[0], together[0])
        assert np.array_equal(alone[1], together[1])


def test_endless_texts_take_linear_time(spark):
    """A megabyte without a space is lossless, and no step of the work is done for each byte of it by all chunks."""
    rng = np.random.default_rng(10)
    texts = ["".join(rng.choice(list("ABCDEFGHabcdefgh0123456789+/"), 1_000_000)), "漢" * 300_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    began = time.perf_counter()
    assert [r["lossless"] for r in P.encoded(docs).collect()] == [True, True]
    assert time.perf_counter() - began < 30
