"""Packing against best-fit decreasing by scanning all open bins."""

from __future__ import annotations

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phonoflow.llm import packing as B
from phonoflow.llm.tokens import encoding, token_ids


def brute(sizes, capacity):
    left, bins, offsets = [], [], []
    for s in sizes:
        fits = [(x, b) for b, x in enumerate(left) if x >= s]
        if fits:
            b = min(fits)[1]
        else:
            b = len(left)
            left.append(capacity)
        bins.append(b)
        offsets.append(capacity - left[b])
        left[b] -= s
    return bins, offsets


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.lists(st.integers(1, 70), max_size=120))
def test_segment_tree_finds_the_tightest_bin(capacity, sizes):
    sizes = sorted((min(s, capacity) for s in sizes), reverse=True)
    got = B.best_fit_decreasing(np.array(sizes, np.int64), capacity)
    assert (got[0].tolist(), got[1].tolist()) == brute(sizes, capacity)


def check(docs, packed, capacity):
    """Every token of every row lies in one bin once; bins don't overflow or overlap."""
    enc = encoding()
    want = sorted(((d["doc_id"] is None, d["doc_id"] or 0), len(enc.encode_ordinary(d["text"] or "")) + 1) for d in docs.collect())
    rows = packed.collect()
    total = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["n_tokens"]
        assert r["token_start"] == r["piece"] * capacity
    tokens = {}
    for (null, i), n in want:
        tokens[None if null else i] = tokens.get(None if null else i, 0) + n
    assert total == tokens
    bins = {}
    for r in rows:
        bins.setdefault(r["bin_id"], []).append((r["bin_offset"], r["n_tokens"]))
    for parts in bins.values():
        parts.sort()
        assert parts[0][0] == 0
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False))
        assert sum(n for _, n in parts) <= capacity
    return bins


def test_odd_rows(odd_docs, no_docs):
    bins = check(odd_docs, B.packed(odd_docs, 64), 64)
    assert len(bins) > 1000  # the long text fills many
    assert B.packed(no_docs).count() == 0


def test_whole_table_against_brute_force(spark, sf):
    from phonoflow.session import table

    docs = table(spark, sf, "documents")
    got = B.op4_best_fit_packing(spark, sf)
    check(docs, got, B.CAPACITY)
    rows = sorted(got.collect(), key=lambda r: (-r["n_tokens"], r["doc_id"], r["piece"]))
    assert [r["bin_id"] for r in rows] == brute([r["n_tokens"] for r in rows], B.CAPACITY)[0]


def pure_bpe(raw):
    """Tokens of one piece by the definition: the pair of the lowest rank is merged wherever it stands, from the left."""
    ranks = encoding()._mergeable_ranks
    parts = [bytes([b]) for b in raw]
    while len(parts) > 1:
        rank, pair = min((ranks.get(a + b, 1 << 30), (a, b)) for a, b in set(zip(parts, parts[1:], strict=False)))
        if rank == 1 << 30:
            break
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return [ranks[p] for p in parts]


@pytest.mark.parametrize("char", [" ", "x", "\n"])
def test_endless_runs(spark, char):
    """Five million of one character, at the end and before a word."""
    n = 5_000_000
    alone, before = pure_bpe(char.encode() * n), pure_bpe(char.encode() * (n - 1))
    assert token_ids(char * n) == alone
    if char != "x":
        assert token_ids("a" + char * n + "word here") == encoding().encode_ordinary("a") + before + encoding().encode_ordinary(char + "word here")
    docs = spark.createDataFrame([(1, char * n), (2, None)], "doc_id long, text string")
    got = B.packed(docs, texts=True)
    assert {r["doc_id"]: r["n"] for r in got.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()} == {1: len(alone) + 1, 2: 1}
    assert "".join(r["text"] for r in got.where("doc_id = 1").orderBy("piece").collect()) == char * n


@given(st.text(alphabet="a b\n\t\u00a0\u2028x'1!é", max_size=60))
def test_long_runs_apart_give_the_same_tokens(text):
    from phonoflow.llm import tokens

    limit, pattern = tokens.LONG_RUN, tokens._LONG_SPACE
    tokens.LONG_RUN, tokens._LONG_SPACE = 0, re.compile(pattern.pattern.replace("50000", "2"))
    try:
        assert token_ids(text) == encoding().encode_ordinary(text)
    finally:
        tokens.LONG_RUN, tokens._LONG_SPACE = limit, pattern


def test_texts_of_pieces_give_the_documents(spark, odd_docs, no_docs):
    rows = [(i, t) for i, t in enumerate(["漢字かな交じり文🙂" * 40, "ä" * 500, "word " * 300, "", None])] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    for capacity in (5, 64):
        got = B.packed(docs, capacity, texts=True)
        check(docs, got.drop("text"), capacity)
        by = {}
        for r in got.orderBy("doc_id", "piece").collect():
            by.setdefault((r["doc_id"], r["piece"]), []).append(r["text"])
        for i, text in rows:
            parts = [by[i, k] for k in range(max(k for j, k in by if j == i) + 1)] if i in (0, 1, 2, 4) else []
            if i in (0, 2):  # ids that no other text has
                assert "".join(p[0] for p in parts) == text
    assert B.packed(no_docs, texts=True).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 300), st.lists(st.tuples(st.integers(1, 300), st.integers(1, 40)), max_size=30))
def test_runs_of_equal_sizes(capacity, sizes):
    sizes = sorted((min(s, capacity) for s, n in sizes for _ in range(n)), reverse=True)
    got = B.best_fit_decreasing(np.array(sizes, np.int64), capacity)
    assert (got[0].tolist(), got[1].tolist()) == brute(sizes, capacity)
