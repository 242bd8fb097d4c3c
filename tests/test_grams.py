"""N-grams in packed blocks, against counting by hand."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from phonoflow.functions import grams as G
from phonoflow.operators import lm

LINES = [["a", "b", "a", "b", "c"], [], ["</s>", "<s>", "a"], ["語"], ["a", "b"], ["b" * 3000, "", "a", "b"]]


def plain(n, lines=LINES):
    return Counter(tuple(w[i : i + n]) for x in lines if x for w in [["<s>", *x, "</s>"]] for i in range(len(w) - n + 1))


@pytest.fixture(scope="module")
def sentences(spark):
    return spark.createDataFrame([(x,) for x in LINES] + [(None,)], "words array<string>").repartition(3)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_counts_take_one_exchange_of_blocks(sentences, n):
    got = lm.counts(sentences, n)
    assert {tuple(r[:-1]): r["c"] for r in got.collect()} == dict(plain(n))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan


def test_pieces_and_chunks(monkeypatch):
    """A sentence longer than a chunk, keys beyond 62 bits, merging in steps."""
    monkeypatch.setattr(G, "LIMIT", 7)
    monkeypatch.setattr(G, "OUT_BYTES", 300)
    lines = [[str(i % 5) for i in range(100)], ["x"] * 30, []]
    made = list(G.counted(iter([pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.string()))], ["w"]) for x in lines if x]), 3, [0, 1, 2], 1))
    assert len(made) > 1
    g = G.merged(iter([pa.RecordBatch.from_arrays([m.column(1)], ["block"]) for m in made]), 3)
    rows = pa.Table.from_batches(list(G.count_rows(g, ["a", "b", "c", "n"]))).to_pylist()
    assert {(r["a"], r["b"], r["c"]): r["n"] for r in rows} == dict(plain(3, lines))
    keys = [np.array([5, 1, 5]), np.array([2, 2, 2]), np.array([-1, 7, 3])]
    assert np.argsort(G.packed_key(keys, 1 << 40)).tolist() == [1, 0, 2]


def totals(n):
    """By history of n - 1 words: how often it has a successor, and how many."""
    every, kinds = Counter(), Counter()
    for g, c in plain(n).items():
        every[g[:-1]] += c
        kinds[g[:-1]] += 1
    return every, kinds


@pytest.mark.parametrize("n", [2, 3])
def test_smoothing_takes_one_exchange_of_blocks(spark, sentences, n):
    every, kinds = totals(n)
    want = {g: c / (every[g[:-1]] + kinds[g[:-1]]) for g, c in plain(n).items()}
    got = lm.smoothed(sentences, n)
    assert {tuple(r[:-1]): r["p"] for r in got.collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    asked = spark.createDataFrame([("a", "b")[: n - 1], ("<s>", "a")[: n - 1], ("no", "such")[: n - 1]], ["w1", "w2"][: n - 1])
    some = {g: p for g, p in want.items() if g[:-1] in {("a", "b")[: n - 1], ("<s>", "a")[: n - 1]}}
    assert {tuple(r[:-1]): r["p"] for r in lm.smoothed(sentences, n, among=asked).collect()} == some


@pytest.mark.parametrize("n", [1, 2])
def test_history_sums(sentences, n):
    at, low, high = plain(n), plain(n), plain(n + 1)
    every, kinds = totals(n + 1)
    want = {h: (at[h], every[h], kinds[h], sum(low[g[1:]] for g in high if g[:-1] == h)) for h in at}
    got = lm.history_sums(sentences, n).collect()
    assert {tuple(r[:n]): tuple(r[-4:]) for r in got} == want
    if n == 2:
        assert {tuple(r[:n]): r["p"] for r in got} == {tuple(r[:n]): r["p"] for r in lm.smoothed(sentences, 2).collect()}


def test_a_whole_model_keeps_no_ngrams(spark, sentences):
    """Nothing but the table of single words is written; the pairs and triples of a model are counted where they are used."""
    plan = lm.arpa_rows(lm.build(sentences.select("words"), 3))._jdf.queryExecution().optimizedPlan()
    leaves = [plan.collectLeaves().apply(i).toString() for i in range(plan.collectLeaves().size())]
    assert not any(w in leaf for leaf in leaves for w in ("w2", "w3", "_d")), leaves
    assert sum("w1" in leaf for leaf in leaves) <= 2, leaves


def test_lines_of_a_file_are_made_once(spark, sentences):
    """Counting the lines and sorting them read a written table; n-grams are not counted anew for each."""
    from phonoflow.sources.writers import arpa_lines

    plan = arpa_lines(lm.build(sentences.select("words"), 2))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Relation" in plan


def test_what_is_asked_for_is_written_and_nothing_else(spark, sentences):
    """The pruned model has the values of the whole one, from tables that hold the asked histories alone."""
    q = spark.createDataFrame([(None, "<s>", "a"), ("<s>", "a", "b"), ("a", "b", "c")], "h2 string, h1 string, w string")
    whole, some = lm.build(sentences, 3), lm.build(sentences, 3, queries=q)
    rows = lambda m: [tuple(r) for r in lm.scored(lm.natural(m), q).orderBy("w").collect()]
    assert all(a[:3] == b[:3] and a[3] == pytest.approx(b[3]) for a, b in zip(rows(some), rows(whole), strict=True))
    assert {r["h"] for r in some.bi.select("h").collect()} == {"<s>", "a", "b"}
    assert "Relation" in some.tri._jdf.queryExecution().optimizedPlan().toString()
