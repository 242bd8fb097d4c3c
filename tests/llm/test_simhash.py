"""Near-dedup against brute force over all pairs of signatures."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phonoflow.llm import simhash as S
from phonoflow.session import table


def distances(sig: np.ndarray) -> np.ndarray:
    return np.bitwise_count(sig[:, None, :] ^ sig[None, :, :]).sum(2)


def groups(n: int, pairs) -> set[frozenset[int]]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root[find(int(a))] = find(int(b))
    out: dict[int, set[int]] = {}
    for i in range(n):
        out.setdefault(find(i), set()).add(i)
    return {frozenset(g) for g in out.values() if len(g) > 1}


def clustered(n: int, centers: int, flips: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2, (centers, S.BITS), dtype=np.uint8)
    bits = base[rng.integers(0, centers, n)]
    for row in bits:
        row[rng.choice(S.BITS, rng.integers(0, flips + 1), replace=False)] ^= 1
    return np.packbits(bits, axis=1).view(np.uint64)


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 200), st.integers(1, 40), st.integers(0, 2**32 - 1), st.sampled_from([0, 1, 31, 46, 64, 100]))
def test_bit_planes_count_distances(n, queries, seed, radius):
    sig = clustered(n, max(1, n // 4), 60, seed)
    query = np.unpackbits(sig[: min(queries, n)].view(np.uint8).reshape(-1, 32), axis=1).T * np.uint64(2**64 - 1)
    mask = S.near_blocks(S.planes(sig), query, radius)
    got = np.unpackbits(mask.view(np.uint8), axis=1, bitorder="little")[:, :n].astype(bool)
    assert (got == (distances(sig)[: min(queries, n)] <= radius)).all()


@pytest.mark.parametrize(("n", "centers", "flips"), [(2, 1, 3), (60, 9, 20), (500, 90, 26), (2500, 3, 20), (2300, 700, 24)])
def test_forest_has_the_components_of_all_pairs(n, centers, flips):
    sig = clustered(n, centers, flips, n)
    edges = S.spanning_edges(sig, S.RADIUS)
    d = np.triu(distances(sig) <= S.RADIUS, 1)
    assert all(d[min(e), max(e)] for e in edges)
    assert groups(n, edges) == groups(n, np.argwhere(d))
    assert len(edges) == sum(len(g) - 1 for g in groups(n, edges))


def test_majority_bits_by_counting():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**63, 3000).astype(np.uint64)
    text = np.sort(rng.integers(0, 5, 3000))
    got = S.majority_bits(text, h, 6)
    for t in range(6):
        for w in range(S.BITS // 64):
            bits = np.unpackbits(S.mix64(h[text == t] + S._SEEDS[w]).view(np.uint8).reshape(-1, 8), axis=1)
            want = np.packbits(2 * bits.astype(int).sum(0) > len(bits)).view(np.uint64)[0] if len(bits) else 0
            assert got[t, w] == want


def test_components_are_those_of_a_union_find(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(150)] + [(400, x) for x in range(401, 460)]
    pairs = [(min(p), max(p)) for p in pairs if p[0] != p[1]]
    got = S.components(spark.createDataFrame(pairs + pairs[:5], "a long, b long")).collect()
    want = {(x, min(g)) for g in groups(500, pairs) for x in g if x != min(g)}
    assert {(r["node"], r["root"]) for r in got} - {(r["root"], r["root"]) for r in got} == want


def test_planted_copies_and_nothing_else(spark):
    """Exact and near copies are met with the brute force over all signatures as the bound."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(60, 300))) for _ in range(150)]
    rows, group = [], {}
    for i, t in enumerate(texts):
        rows.append((10 * i, t))
        for c in range(i % 4):
            w = t.split(" ")
            for _ in range(len(w) // 40 if c else 0):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((10 * i + c + 1, " ".join(w)))
            group[10 * i + c + 1] = 10 * i
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["duplicate_of"] for r in S.near_duplicates(docs).collect()}
    sig = np.frombuffer(b"".join(S.signatures(pa.array([t for _, t in rows])).to_pylist()), np.uint64).reshape(len(rows), -1)
    brute = {}
    for g in groups(len(rows), np.argwhere(np.triu(distances(sig) <= S.RADIUS, 1))):
        ids = sorted(rows[i][0] for i in g)
        brute |= {x: ids[0] for x in ids[1:]}
    assert got == brute == group
    kept = S.one_of_each_group(docs).collect()
    assert sorted(r["doc_id"] for r in kept) == [10 * i for i in range(150)]


def test_whole_table_recall(spark, sf):
    """On the given documents: no false pair, and at least 0.95 of the copies that brute force over all pairs names."""
    docs = table(spark, sf, "documents")
    pdf = docs.select("doc_id", "text").toPandas()
    pdf = pdf[pdf["text"].fillna("") != ""].reset_index(drop=True)
    sig = np.frombuffer(b"".join(S.signatures(pa.array(pdf["text"])).to_pylist()), np.uint64).reshape(len(pdf), -1)
    brute = {int(pdf["doc_id"][x]) for g in groups(len(pdf), np.argwhere(np.triu(distances(sig) <= S.RADIUS, 1))) for x in sorted(g, key=lambda i: pdf["doc_id"][i])[1:]}
    got = {r["doc_id"] for r in S.op1_simhash_near_dedup(spark, sf).collect()}
    assert got <= brute
    assert len(got) >= 0.95 * len(brute)


def test_odd_rows(odd_docs, no_docs):
    got = {(r["doc_id"], r["duplicate_of"]) for r in S.near_duplicates(odd_docs).collect()}
    assert got == {(5, 4), (9, 4)}  # letter case isn't looked at
    kept = S.one_of_each_group(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 6, 7, 8]
    assert ids.count(None) == 2
    assert S.near_duplicates(no_docs).count() == 0
    assert S.one_of_each_group(no_docs).count() == 0


def test_one_id_with_two_texts_goes_or_stays_whole(spark):
    t = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, t), (2, "another text that has nothing in common with it at all"), (2, t), (3, "x y z"), (3, "x y z"), (3, "w")], "doc_id int, text string")
    assert sorted((r["doc_id"], r["text"]) for r in S.one_of_each_group(docs).collect()) == [(1, t), (3, "w"), (3, "x y z")]


def test_endless_words_are_cut_alike():
    """A word beyond a sub-slice has the same hashes at a text's start, behind a separator and behind other words."""
    from phonoflow.llm.hashing import text_buffers, words

    long = "ab" * 1_300_000

    def hashes(text):
        return [int(h) for *_, part in words(*text_buffers(pa.array([text]))) for h in part]

    alone = hashes(long)
    assert len(alone) == 3
    assert hashes(f" {long}") == alone
    assert hashes(f"some words {long}")[2:] == alone
    assert hashes(f"some words {long} behind")[2:-1] == alone


@pytest.mark.parametrize("radius", [0, 1, 14, 15, 16, 46, 70])
def test_exact_pass_has_all_pairs(radius):
    sig = clustered(400, 60, 40, radius)
    near = distances(sig) <= radius
    got = {(min(i, j), max(i, j)) for x, y in S.close_pairs(sig, None, radius) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert got == {(int(i), int(j)) for i, j in np.argwhere(np.triu(near, 1))}
    got = {(i, j) for x, y in S.close_pairs(sig[:150], sig[150:], radius) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert got == {(int(i), int(j)) for i, j in np.argwhere(near[:150, 150:])}


@pytest.mark.parametrize(("block", "large"), [(1 << 19, 4096), (90, 4096), (90, 5), (1 << 19, 5)])
def test_links_of_roots_over_blocks(spark, monkeypatch, block, large):
    """Signatures of which half have a root in common, in one block and many, with large components and without."""
    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "LARGE", large)
    sig = clustered(300, 40, 36, 8)
    near = np.triu(distances(sig) <= S.RADIUS, 1)
    known = groups(300, np.argwhere(near & (np.random.default_rng(1).random(near.shape) < 0.05)))
    root = np.arange(300)
    for g in known:
        root[list(g)] = min(g)
    want = {tuple(sorted((int(root[i]), int(root[j])))) for i, j in np.argwhere(near) if root[i] != root[j]}
    late = np.zeros(300, bool)
    assert {tuple(x) for x in S.linked_roots(sig, root, late, S.RADIUS).tolist()} == want
    rows = spark.createDataFrame([(bytearray(x.tobytes()), int(r)) for x, r in zip(sig, root, strict=True)], "sig binary, root long")
    assert {(r["a"], r["b"]) for r in S.missed_links(rows, S.RADIUS).collect()} == want


def test_what_the_tables_miss_is_found(spark, sf):
    """With one table only, as at the default, the groups are those of all pairs of signatures."""
    docs = table(spark, sf, "documents")
    pdf = docs.where("text <> ''").select("doc_id", "text").toPandas()
    sig = np.frombuffer(b"".join(S.signatures(pa.array(pdf["text"])).to_pylist()), np.uint64).reshape(len(pdf), -1)
    radius = 80  # more pairs at the edge than the default has on so few rows
    want = {}
    for g in groups(len(pdf), np.argwhere(np.triu(distances(sig) <= radius, 1))):
        ids = sorted(int(pdf["doc_id"][i]) for i in g)
        want |= {x: ids[0] for x in ids[1:]}
    got = {r["doc_id"]: r["duplicate_of"] for r in S.near_duplicates(docs, radius, recall=0.01).collect()}
    assert got == want
