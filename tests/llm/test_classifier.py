"""The factorisation machine: its identity, its accuracy on held-out labels, and odd rows."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from phonoflow.llm import classifier as Q
from phonoflow.session import table

BIG = "/root/testdata/sf0.1"


def test_sum_of_squares_identity():
    rng = np.random.default_rng(0)
    fm = Q.FactorisationMachine(0.3, rng.normal(size=Q.DIM).astype(np.float32), rng.normal(0, 0.1, (Q.DIM, Q.RANK)).astype(np.float32))
    for row, index, value, n in Q.features(pa.array(["good words here", "", "one"]), pa.array(["en", None, "de"]), pa.array(["a", "b", None])):
        got = fm.logits(row, index, value, n)
        for r in range(n):
            at = np.flatnonzero(row == r)
            pairs = sum(float(fm.v[index[i]] @ fm.v[index[j]]) * value[i] * value[j] for a, i in enumerate(at) for j in at[a + 1 :])
            assert np.isclose(got[r], 0.3 + (fm.w[index[at]] * value[at]).sum() + pairs, atol=1e-3)


def test_gradients_of_pairs_are_learned():
    """Exclusive or of two features: no linear model has it."""
    rows = [(np.array([a, 2 + b]), np.ones(2, np.float32)) for a in (0, 1) for b in (0, 1)] * 50
    label = np.array([a ^ b for a in (0, 1) for b in (0, 1)] * 50, np.float32)
    fm = Q.fit_rows(rows, label)
    score = [float(fm.logits(np.zeros(2, np.int64), i, v, 1)[0]) for i, v in rows[:4]]
    assert [s > 0 for s in score] == [bool(x) for x in label[:4]]


def test_held_out_accuracy(spark):
    docs, labels = table(spark, BIG, "documents"), table(spark, BIG, "labels")
    model = Q.fit(docs, labels.where("doc_id % 5 <> 0"))
    rest = docs.join(labels.where("doc_id % 5 = 0"), "doc_id")
    got = rest.select("quality", Q.score_column(rest, model).alias("s")).toPandas()
    assert len(got) > 500
    assert ((got["s"] >= 0.5) == (got["quality"] == 1)).mean() > 0.9
    good = got[got["quality"] == 1]
    assert (good["s"] >= Q.THRESHOLD).mean() > 0.95  # clean documents stay


def test_fit_is_reproducible(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    a, b = Q.fit(docs, labels), Q.fit(docs.repartition(7), labels.repartition(3))
    assert a.w0 == b.w0
    assert (a.w == b.w).all()
    assert (a.v == b.v).all()


def test_query_scores_whole_table(spark, sf):
    got = Q.op6_quality_classifier(spark, sf).toPandas()
    docs, labels = table(spark, sf, "documents").toPandas(), table(spark, sf, "labels")
    model = Q.fit(table(spark, sf, "documents"), labels)
    score = model.score(pa.array(docs["text"]), pa.array(docs["lang"]), pa.array(docs["source"])).round(6)
    want = {int(i): s for i, s in zip(docs["doc_id"], score, strict=True) if s >= Q.THRESHOLD}
    assert got.set_index("doc_id")["quality_score"].to_dict() == want


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (6, 0, 1), (None, 1, 0), (5, None, 0), (1, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    model = Q.fit(odd_docs, labels)
    rows = odd_docs.select("doc_id", "text", Q.score_column(odd_docs, model).alias("p")).collect()
    assert all(r["p"] == 0 for r in rows if not r["text"])
    assert all(0 < r["p"] < 1 for r in rows if r["text"])
    assert Q.accepted(odd_docs, labels).columns == odd_docs.columns
    assert Q.accepted(no_docs, labels).count() == 0
    half = Q.fit(odd_docs, labels.limit(0))
    assert {r[0] for r in odd_docs.where(F.col("text") != "").select(Q.score_column(odd_docs.where(F.col("text") != ""), half)).collect()} == {0.5}
    few = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    assert Q.accepted(few, labels).count() == 1  # no lang, no source


def test_texts_under_one_id_have_an_order(spark):
    """A labelled id with many texts is learned from once, and the same whatever the partitions."""
    docs = spark.createDataFrame([(i % 3, f"text number {i} of some words", "en", "s") for i in range(300)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    a, b = Q.fit(docs, labels), Q.fit(docs.orderBy(F.desc("text")).repartition(7), labels)
    assert a.w0 == b.w0
    assert (a.w == b.w).all()
    assert (a.v == b.v).all()


def test_scores_by_the_definition(spark, sf):
    """Every feature and every pair of features of each text, written out anew, under the fitted weights."""
    model = Q.fit(table(spark, sf, "documents"), table(spark, sf, "labels"))
    rows = table(spark, sf, "documents").where("text <> ''").limit(40).toPandas()
    got = model.score(pa.array(rows["text"]), pa.array(rows["lang"]), pa.array(rows["source"]))
    for n, d in enumerate(rows.itertuples()):
        raw = d.text.encode()
        found = re.findall(rb"[A-Za-z0-9\x80-\xff]+", raw)
        low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in found]
        word = lambda w: int(next(iter(Q.words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))))[5][0]) >> 16
        distinct = {word(w) for w in low}
        share = lambda k, of: 0 if not k else int(np.clip(np.floor(-np.log2(max(k / of, 1e-9)) + 1), 1, 12))
        count = lambda chars: sum(c in chars for c in raw)
        size, m = len(raw), max(1, len(low))
        stats = [int(np.log2(size)), int(sum(map(len, low)) / m), int(np.log2(m)), share(count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), size), share(count(b"0123456789"), size), share(count(b"\n"), size), share(count(b"!?"), size), share(count(b"#$%&*+/<=>@[\\]^_`{|}~"), size), int(16 * len(distinct) / m), share(sum(a == b for a, b in zip(low, low[1:], strict=False)), m)]
        stats = [min(15, max(0, x)) for x in stats]
        x = [(w % Q.BUCKETS, 1 / len(distinct) ** 0.5) for w in distinct]
        x += [(Q.BUCKETS + k * 16 + b, 0.5) for k, b in enumerate(stats)]
        x += [(Q.BUCKETS + 160 + k * 512 + zlib.crc32(f"{k}={v}".encode()) % 512, 0.5) for k, v in enumerate((d.lang, d.source))]
        index, value = np.array([i for i, _ in x]), np.array([v for _, v in x])
        v = model.v[index].astype(np.float64) * value[:, None]
        logit = model.w0 + (model.w[index] * value).sum() + sum(float(v[i] @ v[j]) for i in range(len(v)) for j in range(i))
        assert abs(got[n] - 1 / (1 + np.exp(-logit))) < 1e-4


def test_features_beyond_the_drivers_result_size(spark):
    """Long texts of many distinct words: all of their features reach the fit, though together they exceed spark.driver.maxResultSize."""
    docs = spark.range(100, numPartitions=20).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 16000), x -> concat(if(id % 4 = 0, 'bad', 'good'), x + 7 * id))) AS text")
    labels = spark.range(100).selectExpr("id AS doc_id", "int(id % 4 <> 0) AS quality")
    conf, key = spark.sparkContext._jsc.sc().conf(), "spark.driver.maxResultSize"
    before = conf.get(key, "1g")
    conf.set(key, "10m")
    try:
        model = Q.fit(docs, labels)
    finally:
        conf.set(key, before)
    held = pa.array([" ".join(f"{kind}{x}" for x in range(300, 16_300)) for kind in ("bad", "good")])
    bad, good = model.score(held, pa.array([None, None]), pa.array([None, None]))
    assert bad < 0.5 < good


def test_batches_in_pieces_learn_the_same(monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(rng.integers(0, 500, k).astype(np.int32), rng.random(k).astype(np.float32) / k) for k in rng.integers(1, 90, 300)]
    label = (rng.random(300) < 0.6).astype(np.float32)
    whole = Q.fit_rows(rows, label)
    monkeypatch.setattr(Q, "PIECE", 64)
    parts = Q.fit_rows(rows, label)
    assert np.allclose(whole.w, parts.w, atol=1e-3)
    assert np.allclose(whole.v, parts.v, atol=1e-3)
    assert np.isclose(whole.w0, parts.w0, atol=1e-3)
