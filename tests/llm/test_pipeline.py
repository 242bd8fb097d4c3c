"""The pipeline against its stages done one by one on the driver."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as C
from phonoflow.llm import classifier, packing, rules, secret_scan, simhash
from phonoflow.session import table


def test_stages(spark, sf):
    assert [n for n, _ in C.STAGES] == ["quality rules", "quality classifier", "near duplicates", "secret scans", "best-fit packing"]
    got = C.run(spark, sf).toPandas()
    docs = table(spark, sf, "documents")
    pdf = docs.where(~F.exists(rules.bound(F.col("text"), lambda d: F.array(*[r.rejects(d) for r in rules.RULES])), lambda x: x)).toPandas()
    model = classifier.fit(docs, table(spark, sf, "labels"))
    pdf = pdf[model.score(pa.array(pdf["text"]), pa.array(pdf["lang"]), pa.array(pdf["source"])).round(6) >= classifier.THRESHOLD].reset_index(drop=True)
    sig = np.frombuffer(b"".join(simhash.signatures(pa.array(pdf["text"])).to_pylist()), np.uint64).reshape(len(pdf), -1)
    near = np.bitwise_count(sig[:, None] ^ sig[None]).sum(2) <= simhash.RADIUS
    root = np.arange(len(pdf))
    for _ in range(len(pdf)):
        new = np.array([root[near[i]].min() for i in range(len(pdf))])
        if (new == root).all():
            break
        root = new
    first = {r: pdf["doc_id"][root == r].min() for r in set(root)}
    kept = pdf[[pdf["doc_id"][i] == first[root[i]] for i in range(len(pdf))]]
    missed = set(got["doc_id"]) - set(kept["doc_id"])
    assert set(kept["doc_id"]) <= set(got["doc_id"])
    assert len(missed) <= 0.05 * max(1, len(pdf) - len(kept))  # the search for copies is approximate
    enc = packing.encoding()
    for d in kept.itertuples():
        text, at = "", 0
        for a, n, _ in secret_scan.secrets_in(d.text):
            text += d.text[at:a] + secret_scan.MASK
            at = a + n
        text += d.text[at:]
        rows = got[got["doc_id"] == d.doc_id].sort_values("piece")
        assert "".join(rows["text"]) == text
        assert rows["n_tokens"].sum() == len(enc.encode_ordinary(text)) + 1


def test_every_decision_takes_effect(spark, tmp_path):
    """Each stage rejects or changes what it should, on documents made for it, and leaves the clean ones."""
    rng = np.random.default_rng(3)
    vocabulary = ["river", "garden", "window", "letter", "summer", "market", "bridge", "forest", "silver", "winter", "music", "paper", "stone", "light", "water", "house"]
    own = lambda: ["".join(rng.choice(list("abcdefghilmnoprstu"), 6)) for _ in range(60)]
    clean = [" ".join(rng.permutation([*rng.choice(vocabulary, 20), *own()])) + "." for _ in range(121)]
    bad = [" ".join(rng.choice(["buy", "cheap", "pills", "casino", "bonus", "click", "offer", "winner"], 15)) for _ in range(60)]  # passes the rules: words, no runs
    secret = "q8Zk3vX0pLw7Tn5Rb2Yd9Hc4"
    rows = [(i, t, "en", "s") for i, t in enumerate(clean[:120] + bad)]
    rows += [(1000, clean[0], "en", "s"), (1001, "#### $$$$ %%%% @@@@ ^^^^ ~~~~", "en", "s"), (1002, clean[120][:-1] + f" token = {secret} kept", "en", "s"), (1003, None, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(100)] + [(i, 0, 0) for i in range(120, 170)]  # the last 20 clean and 10 bad ones have none
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, counts, last = table(spark, str(tmp_path), "documents"), [], None
    for k, (_, stage) in enumerate(C.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = last = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
    ids = [{r[0] for r in spark.read.parquet(f"{tmp_path}/{k}").select("doc_id").collect()} for k in range(5)]
    assert ids[0] == {r[0] for r in rows} - {1001, 1003}
    assert ids[1] == ids[0] - set(range(120, 180))
    assert 1000 not in ids[2]
    assert ids[2] >= set(range(120))
    assert ids[2] == ids[3] == ids[4]
    assert last.where(F.col("text").contains(secret)).count() == 0
    assert last.where(F.col("text").contains(secret_scan.MASK)).count() == 1
    assert {r["doc_id"]: r["text"] for r in last.collect()}[5] == clean[5]


def test_stages_keep_columns_and_stand_odd_rows(spark, sf, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        now = docs
        for _, stage in C.STAGES[:-1]:
            now = stage(spark, now, sf)
            assert now.columns == docs.columns
        assert C.STAGES[-1][1](spark, now, sf).count() >= (1 if docs is odd_docs else 0)
