"""Documents with everything that the operators have to stand."""

from __future__ import annotations

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, sig string, shard int, key string, score double, label string, n_tokens long, start int, host string, _label_id long, _dropped_id long"
#: a very long text of distinct words
LONG = " ".join(f"wort{i} haus" for i in range(40_000))


def doc(i, text, lang="en", source="s", **more):
    return (i, text, lang, source, None if text is None else len(text), *[more.get(c) for c in ("id", "sig", "shard", "key", "score", "label", "n_tokens", "start", "host", "_label_id", "_dropped_id")])


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns whose names clash."""
    same = "the quick brown fox jumps over the lazy dog near the river bank today"
    rows = [doc(1, None), doc(2, ""), doc(3, "   \n "), doc(None, "a text without an id"), doc(4, same), doc(5, same), doc(5, same), doc(6, LONG), doc(7, "!!!"), doc(8, "x", None, None), doc(9, same.upper(), id="q", sig="s", shard=3, key="k", score=1.0, label="l", n_tokens=5, start=1, host="h", _label_id=4, _dropped_id=9), (None,) * 16]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
