"""Chat formatting against a loop over turns, and against SQL."""

from __future__ import annotations

import time
from itertools import groupby

from pyspark.sql import functions as F

from phonoflow.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, turns string, m int"
ROWS = [
    (1, 2, "assistant", "b", None, None), (1, 1, "user", "a", "x", 1), (1, 3, "assistant", "c\nd", None, None), (1, 4, None, "e", None, None),
    (2, 1, "user", "", None, None), (2, 2, "user", None, None, None), (3, None, "system", "s", None, None), (3, 0, "user", "u", None, None),
    (None, 1, "user", "lost", None, None), (4, 1, "user", "z", None, None), (4, 1, "assistant", "z", None, None), (4, 1, "user", "a", None, None),
    (5, 1, "user", "twice", None, None), (5, 1, "user", "twice", "other", 2), (6, 1, "user", "l" * 300_000, None, None),
]


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows} - {None}:
        turns = {(r[1], r[2] or "user", r[3]) for r in rows if r[0] == conv and r[3]}
        turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        runs = [(role, "\n".join(t[2] for t in g)) for role, g in groupby(turns, lambda t: t[1])]
        if runs:
            out[conv] = (len(runs), "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in runs))
    return out


def test_against_a_loop(spark):
    got = C.formatted(spark.createDataFrame(ROWS, SCHEMA))
    assert {r["conv_id"]: (r["n_turns"], r["text"]) for r in got.collect()} == brute(ROWS)
    assert C.formatted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_conversation(spark):
    rows = [(1, i, "user" if (i // 3) % 2 else "assistant", f"t{i}", None, None) for i in range(3000)]
    got = C.formatted(spark.createDataFrame(rows, SCHEMA).repartition(5)).first()
    assert (got["n_turns"], got["text"]) == brute(rows)[1]


def test_work_is_linear(spark):
    """A hundred thousand turns of changing roles, and as many of one role, each twice."""
    for role in (lambda i: "user" if i % 2 else "assistant", lambda i: "user"):
        rows = spark.range(100_000).selectExpr("1L AS conv_id", "CAST(id AS INT) AS turn", "concat('t', id) AS text", "explode(array(0, 1)) AS copy")
        rows = rows.withColumn("role", F.when(F.col("turn") % 2 == 1, "user").otherwise("assistant") if role(0) == "assistant" else F.lit("user"))
        began = time.perf_counter()
        got = C.formatted(rows).first()
        assert time.perf_counter() - began < 20
        want = brute([(1, i, role(i), f"t{i}") for i in range(100_000)])[1]
        assert (got["n_turns"], got["text"]) == want


def test_query_against_sql(spark, sf, duck, same_rows):
    same_rows(C.op3_chat_formatting(spark, sf), duck.execute(C.ORACLE).df())
