"""Quality rules: the cascade against all rules at once, and against SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonoflow.llm import rules as R
from phonoflow.session import table


def test_query_against_sql(spark, sf, duck, same_rows):
    same_rows(R.op7_quality_rules(spark, sf), duck.execute(R.ORACLE).df())


def test_order_changes_no_result(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    kept = [{r["doc_id"] for r in docs.where(R.keep_expression(F.col("text"), o)).collect()} for o in (R.RULES, R.RULES[::-1])]
    every = docs.select("doc_id", R.bound(F.col("text"), lambda d: F.array(*[r.rejects(d) for r in R.RULES])).alias("x"))
    brute = {r["doc_id"] for r in every.collect() if not any(r["x"])}
    assert kept[0] == kept[1] == brute
    assert 0 < len(brute) < docs.count()


def test_order_is_by_rejection_per_cost(spark):
    docs = spark.createDataFrame([("plain words that are fine " * 3,)] * 50 + [("AAAA BBBB CCCC DDDD",)] * 50, "text string")
    got = R.estimate(docs)
    assert {r.name for r, _, _ in got} == {r.name for r in R.RULES}
    assert got[0][0].name == "capitals"
    assert abs(got[0][2] - 0.5) < 0.05
    assert all(share == 0 for _, _, share in got[1:])


def test_every_rule(spark):
    good = "A plain sentence with some common words in it, and nothing else that is odd about it at all. " * 3
    bad = {
        "no_words": " \n\t ", "word_length": "a b c d e f g", "symbols": "some ## %% text && with ** many ~~ signs", "exclamations": "what! is! this! now!",
        "capitals": "THIS IS ALL IN CAPITALS", "words_without_letters": good + "12 34 " * 40, "word_runs": good + "again " * 40,
        "few_distinct_words": "one two three " * 30, "repeated_lines": "a line of text\n" * 6 + "another one", "endless_word": good + "x" * 1001,
    }
    assert set(bad) == {r.name for r in R.RULES}
    for name, text in bad.items():
        df = spark.createDataFrame([(text,), (good,)], "text string")
        rule = next(r for r in R.RULES if r.name == name)
        assert [r[0] for r in df.select(R.bound(F.col("text"), rule.rejects)).collect()] == [True, False], name
        assert df.where(R.keep_expression(F.col("text"), R.RULES)).count() == 1


def test_odd_rows(odd_docs, no_docs):
    got = R.accepted(odd_docs)
    assert got.columns == odd_docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == [4, 5, 5, 6]
    assert ids.count(None) == 1
    assert R.accepted(no_docs).count() == 0
