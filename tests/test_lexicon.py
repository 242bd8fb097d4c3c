"""Dictionary lookups against joins by hand."""

from __future__ import annotations

from phonoflow.operators import lexicon


def test_every_pronunciation_of_words_dealt_out(spark, monkeypatch, tmp_path):
    """Words with more entries and more rows than one task takes, words without either, rows twice; and a file that packs."""
    monkeypatch.setattr(lexicon, "ENTRIES", 3)
    monkeypatch.setattr(lexicon, "BLOCK_ROWS", 5)
    said = [(i % 40, w) for i, w in enumerate(["a"] * 25 + ["b", "b", "c", None] + ["a"] * 20)]
    rows = spark.createDataFrame(said, "k long, w string")
    entries = [("a", f"r{i}", [f"r{i}"], i) for i in range(11)] + [("b", "x", ["x", "y"], 0), ("d", "z", ["z"], 0)]
    d = lexicon.numbered(spark.createDataFrame(entries, "word string, reading string, phonemes array<string>, pos long"))
    got = lexicon.all_pronunciations(rows, d)
    assert got.columns == ["k", "w", "reading", "phonemes", "pron_idx"]
    want = [(k, w, r, p, i) for k, w in said for e, r, p, i in entries if e == w]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    monkeypatch.undo()
    many = spark.range(300).selectExpr("id AS k", "'a' AS w")
    d = lexicon.numbered(spark.range(3000).selectExpr("'a' AS word", "concat('Customer#', lpad(hash(id), 12, '0'), id) AS reading", "array('p') AS phonemes", "id AS pos"))
    lexicon.all_pronunciations(many, d).select("k", "reading").write.parquet(str(tmp_path / "out"))
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 400_000  # of 900,000 rows
