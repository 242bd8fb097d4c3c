"""Files in and out: WAV, dictionaries, ARPA, manifests, corpora, markup dumps, streams and the command line."""

from __future__ import annotations

import bz2
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonoflow import cli
from phonoflow.operators import corpus, lexicon, lm
from phonoflow.sources import readers as R
from phonoflow.sources import writers as W
from phonoflow.sources.audio import parse_wav, read_wav, wav_bytes

LN10 = math.log(10)
ARPA = "\\data\\\nngram 1=4\nngram 2=9\n\n\\1-grams:\n-1.0\t</s>\n-1.0\t<s>\t-0.5\n-0.5\t東京\n-0.7\tタワー\t-0.3\n\n\\2-grams:\n-0.3\t<s> 東京\n-0.4\t東京 タワー\n-0.2\tタワー </s>\n\n\\end\\\n"


def lines(path) -> list[str]:
    return [x for p in sorted(path.glob("part-*")) for x in p.read_text().splitlines()]


def test_wav():
    x = 16000 * np.sin(2 * np.pi * 440 * np.arange(100) / 16000) / 32768
    rate, got = parse_wav(wav_bytes(x))
    assert rate == 16000
    assert np.allclose(got, np.trunc(x * 32768) / 32768, atol=1 / 32768)
    odd = wav_bytes(x)
    assert len(parse_wav(odd[:36] + b"LIST\x03\x00\x00\x00abc\x00" + odd[36:])[1]) == 100
    for bad in (b"", b"RIFX" + odd[4:], odd[:8] + b"WAVX" + odd[12:], wav_bytes(x, 44100), wav_bytes(x, channels=2), wav_bytes(x, bits=8), odd[:36], odd[:12] + odd[36:]):
        with pytest.raises(ValueError):
            parse_wav(bad)


def test_wav_files(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav_bytes(np.array([0.5, -0.5])))
    (tmp_path / "b.wav").write_bytes(b"junk")
    got = {r["path"].rsplit("/", 1)[1]: r for r in read_wav(spark, str(tmp_path)).collect()}
    assert got["a.wav"]["samples"] == [0.5, -0.5]
    assert got["a.wav"]["n_samples"] == 2
    assert got["b.wav"]["error"]
    assert got["b.wav"]["samples"] is None


def test_dictionary(spark, tmp_path):
    p = tmp_path / "dict.txt"
    p.write_text("# c\n東京\tトウキョウ\tt o u k y o u\n\nタワー\tタワー\tt a w a long\n食べる\tタベル\tt a b e r u\n食べる\tタベル\tt a b e r u\n")
    d = R.read_dictionary(spark, str(p))
    assert lexicon.words_of(d).count() == 3
    assert d.where("word = '食べる'").count() == 2
    assert sorted(r["pron_idx"] for r in d.collect()) == [0, 0, 0, 1]
    assert len(d.where("word = '東京'").first()["phonemes"]) == 7
    W.write_dictionary(d, str(tmp_path / "out"))
    assert lines(tmp_path / "out")[0] == "タワー\tタワー\tt a w a long"
    p.write_text("good\tx\ta\nbad line\n")
    with pytest.raises(Exception, match="bad line"):
        R.read_dictionary(spark, str(p)).collect()
    assert R.read_dictionary(spark, str(p), strict=False).count() == 1


def test_arpa(spark, tmp_path):
    p = tmp_path / "lm.arpa"
    p.write_text(ARPA)
    m = R.read_arpa(spark, str(p))
    assert (m.order, m.uni.count(), m.bi.count(), m.tri) == (2, 4, 3, None)
    q = spark.createDataFrame([(None, "<s>", "東京"), (None, "タワー", "東京"), (None, "x", "東京"), (None, "東京", "x")], "h2 string, h1 string, w string")
    got = {(r["h1"], r["w"]): r["lp"] for r in lm.scored(lm.natural(m), q).collect()}
    assert math.isclose(got["<s>", "東京"], -0.3 * LN10, abs_tol=1e-10)
    assert math.isclose(got["タワー", "東京"], -0.8 * LN10, abs_tol=1e-10)
    assert math.isclose(got["x", "東京"], -0.5 * LN10, abs_tol=1e-10)
    assert got["東京", "x"] == -1e30
    s = spark.createDataFrame([(1, ["東京", "タワー"])], "k int, words array<string>")
    assert math.isclose(lm.sentence_scores(lm.natural(m), s, "k").first()["log_prob"], -0.9 * LN10, abs_tol=1e-10)
    p.write_text("\\data\\\nngram 1=1\n\\1-grams:\n-1.0\n\\end\\\n")
    with pytest.raises(Exception, match="too few fields"):
        R.read_arpa(spark, str(p)).uni.collect()


SENTENCES = ["今日 は いい 天気 です", "今日 は 暑い です", "明日 は いい 天気 です"]


def test_build_write_read(spark, tmp_path):
    p = tmp_path / "corpus.txt"
    p.write_text("\n".join([*SENTENCES, "", "  "]) + "\n")
    c = R.read_corpus(spark, str(p))
    assert c.count() == 3
    for order in (1, 2, 3, 5):
        m = lm.build(c, order)
        out = tmp_path / f"lm{order}"
        W.write_arpa(m, str(out))
        text = lines(out)
        assert text[0] == "\\data\\"
        assert text[-1] == "\\end\\"
        assert ("\\3-grams:" in text) == (order >= 3)
        back = R.read_arpa(spark, str(out))
        assert back.order == min(3, max(2, order))
        assert back.uni.count() == m.uni.count()
        words = lambda s: spark.createDataFrame([(1, s.split())], "k int, words array<string>")  # noqa: E731, B023
        score = lambda mm, s: lm.sentence_scores(lm.natural(mm), words(s), "k").first()["log_prob"]  # noqa: E731, B023
        assert math.isclose(score(back, SENTENCES[0]), score(lm.rounded(m), SENTENCES[0]), abs_tol=1e-5)
        assert score(back, SENTENCES[0]) > score(back, "今日 は 寒い です")
        assert back.uni.where("lp >= 0").count() == back.bi.where("lp > 0").count() == 0
    assert lm.best_start(lm.build(c, 2)) < 0


def test_manifests_and_imports(spark, tmp_path):
    m = tmp_path / "m.tsv"
    m.write_text("a.wav\tx y\nno tab\n# c\tz\n\nb.wav\tz\tw\n")
    assert R.read_manifest(spark, str(m)).count() == 3
    got = {r["wav_path"]: r for r in R.read_manifest(spark, str(m), comments=True).collect()}
    assert got["a.wav"]["words"] == ["x", "y"]
    assert got["b.wav"]["expected"] == "z\tw"
    v = tmp_path / "validated.tsv"
    v.write_text('up_votes\tclient_id\tpath\tsentence\textra\n3\tc1\tp1.mp3\tsay "x\te\nbad\tc2\tp2.mp3\ts\te\nshort\n')
    rows = {r["path"]: r for r in R.read_validated(spark, str(v)).collect()}
    assert rows["p1.mp3"]["sentence"] == 'say "x'
    assert rows["p2.mp3"]["up_votes"] == 0
    assert lexicon.vote_filter(R.read_validated(spark, str(v)), 2).count() == 1
    for s in ("one", "two"):
        (tmp_path / "jsut" / s).mkdir(parents=True)
        (tmp_path / "jsut" / s / "transcript_utf8.txt").write_text(f"{s}_1:文:章\n:x\ny:\nbroken\n")
    got = R.read_transcripts(spark, str(tmp_path / "jsut")).collect()
    assert [(r["subset"], r["utt"], r["sentence"]) for r in got] == [("one", "one_1", "文:章"), ("two", "two_1", "文:章")]
    assert got[0]["wav_path"].endswith("/jsut/one/wav/one_1.wav")
    c = tmp_path / "x.csv"
    c.write_text("東京,1,2,3,4,5,6,7,8,9,10,トウキョウ,トーキョー\n駅,1,2,3,4,5,6,7,8,9,10,エキ,*\n駅,1,2,3,4,5,6,7,8,9,10,エキ,*\nshort,1\n無,1,2,3,4,5,6,7,8,9,10,*,*\n")
    d = R.read_lexicon_csv(spark, str(c)).collect()
    assert [(r["word"], r["reading"]) for r in d] == [("東京", "トーキョー"), ("駅", "エキ")]


XML = "<mediawiki>" + "".join(f"<page><title>{t}</title><revision><text>{x}</text></revision></page>" for t, x in (("A", "'''東京'''は都市。短。大阪も。"), ("Help:B", "無視する。"), ("C", "三つ目の文。"))) + "</mediawiki>"


def test_markup_dump(spark, tmp_path):
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(XML.encode()))
    pages = R.read_pages(spark, str(tmp_path / "d.xml.bz2"))
    assert sorted(r["title"] for r in pages.collect()) == ["A", "C"]
    assert sorted(r["sentence"] for r in R.page_sentences(pages).collect()) == ["三つ目の文", "大阪も", "東京は都市"]
    assert R.read_pages(spark, str(tmp_path / "d.xml.bz2"), 1).count() == 1


def test_stream_is_the_batch(spark, tmp_path):
    from phonoflow.streaming import lines as L

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("<doc id=1>\n東京 に 行く。大阪 から 行く。\n\n</doc>\n")
    (src / "b.txt").write_text("東京 に\n")
    d = spark.createDataFrame([("東京",), ("に",), ("行く",)], "word string")
    for i in range(2):  # the second run finds nothing new
        L.write(L.sentences(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    want = sorted(r["sentence"] for r in R.article_sentences(spark.read.text(str(src))).collect())
    assert sorted(lines(tmp_path / "out")) == want
    assert len(want) == 3
    known = L.covered(R.article_sentences(spark.read.text(str(src))), d, 2)
    assert sorted(r["sentence"] for r in known.collect()) == ["東京 に", "東京 に 行く"]


def test_corpus(spark):
    got = {r[0] for r in corpus.generated(spark).collect()}
    assert "学校 に 行き ます" in got
    assert "犬 と 犬 を 見る" not in got
    assert "犬 と 猫 を 見る" in got
    big = [("%s %s %s", [[f"a{i}" for i in range(20)], [f"b{i}" for i in range(20)], [f"c{i}" for i in range(20)]]), ("%s %s", [[f"a{i}" for i in range(30)], [f"b{i}" for i in range(20)]])]
    n = [corpus.generated(spark, [t]).count() for t in big]
    assert n == [200, 300]
    assert corpus.generated(spark, big).exceptAll(corpus.generated(spark, big)).count() == 0


def test_dictionary_operators(spark):
    d = spark.createDataFrame([("東京",), ("に",), ("行く",), ("タワー",)], "word string")
    s = spark.createDataFrame([(1, ["東京", "に", "行く"]), (2, ["東京", "タワー", "に", "行く"]), (3, ["東京", "から", "行く"]), (4, ["大阪"]), (5, [])], "id int, words array<string>")
    assert sorted(r["id"] for r in lexicon.all_in_dictionary(s, d, "id").collect()) == [1, 2, 5]
    assert sorted(r["id"] for r in lexicon.all_in_dictionary(s, d, "id", min_words=4).collect()) == [2]
    words = s.select(F.explode("words").alias("w"))
    assert lexicon.missing_report(words, d, 1) == (["から"], 2)
    same = lexicon.tokenised(spark.createDataFrame([(1, "a b"), (2, "c")], "id int, line string"), ["cat"]).orderBy("id").collect()
    assert [r["words"] for r in same] == [["a", "b"], ["c"]]
    with pytest.raises(Exception, match="lost a line"):
        lexicon.tokenised(spark.createDataFrame([(1, "a"), (2, "b")], "id int, line string").repartition(1), ["head", "-n", "1"]).collect()


def test_near_pairs_are_those_of_brute_force(spark):
    import random

    rng = random.Random(1)
    words = sorted({"".join(rng.choices("abc", k=rng.randrange(0, 6))) for _ in range(150)})
    df = spark.createDataFrame([(w, list(w)) for w in words], "word string, phonemes array<string>")

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return row[-1]

    for k in (1, 2, 3, 4):
        got = {(r["word_a"], r["word_b"], r["dist"]) for r in lexicon.too_close_pairs(df, df, k).collect()}
        assert got == {(a, b, lev(a, b)) for a in words for b in words if lev(a, b) < k}
    picked = [r["word"] for r in lexicon.greedy_selection(df.withColumn("pos", F.monotonically_increasing_id()), df.limit(0), 20, 2).collect()]
    brute = []
    for w in sorted(words, key=lambda w: (len(w), len(w), words.index(w))):
        if len(brute) < 20 and (not w or all(lev(w, b) >= 2 for b in brute if b)):
            brute.append(w)
    assert sorted(picked) == sorted(brute)


def test_filtered_dictionary(spark):
    full = [("東京", "t o"), ("に", "n i"), ("abc", "a b"), ("長い長い長い長い長い", "n a"), ("火", "h"), ("水", "m i z u"), ("水", "x x"), ("湖", "m i z u u"), ("山", "y a m a"), ("川", "k a w a")]
    df = spark.createDataFrame([(i, w, p.split()) for i, (w, p) in enumerate(full)], "pos long, word string, phonemes array<string>")
    must = df.where("word = '東京'")
    got = lexicon.filtered_dictionary(df, must, spark.createDataFrame([("に",)], "word string"), 4, 8, 2).orderBy("grp", "pos").collect()
    assert [(r["grp"], r["word"]) for r in got] == [(0, "東京"), (1, "に"), (2, "水"), (2, "山")] or [r["word"] for r in got][:2] == ["東京", "に"]
    assert len(got) == 4


def test_command_line(spark, tmp_path):
    (tmp_path / "c.txt").write_text("\n".join(SENTENCES))
    cli.main(["lmbuild", str(tmp_path / "c.txt"), "--order", "2", "--output", str(tmp_path / "lm")], spark)
    assert lines(tmp_path / "lm")[0] == "\\data\\"
    (tmp_path / "d.txt").write_text("東京\tトウキョウ\tx\nは\tハ\th a\n")
    cli.main(["dictfix", str(tmp_path / "d.txt"), "--output", str(tmp_path / "fixed")], spark)
    assert lines(tmp_path / "fixed") == ["東京\tトウキョウ\tt o u k y o u", "は\tハ\th a", "<sil>\tSIL\tsil"]
    (tmp_path / "t.txt").write_text("<doc>\n東京 は 東京。別 の 文。\n")
    cli.main(["lmtext", str(tmp_path / "t.txt"), "--dict", str(tmp_path / "d.txt"), "--output", str(tmp_path / "kept")], spark)
    assert lines(tmp_path / "kept") == ["東京 は 東京"]
    cli.main(["corpusgen", "--output", str(tmp_path / "gen")], spark)
    assert lines(tmp_path / "gen")


def test_train_and_recognise(spark, tmp_path):
    """From WAV files to text: two words of different tones."""
    tone = lambda f: 0.3 * np.sin(2 * np.pi * f * np.arange(8000) / 16000)
    rng, rows = np.random.default_rng(0), []
    for i in range(8):
        w, f = (("あ", 500), ("い", 2500))[i % 2]
        quiet = lambda: rng.normal(0, 0.001, 3000)  # noqa: E731, B023
        (tmp_path / f"{i}.wav").write_bytes(wav_bytes(np.concatenate([quiet(), tone(f) + rng.normal(0, 0.001, 8000), quiet()])))
        rows.append(f"{tmp_path}/{i}.wav\t{w}")
    (tmp_path / "m.tsv").write_text("\n".join(rows))
    (tmp_path / "d.txt").write_text("あ\tア\ta\nい\tイ\ti\n<sil>\tSIL\tsil\n")
    (tmp_path / "c.txt").write_text("あ\nい\n")
    base = ["--manifest", str(tmp_path / "m.tsv"), "--wavs", str(tmp_path), "--dict", str(tmp_path / "d.txt")]
    cli.main(["train", *base, "--mix", "1", "--iterations", "4", "--output", str(tmp_path / "am")], spark)
    cli.main(["lmbuild", str(tmp_path / "c.txt"), "--order", "2", "--output", str(tmp_path / "lm")], spark)
    from phonoflow.operators.decoder import recognize_files, recognizer

    r = recognizer(spark, str(tmp_path / "am"), str(tmp_path / "lm"), str(tmp_path / "d.txt"), network_path=None, oov_log10=-5.0)
    got = {x["path"].rsplit("/", 1)[1]: x["result"]["text"] for x in recognize_files(spark, str(tmp_path), r).collect()}
    assert got == {f"{i}.wav": "あい"[i % 2] for i in range(8)}
