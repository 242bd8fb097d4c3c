"""Expressions and kernels against values that are known, and against each other."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phonoflow.functions import kernels as K
from phonoflow.functions import phonemes as P
from phonoflow.functions import signal as D
from phonoflow.functions import text as X


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def arr(*x):
    return F.array(*[F.lit(float(v)) for v in x])


KANA = {
    "ア": "a", "シ": "sh i", "チ": "ch i", "ツ": "ts u", "フ": "f u", "ヲ": "o", "ン": "ng", "キャ": "k y a", "シャ": "sh a", "ジェ": "j e", "トウキョウ": "t o u k y o u", "シンブン": "sh i ng b u ng",
    "ガッコウ": "g a q k o u", "チェック": "ch e q k u", "ティー": "t i long", "ヴァイオリン": "b a i o r i ng", "フュージョン": "f y u long j o ng", "スィート": "s u i long t o", "": "", "abcカ": "k a",
}


def test_kana(spark):
    rows = spark.createDataFrame(list(KANA.items()), "kana string, want string").select("kana", "want", P.phoneme_string(P.kana_to_phonemes(F.col("kana"))).alias("got")).collect()
    assert {r["kana"]: r["got"] for r in rows} == KANA
    assert set(p for v in P.KANA.values() for p in v) <= set(P.PHONEMES)
    assert len(P.PHONEMES) == 29


@pytest.mark.parametrize(("a", "b", "want"), [("a i", "a i", 0), ("", "", 0), ("", "a i", 2), ("a", "", 1), ("k a", "g a", 1), ("k a", "k a i", 1), ("sh i", "s i", 1), ("m a i k u", "m i k u", 1)])
def test_edit_distance(spark, a, b, want):
    ph = lambda s: P.parse_phonemes(F.lit(s))
    assert value(spark, P.phoneme_edit_distance(ph(a), ph(b))) == want
    assert value(spark, P.phoneme_edit_distance(ph(a), ph(b), 0)) == (want if want == 0 else -1)


def test_triphones(spark):
    ph = lambda s: P.parse_phonemes(F.lit(s))
    for s, want in {"i k u": ["#-i+k", "i-k+u", "k-u+#"], "a": ["#-a+#"], "k a": ["#-k+a", "k-a+#"], "": [], "sh i ng": ["#-sh+i", "sh-i+ng", "i-ng+#"]}.items():
        assert value(spark, P.word_triphones(ph(s))) == want
    for t, want in {"i-k+u": "k", "#-a+#": "a", "a-sh+i": "sh", "k-long+#": "long", "k": "k", "a-b-c+d+e": "b-c+d", "+-": "+-"}.items():
        assert value(spark, P.center_phoneme(F.lit(t))) == want
    assert [value(spark, P.state_class(F.lit(p), F.lit(s))) for p, s in (("sil", 1), ("long", 3), ("??", 1))] == [0, 86, -1]


def test_text(spark):
    assert value(spark, X.split_sentences(F.lit("東京に行く。大阪に行く。"))) == ["東京に行く", "大阪に行く"]
    assert [len(value(spark, X.split_sentences(F.lit(s)))) for s in ("東京に行く", "", "。。。", "東京に行く。")] == [1, 0, 0, 1]
    assert value(spark, X.fields_u(F.lit("a　b  c\t"))) == ["a", "b", "c"]
    assert value(spark, X.trim_u(F.lit("　x "))) == "x"
    assert value(spark, X.strip_punctuation(F.lit("あ。い、う？"))) == "あいう"
    assert value(spark, X.clean_markup(F.lit("{{a{{b}}}}[[File:x.png]]'''太字'''と[[表|示]]<ref>n</ref>\n* 項目 [http://x y] <b>t</b>"))).strip() == "太字と示 項目 t"
    assert [value(spark, X.is_tag_line(F.lit(s))) for s in ("<doc id=1>", "</doc>", "x <doc>", "<docs>")] == [True, True, False, True]
    assert [value(spark, X.sentence_bytes_between(F.lit(s))) for s in ("あ", "abcd", "東京", "x" * 201)] == [False, True, True, False]
    assert [value(spark, X.is_japanese(F.lit(s))) for s in ("かな", "カナー", "漢字々", "abc", "漢a")] == [True, True, True, False, False]
    assert value(spark, X.pronunciation(F.lit("*"), F.lit("ヨミ"))) == "ヨミ"
    assert value(spark, X.pronunciation(F.lit(""), F.lit("*"))) is None
    assert value(spark, X.wav_name(F.lit("a.b/c.mp3"))) == "a.b/c.wav"
    assert value(spark, X.numbers(F.lit("1, 2.5,x,,-3"))) == [1.0, 2.5, -3.0]
    assert value(spark, X.safe_percent(F.lit(1), F.lit(0))) == 0
    assert [value(spark, X.self_referring(F.split(F.lit(s), " "))) for s in ("魚 と 魚 を 買う", "a b c d", "a b a")] == [True, False, False]


def test_signal_values(spark):
    assert np.allclose(value(spark, D.pre_emphasis(arr(1, 2, 3, 4))), [1.0, 1.03, 1.06, 1.09])
    f = value(spark, D.frames(D.constants(range(100)), 25, 10))
    assert (len(f), f[1][0]) == (8, 10)
    assert value(spark, D.frames(arr(1, 2), 25, 10)) == []
    w = value(spark, D.windowed(D.constants([1.0] * 10), 10))
    assert math.isclose(w[0], 0.08, abs_tol=1e-9)
    assert max(w) > 0.9
    assert value(spark, D.delta_series(D.constants(range(10))))[2:8] == [1.0] * 6
    assert value(spark, D.delta(F.transform(D.constants(range(10)), lambda v: F.array(v, v * 2))))[4] == [1.0, 2.0]
    assert value(spark, D.speed_perturbed(arr(0, 0.25, 0.5, 0.75, 1), F.lit(1.0))) == [0, 0.25, 0.5, 0.75, 1]
    half = value(spark, D.speed_perturbed(arr(0, 1, 2, 3, 4), F.lit(0.5)))
    assert len(half) == 10
    assert half[:9] == [0.5 * i for i in range(9)]
    assert value(spark, D.speed_perturbed(arr(1, 2), F.lit(0.0))) is None
    assert value(spark, D.speed_perturbed(F.array().cast("array<double>"), F.lit(1.1))) is None
    assert value(spark, D.context_stack(F.array(arr(1, 2), arr(3, 4), arr(5, 6)), 1)) == [[1, 2, 1, 2, 3, 4], [1, 2, 3, 4, 5, 6], [3, 4, 5, 6, 5, 6]]
    assert math.isclose(value(spark, D.dct(D.constants([1.0] * 26), 26, 13))[0], 26)
    assert max(map(abs, value(spark, D.dct(D.constants([1.0] * 26), 26, 13))[1:])) < 1e-9
    assert value(spark, D.dot(arr(1, 2, 3), arr(4, 5, 6))) == 32
    assert value(spark, D.mahalanobis(arr(1, 2, 3, 4, 5), arr(0, 0, 0, 0, 0), arr(1, 1, 1, 1, 1))) == 55
    assert value(spark, D.mahalanobis(*[F.array().cast("array<double>")] * 3)) == 0
    for alpha in (0.82, 1.0, 1.2):
        got = [value(spark, D.warp_frequency(F.lit(f), F.lit(alpha))) for f in (0.0, 50.0, 1000.0, 7900.0, 8000.0)]
        assert np.allclose(got, [K.warp(f, alpha, 0.0, 8000.0) for f in (0.0, 50.0, 1000.0, 7900.0, 8000.0)])
        assert (got[0], round(got[4], 6)) == (0, 8000)
        assert math.isclose(got[2], 1000 * alpha)
    assert math.isclose(value(spark, D.mel_to_hz(D.hz_to_mel(F.lit(440.0)))), 440)


def test_spectra():
    assert np.allclose(K.power_spectrum(np.eye(1, 16), 16), 1 / 16)
    p = K.power_spectrum(np.cos(2 * np.pi * 2 * np.arange(8) / 8)[None], 8)[0]
    assert p.argmax() == 2
    x = np.random.default_rng(0).normal(size=24)
    dft = [abs(sum(v * np.exp(-2j * np.pi * k * n / 32) for n, v in enumerate(x))) ** 2 / 32 for k in range(17)]
    assert np.allclose(K.power_spectrum(x[None], 32)[0], dft)


def test_mel_bank():
    bank = K.mel_bank(26, 512, 16000, 0, 8000)
    assert bank.shape == (26, 257)
    assert (bank >= 0).all()
    assert (bank.max(1) == 1).all()
    assert not np.allclose(bank, K.mel_bank(26, 512, 16000, 0, 8000, 0.9))


def test_mfcc():
    cfg = K.FeatureConfig()
    x = np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    f = K.mfcc(x)
    assert f.shape == (98, 39) == (98, cfg.dim)
    assert np.isfinite(f).all()
    assert np.abs(f[:, :13].mean(0)).max() < 1e-9
    assert np.allclose(f, K.from_spectra(K.spectra(x, cfg), cfg), atol=1e-10)
    assert K.mfcc(x, K.FeatureConfig(delta_delta=False)).shape[1] == 26
    for short in (np.zeros(0), np.zeros(399)):
        with pytest.raises(ValueError):
            K.mfcc(short)
    best, alpha = K.best_warp(x, cfg, lambda f: 0.0)
    assert alpha == 0.82
    assert best.shape == f.shape


def test_mfcc_column_is_the_kernel(spark):
    from phonoflow.operators import features as FE

    x = np.random.default_rng(1).normal(size=4000)
    df = spark.createDataFrame([(1, x.tolist()), (2, None), (3, [0.0]), (4, [])], "i int, x array<double>")
    got = {r["i"]: r["f"] for r in df.select("i", FE.mfcc(F.col("x")).alias("f")).collect()}
    assert np.allclose(got[1], K.mfcc(x))
    assert got[2] is got[3] is got[4] is None
    s = df.where("i = 1").select(FE.power_spectra(F.col("x")).alias("s")).select(FE.features_from_spectra(F.col("s")).alias("f")).first()["f"]
    assert np.allclose(s, got[1], atol=1e-10)
    w = df.where("i <= 2").select("i", FE.warped(F.col("x"), lambda f: -abs(float(f[0, 0]))).alias("w")).collect()
    assert w[0]["w"]["alpha"] in K.ALPHAS


def silence(c):
    """The bounds by a loop."""
    n = len(c)
    if n < 6:
        return 0, n
    at, limit = min(c) + 0.3 * (max(c) - min(c)), n // 4
    start = next((i for i in range(limit) if c[i] > at), limit)
    back = next((i for i in range(limit) if c[n - 1 - i] > at), limit)
    start, end = max(start, 3), n - max(back, 3)
    if start >= end:
        start, end = 3, n - 3
    return (0, n) if end <= start else (start, end)


def test_silence_and_segments(spark):
    from phonoflow.operators import features as FE

    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.integers(0, 5, rng.integers(0, 60))], [["sil", "a", "k", "sil"], ["a", "k", "i"], ["sil", "a"], []][i % 4]) for i in range(120)]
    df = spark.createDataFrame(rows, "i int, e array<double>, ph array<string>")
    got = {r["i"]: r for r in df.select("i", FE.silence_bounds(F.col("e")).alias("b"), FE.uniform_segments(F.col("ph"), F.col("e")).alias("s")).collect()}
    for i, e, ph in rows:
        a, z = silence(e) if e else (0, 0)
        assert (got[i]["b"]["start"], got[i]["b"]["end"]) == (a, z)
        want = []
        if len(e) >= len(ph) and ph:
            lead, trail = ph[0] == "sil", len(ph) > 1 and ph[-1] == "sil"
            if not (lead or trail):
                a, z = 0, len(e)
            inner = ph[lead : len(ph) - trail]
            if lead and a >= 3:
                want.append(("sil", 0, a))
            if inner and z - a >= len(inner):
                each, rest = divmod(z - a, len(inner))
                at = a
                for k, p in enumerate(inner):
                    n = each + (k < rest)
                    if n >= 3:
                        want.append((p, at, at + n))
                    at += n
            if trail and len(e) - z >= 3:
                want.append(("sil", z, len(e)))
        assert [(s["phoneme"], s["start"], s["end"]) for s in got[i]["s"]] == want, (e, ph)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=8))
def test_log_sum_exp(x):
    assert math.isclose(float(K.log_sum_exp(np.array(x))), math.log(sum(math.exp(v - max(x)) for v in x)) + max(x), abs_tol=1e-9)


def test_log_arithmetic():
    assert math.isclose(float(K.log_sum_exp(np.log([2.0, 3.0]))), math.log(5))
    assert float(K.log_sum_exp(np.array([P.LOG_ZERO, 1.0]))) == 1.0
    assert float(K.log_sum_exp(np.full(3, P.LOG_ZERO))) == P.LOG_ZERO
    assert math.isclose(K.log_sub(math.log(5), math.log(3)), math.log(2))
    assert K.log_sub(1.0, 1.0) == P.LOG_ZERO
