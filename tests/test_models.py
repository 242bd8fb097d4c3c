"""Mixtures, hidden Markov models, alignment, networks and the search."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from phonoflow.functions import kernels as K
from phonoflow.functions import network as N
from phonoflow.functions import search as S
from phonoflow.operators import acoustic as A
from phonoflow.operators import decoder
from phonoflow.operators import network as NN


def flat(p, mean, var=0.5, dim=1):
    return K.Hmm(p, np.full((3, 1, dim), float(mean)), np.full((3, 1, dim), var), np.zeros((3, 1)))


def steps(means, dim=1, var=1.0):
    return K.Hmm("a", np.array(means, float).reshape(3, 1, 1).repeat(dim, 2), np.full((3, 1, dim), var), np.zeros((3, 1)))


def test_gaussians():
    one = lambda x, m, v=1.0: float(K.mixture_logs(np.array([[float(x)]]), np.array([[float(m)]]), np.array([[v]]), np.zeros(1))[0])
    assert math.isclose(one(0, 0), -0.5 * math.log(2 * math.pi))
    two = K.mixture_logs(np.array([[0.0], [5.0], [2.5]]), np.array([[0.0], [5.0]]), np.ones((2, 1)), np.log([0.5, 0.5]))
    assert math.isclose(two[0], two[1])
    assert two[0] > two[2]
    rng = np.random.default_rng(0)
    x, m, v, w = rng.normal(size=(300, 39)), rng.normal(size=(4, 39)), rng.uniform(0.5, 2, (4, 39)), np.log(np.full(4, 0.25))
    slow = [math.log(sum(math.exp(w[k] - 0.5 * sum(math.log(2 * math.pi * v[k, d]) + (x[t, d] - m[k, d]) ** 2 / v[k, d] for d in range(39)) + 60) for k in range(4))) - 60 for t in range(20)]
    assert np.allclose(K.mixture_logs(x, m, v, w)[:20], slow, atol=1e-8)


def all_paths(h, x, end):
    """log of the sum over all state paths, by enumeration."""
    e = K.emissions(h, x)
    logs = []
    for path in itertools.product(range(3), repeat=len(x)):
        lp = h.trans[0, path[0] + 1] + e[0, path[0]] + sum(h.trans[a + 1, b + 1] + e[t + 1, b] for t, (a, b) in enumerate(zip(path, path[1:], strict=False)))
        lp += h.trans[path[-1] + 1, 4] if end else 0.0
        if lp > -1e29:
            logs.append(lp)
    return float(np.logaddexp.reduce(logs))


def test_forward_and_backward():
    h, x = steps([0, 3, 6]), np.array([[0], [0.5], [3], [3.5], [6], [6.5]])
    e = K.emissions(h, x)
    a, b = K.forward(h.trans, e), K.backward(h.trans, e)
    both = [float(K.log_sum_exp(a[t] + b[t])) for t in range(6)]
    assert np.allclose(both, both[0], atol=1e-9)
    assert math.isclose(both[0], all_paths(h, x, True), abs_tol=1e-9)
    assert math.isclose(K.total_likelihood(a), all_paths(h, x, False), abs_tol=1e-9)


def test_em_raises_the_likelihood_and_finds_the_means():
    rng = np.random.default_rng(4)
    seqs = [np.repeat([0.0, 3.0, 6.0], 3)[:, None] + rng.normal(0, 0.3, (9, 2)) for _ in range(50)]
    h, log = K.trained(steps([1, 2, 5], 2), seqs)
    assert all(b >= a - 1e-6 for a, b in zip(log, log[1:], strict=False))
    assert np.allclose(h.mean[:, 0], [[0, 0], [3, 3], [6, 6]], atol=0.2)
    assert h.trans[3, 4] > -10
    assert np.allclose(np.exp(h.trans[1:4, 1:]).sum(1), 1)
    with pytest.raises(ValueError):
        K.trained(h, [])


def test_statistics_are_those_of_enumeration():
    h, x = K.new_hmm("a", 2, 2, 1), np.random.default_rng(0).normal(size=(5, 2))
    s = K.statistics(h, x)
    assert math.isclose(s.ll, all_paths(h, x, True), abs_tol=1e-9)
    assert math.isclose(s.occupancy.sum(), 5)
    assert math.isclose(s.moves.sum(), 5)
    assert np.allclose(s.first.sum((0, 1)), x.sum(0))


def test_alignment():
    model = {"a": flat("a", 0, dim=4), "k": flat("k", 5, dim=4), "i": flat("i", 10, dim=4)}
    x = np.repeat([0.1, 5.1, 10.1], 10)[:, None].repeat(4, 1)
    hmms = [model[p] for p in "aki"]
    path = K.align(hmms, np.concatenate([K.emissions(h, x) for h in hmms], 1))
    assert K.segments(path) == [(0, 0, 10), (1, 10, 20), (2, 20, 30)]
    same = [model["a"], model["a"]]
    got = K.segments(K.align(same, np.concatenate([K.emissions(h, x[:10]) for h in same], 1)))
    assert [s[0] for s in got] == [0, 1]  # equal neighbours stay apart
    for n, phones in ((2, 3), (3, 2)):
        with pytest.raises(ValueError):
            K.align(hmms[:phones], np.concatenate([K.emissions(h, x[:n]) for h in hmms[:phones]], 1))
    with pytest.raises(ValueError):
        K.align([], np.zeros((3, 0)))


def test_alignment_is_the_best_path():
    rng = np.random.default_rng(6)
    hmms = [K.new_hmm(p, 1, 1, s) for s, p in enumerate("ak")]
    emit = np.concatenate([K.emissions(h, rng.normal(size=(8, 1))) for h in hmms], 1)
    best = -np.inf
    for path in itertools.combinations_with_replacement(range(6), 7):
        p = (0, *path)
        if all(b - a in (0, 1) for a, b in zip(p, p[1:], strict=False)) and p[-1] >= 3:
            best = max(best, emit[range(8), p].sum() + 7 * K.HALF)
    got = K.align(hmms, emit)
    assert math.isclose(emit[range(8), got].sum() + 7 * K.HALF, best)


def test_alignment_of_rows_and_training(spark, tmp_path):
    model = {"a": flat("a", 0, dim=2), "k": flat("k", 5, dim=2), "sil": flat("sil", -5, dim=2)}
    rng = np.random.default_rng(3)
    utts = []
    for i in range(12):
        x = np.repeat([-5.0, 0.0, 5.0, -5.0], 6)[:, None] + rng.normal(0, 0.2, (24, 2))
        utts.append((i, ["sil", "a", "k", "sil"], [["a", "k"]], x.tolist()))
    utts += [(50, ["sil", "zz"], [["zz"]], utts[0][3]), (51, ["a"] * 9, [["a"]], utts[0][3][:12]), (52, [], [], utts[0][3]), (53, ["a"], [["a"]], None)]
    df = spark.createDataFrame(utts, "utt_id long, phonemes array<string>, word_phonemes array<array<string>>, features array<array<double>>")
    got = {r["utt_id"]: r for r in A.forced_alignment(df, model).collect()}
    assert [(s["phoneme"], s["start"], s["end"]) for s in got[0]["segments"]] == [("sil", 0, 6), ("a", 6, 12), ("k", 12, 18), ("sil", 18, 24)]
    assert all(got[i]["error"] and got[i]["segments"] is None for i in (50, 51, 52, 53))
    good = df.where("utt_id < 50")
    segs = A.cut_segments(A.realigned(good, model))
    assert {r["name"]: r["n"] for r in segs.groupBy("name").count().withColumnRenamed("count", "n").collect()} == {"sil": 24, "a": 12, "k": 12}
    both = {n: K.new_hmm(n, 2, 1, 0) for n in ("a", "k", "sil")}
    new, log = A.train(segs, both, 5)
    rows = segs.toPandas()
    for n in both:
        alone, want = K.trained(both[n], [np.stack(list(x)) for x in rows[rows["name"] == n]["features"]], 5)
        assert np.allclose(new[n].mean, alone.mean)
        assert np.allclose(new[n].trans, alone.trans)
        assert np.allclose(log[n], want)
    mono = A.train_monophones(good, ["a", "k", "sil"], 1, 4, alignments=1)
    assert abs(mono["k"].mean[1, 0, 0] - 5) < 0.5
    tri = A.triphone_segments(good, mono)
    assert {r["name"] for r in tri.select("name").distinct().collect()} == {"#-a+k", "a-k+#"}
    full = A.train_triphones(tri, mono, min_segments=10, iterations=2)
    assert A.has_triphones(full)
    assert A.resolved(full, "#-a+k") is full["#-a+k"]
    assert A.resolved(full, "k-a+k") is full["a"]
    A.save_model(spark, full, str(tmp_path / "am"))
    back = A.load_model(spark, str(tmp_path / "am"))
    assert sorted(back) == sorted(full)
    assert all(np.allclose(back[n].mean, full[n].mean) and np.allclose(back[n].trans, full[n].trans) for n in full)
    cover = {r["phoneme"]: r["n_segments"] for r in A.coverage(segs, spark.createDataFrame([("a",), ("q",)], "phoneme string")).collect()}
    assert cover == {"a": 12, "q": 0}


# ---------------------------------------------------------------- networks
@pytest.mark.parametrize(("bn", "smooth"), [(False, 0.0), (False, 0.1), (True, 0.0), (True, 0.1)])
def test_gradients(bn, smooth):
    rng = np.random.default_rng(1)
    net = N.new_network(6, 4, 0, 2, 0.0, bn, 3, outputs=3)
    for b in net.b:  # off the kink at zero
        b += rng.normal(0, 0.3, b.shape)
    for g in net.bn or []:
        g[0] += rng.normal(0, 0.1, 4)
        g[1] += rng.normal(0, 0.1, 4)
    x, y = rng.normal(size=(8, 6)), rng.integers(0, 3, 8)
    got = N.gradients(net, x, y, smooth)
    for p, g in zip(net.parameters(), got.g, strict=True):
        for i in list(np.ndindex(p.shape))[::3]:
            old, h = p[i], 1e-5
            p[i] = old + h
            up = N.gradients(net, x, y, smooth).loss
            p[i] = old - h
            down = N.gradients(net, x, y, smooth).loss
            p[i] = old
            assert abs((up - down) / (2 * h) - g[i]) <= 1e-4 * max(1, abs(g[i]))


def test_network_basics():
    net = N.new_network(39, 16, 3, 2)
    out = N.likelihoods(net, np.random.default_rng(0).normal(size=(5, 39)))
    assert out.shape == (5, 87)
    assert np.allclose(np.exp(out).sum(1), 1)  # a prior of zero
    assert N.windows(np.arange(6.0).reshape(3, 2), 1).tolist() == [[0, 1, 0, 1, 2, 3], [0, 1, 2, 3, 4, 5], [2, 3, 4, 5, 4, 5]]
    rates = [N.cosine_rate(0.001, e, 50) for e in range(51)]
    assert math.isclose(rates[0], 0.001)
    assert math.isclose(rates[50], 0.00001)
    assert rates == sorted(rates, reverse=True)


def blobs(n=600, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    return rng.normal(size=(n, 4)) + 3 * np.eye(3, 4)[y], y


@pytest.mark.parametrize("options", [{}, {"smooth": 0.1}, {"schedule": "cosine"}])
@pytest.mark.parametrize(("bn", "dropout"), [(False, 0.0), (True, 0.0), (False, 0.2)])
def test_training_lowers_the_loss(options, bn, dropout):
    x, y = blobs()
    net = N.new_network(4, 16, 0, 1, dropout, bn, outputs=3)
    log = N.fit(net, x, y, rate=0.01, epochs=12, batch=32, workers=2, patience=0, **options)
    assert log[-1][0] < log[0][0]
    assert log[-1][3] > 0.85
    if bn:
        assert not np.allclose(net.bn[0][2], 0)


def test_training_where_the_rows_lie(spark, tmp_path):
    x, y = blobs(300)
    rows = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y, strict=True)], "x array<double>, target int").repartition(3)
    net = N.new_network(4, 8, 0, 1, batch_norm=True, outputs=3)
    log = NN.train(rows, net, epochs=3, rate=0.05, batch=64, steps=2, patience=0)
    assert log[-1][0] < log[0][0]
    NN.save_network(spark, net, str(tmp_path / "net"))
    back = NN.load_network(spark, str(tmp_path / "net"))
    assert np.allclose(N.forward(back, x), N.forward(net, x))
    assert back.context == net.context


def test_an_epoch_has_a_step_for_each_mini_batch(spark, monkeypatch):
    x, y = blobs(300)
    rows = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y, strict=True)], "x array<double>, target int")
    sizes, real = [], N.update
    monkeypatch.setattr(N, "update", lambda net, adam, g, rate: (sizes.append(g.rows), real(net, adam, g, rate)))
    log = NN.train(rows, N.new_network(4, 8, 0, 1, outputs=3), epochs=2, rate=0.02, batch=20, workers=2, patience=0)
    assert sum(sizes) == 2 * sum(sizes[: len(sizes) // 2])
    assert len(sizes) == 2 * -(-sum(sizes[: len(sizes) // 2]) // 40)
    assert log[1][0] < log[0][0]


# ---------------------------------------------------------------- search
LN10 = math.log(10)


def language_model(order=2):
    lp = lambda x: x * LN10
    uni = {"</s>": (lp(-1), 0.0), "<s>": (lp(-1), 0.0), "あ": (lp(-0.5), 0.0), "い": (lp(-0.5), 0.0)}
    bi = {k: (lp(-0.3), 0.0) for k in (("<s>", "あ"), ("<s>", "い"), ("あ", "い"), ("い", "あ"))}
    return S.LanguageModel(order, uni, bi, {("<s>", "あ", "い"): lp(-0.1), ("<s>", "い", "あ"): lp(-0.8)} if order == 3 else {})


def tiny(order=2, sil=False, **cfg):
    words = {"あ": ["a"], "い": ["i"]} | ({"<sil>": ["sil"]} if sil else {})
    model = {"a": flat("a", 0), "i": flat("i", 5), "sil": flat("sil", -9)}
    return decoder.Recognizer(model, language_model(order), words, search=S.SearchConfig(**{"beam": 300.0, "max_tokens": 500, "lm_weight": 1.0, "word_penalty": -2.0} | cfg))


def frames(*parts):
    return np.concatenate([np.full((n, 1), v) for v, n in parts])


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("ends", [0, 1])
def test_words_are_found(order, ends):
    one = tiny(order, word_penalty=-5.0, max_word_ends=ends).decode_features(frames((0.1, 6)))
    assert "あ" in one.text
    assert "い" not in one.text
    assert math.isfinite(one.score)
    two = tiny(order, max_word_ends=ends).decode_features(frames((0.1, 6), (4.9, 6)))
    assert two.text == "あ い"
    assert [(w.start, w.end) for w in two.words] == [(0, 5), (6, 11)]
    assert tiny().decode_features(np.zeros((0, 1))) == S.Result()


def test_silence_and_limits():
    r = tiny(sil=True)
    got = r.decode_features(frames((-9, 5), (0.1, 6), (-9, 5), (4.9, 6), (-9, 4)))
    assert got.text == "あ い"
    for limit in (0, 500):
        assert tiny(max_tokens=limit).decode_features(frames((0.1, 6), (4.9, 6))).text == "あ い"
    assert decoder.Recognizer({}, language_model(), {"あ": ["a"]}).decode_features(frames((0, 5))).text == ""


def test_search_finds_the_best_of_all_paths():
    """Without pruning the score is the best over all word sequences of a composed model, by dynamic programming over them."""
    r = tiny(beam=1e9, max_tokens=0)
    x = np.random.default_rng(8).normal(2.5, 3, (9, 1))
    emit = {w: K.emissions(r.model[p], x) for w, p in (("あ", "a"), ("い", "i"))}
    ahead = r.lm.best_start()
    best = {}

    def walk(t, w, s, score, hist):
        key = (t, w, s, hist)
        if best.get(key, -np.inf) >= score:
            return
        best[key] = score
        if t == 8:
            return
        walk(t + 1, w, s, score + K.HALF + emit[w][t + 1, s], hist)
        if s < 2:
            walk(t + 1, w, s + 1, score + K.HALF + emit[w][t + 1, s + 1], hist)
        lm = r.lm.log_prob(list(hist[-2:]) or ["<s>"], w) - 2.0
        for nxt in "あい":
            walk(t + 1, nxt, 0, score + K.HALF - ahead + lm + ahead + emit[nxt][t + 1, 0], (*hist, w))

    for w in "あい":
        walk(0, w, 0, emit[w][0, 0] + ahead, ())
    assert math.isclose(r.decode_features(x).score, max(v for k, v in best.items() if k[0] == 8), abs_tol=1e-9)


def test_language_model_arithmetic():
    lm = S.LanguageModel(2, {"<s>": (-1 * LN10, -0.5 * LN10), "</s>": (-1 * LN10, 0.0), "東京": (-0.5 * LN10, 0.0), "タワー": (-0.7 * LN10, -0.3 * LN10)}, {("<s>", "東京"): (-0.3 * LN10, 0.0), ("東京", "タワー"): (-0.4 * LN10, 0.0), ("タワー", "</s>"): (-0.2 * LN10, 0.0)})
    assert math.isclose(lm.log_prob(["<s>"], "東京"), -0.3 * LN10)
    assert math.isclose(lm.log_prob(["タワー"], "東京"), -0.8 * LN10)
    assert math.isclose(lm.sentence(["東京", "タワー"]), -0.9 * LN10)
    assert lm.log_prob(["東京"], "無い") == K.LOG_ZERO
    lm.oov = -7.0
    assert lm.log_prob(["東京"], "無い") == -7.0


def test_grid_and_rows(spark):
    r = tiny()
    cases = spark.createDataFrame([(frames((0.1, 6), (4.9, 6)).tolist(), "あ い"), (frames((0.1, 6)).tolist(), "あ")], "features array<array<double>>, expected string")
    got = decoder.tuned(cases, decoder.grid(spark, [1.0, 2.0], [-50.0, -2.0], [100], [0]), r).orderBy("rank").collect()
    assert len(got) == 4
    assert [g["correct"] for g in got] == sorted((g["correct"] for g in got), reverse=True)
    assert got[0]["correct"] == 2
    assert got[0]["total"] == 2
    rows = decoder.decoded(cases, r).collect()
    assert all(x["result"]["text"] == x["expected"] for x in rows)


def test_network_in_the_search():
    r = tiny()
    net = N.Network([np.array([[-1.0], [-1.0], [-1.0], [1.0], [1.0], [1.0]])], [np.array([2.5] * 3 + [-2.5] * 3)], 0, log_prior=np.zeros(6), phonemes=["a", "i"])
    r.network = net
    assert r.decode_features(frames((0.1, 6), (4.9, 6))).text == "あ い"
    r.network.phonemes = ["a", "q"]
    assert "い" not in r.decode_features(frames((0.1, 6))).text


def test_language_model_is_pruned_to_the_dictionary_and_bounded(spark):
    from phonoflow.operators import decoder, lm

    rows = spark.createDataFrame([(["a", "b", "c"],), (["a", "b", "x", "y"],), (["b", "c", "a", "z"],)], "words array<string>")
    model = lm.build(rows, 3)
    whole, some = decoder.language_model(model), decoder.language_model(model, {"a", "b", "c"})
    assert some.uni == whole.uni
    assert some.tri.keys() < whole.tri.keys()
    assert all(w in {"a", "b", "c", "<s>", "</s>"} for h, w in some.bi if h != "<s>")
    assert {k: v for k, v in whole.bi.items() if k[0] == "<s>"}.items() <= some.bi.items()
    with pytest.raises(ValueError, match="more than the 5"):
        decoder.language_model(model, {"a"}, most=5)


@pytest.mark.parametrize("seed", range(6))
def test_utterances_decoded_together_are_those_decoded_alone(seed):
    """Random emissions with ties, of several lengths, by random limits; with and without silence."""
    rng = np.random.default_rng(seed)
    model = {p: K.new_hmm(p, 1, 1, 3) for p in ("a", "k", "i", "sil")}
    words = {"あ": ["a"], "い": ["i"], "か": ["k", "a"], "き": ["k", "i"], "異": ["i"], "あい": ["a", "i"]} | ({"<sil>": ["sil"]} if seed % 2 else {})
    trie = S.Trie(words, model)
    uni = {w: (-1.0 - i / 8, -0.25) for i, w in enumerate(["<s>", "</s>", "あ", "い", "か", "あい"])}
    lm = S.LanguageModel(2 + seed % 2, uni, {("<s>", "あ"): (-0.5, -0.125), ("あ", "い"): (-0.25, 0.0)}, {("<s>", "あ", "い"): -0.125}, oov=-9.0)
    emits = [np.round(rng.normal(-2, 2, (frames, 3 * len(trie.models))) * 2) / 2 for frames in [1, 0, 9, 9, 17, 9, 17, 9]]
    for _ in range(12):
        cfg = S.SearchConfig(float(rng.choice([3, 12, 200])), int(rng.choice([0, 2, 7, 100])), float(rng.choice([0.5, 1, 4])), float(rng.choice([-2, 0, 1])), float(rng.choice([0, 0.5])), int(rng.choice([0, 1, 2])))
        assert S.decode_all(emits, trie, lm, cfg) == [S.decode(e, trie, lm, cfg) for e in emits]
