"""Frame-synchronous beam search over a lexicon trie, on arrays of tokens (C1-C8, A21, A22, O5, O6, F13, F14, L1 in memory).

A token is (node, state, last word, word before it, score, history); all tokens of a frame move at once. Everything is
ordered: words by bytes, tokens by key; of equal scores the earlier wins (Q5).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from phonoflow.functions.kernels import HALF, STATES, Hmm
from phonoflow.functions.phonemes import LOG_ZERO

SILENCE, START = "<sil>", "<s>"
#: Tokens that utterances decoded together may have between two frames.
BATCH_TOKENS = 1 << 15


@dataclass(frozen=True)
class SearchConfig:
    """C7. ``max_tokens`` and ``max_word_ends`` of 0 mean no limit (Q4)."""

    beam: float = 200.0
    max_tokens: int = 1000
    lm_weight: float = 10.0
    word_penalty: float = 0.0
    lm_interpolation: float = 0.0
    max_word_ends: int = 0


@dataclass
class LanguageModel:
    """L1, L3 in memory, natural logs: uni w -> (lp, back-off), bi (h, w) -> (lp, back-off), tri (h2, h1, w) -> lp."""

    order: int
    uni: dict[str, tuple[float, float]]
    bi: dict[tuple[str, str], tuple[float, float]] = field(default_factory=dict)
    tri: dict[tuple[str, str, str], float] = field(default_factory=dict)
    oov: float = 0.0

    def log_prob(self, history: list[str], w: str) -> float:
        """With back-off; an unseen context costs nothing."""
        if self.order >= 3 and len(history) >= 2:
            h2, h1 = history[-2:]
            if (h2, h1, w) in self.tri:
                return self.tri[h2, h1, w]
            return (self.bi[h2, h1][1] if (h2, h1) in self.bi else 0.0) + self._bigram(h1, w)
        return self._bigram(history[-1], w) if self.order >= 2 and history else self._unigram(w)

    def _bigram(self, h: str, w: str) -> float:
        if (h, w) in self.bi:
            return self.bi[h, w][0]
        return (self.uni[h][1] if h in self.uni else 0.0) + self._unigram(w)

    def _unigram(self, w: str) -> float:
        return self.uni[w][0] if w in self.uni else self.oov or LOG_ZERO

    def sentence(self, words: list[str]) -> float:
        """L2: both marks, full history."""
        seq = [START, *words, "</s>"]
        return sum(self.log_prob(seq[:i], seq[i]) for i in range(1, len(seq)))

    def best_start(self) -> float:
        """A22."""
        return max((self.log_prob([START], w) for w in self.uni), default=0.0)


def triphones(phonemes: list[str]) -> list[str]:
    """X8 in memory."""
    p = ["#", *phonemes, "#"]
    return [f"{a}-{b}+{c}" for a, b, c in zip(p, p[1:], p[2:], strict=False)]


class Trie:
    """Prefix tree of first pronunciations; a node is a phoneme with its model. Words that lack a model are left out."""

    def __init__(self, words: dict[str, list[str]], model: dict[str, Hmm]) -> None:
        self.words = sorted(words, key=lambda w: w.encode())
        self.number = {w: i + 1 for i, w in enumerate(self.words)}
        self.models: list[str] = []
        seen: dict[str, int] = {}
        node: list[int] = [-1]  # model of each node
        child: list[dict[tuple[str, int], int]] = [{}]
        self.ends: list[list[str]] = [[]]

        def ordinal(name: str) -> int:
            if name not in seen:
                seen[name] = len(self.models)
                self.models.append(name)
            return seen[name]

        for w in self.words:
            ph = words[w]
            if w == SILENCE or not ph:
                continue
            names = [t if t in model else p if p in model else None for t, p in zip(triphones(ph), ph, strict=True)]
            if None in names:
                continue
            at = 0
            for p, name in zip(ph, names, strict=True):
                key = (p, ordinal(name))
                if key not in child[at]:
                    child[at][key] = len(node)
                    node.append(key[1])
                    child.append({})
                    self.ends.append([])
                at = child[at][key]
            self.ends[at].append(w)
        sil = words.get(SILENCE) or []
        self.silence = ordinal(sil[0]) if sil and sil[0] in model else -1
        self.node_model = np.array(node)
        counts = [len(c) for c in child]
        self.first = np.r_[0, np.cumsum(counts)]
        self.child = np.array([x for c in child for x in c.values()], np.int64)
        self.root = self.child[: counts[0]]
        self.ending = np.array([bool(e) for e in self.ends])
        self.trans = np.stack([model[m].trans for m in self.models]) if self.models else np.zeros((0, 5, 5))


@dataclass(frozen=True)
class Word:
    """A recognised word with its first and last frame."""

    text: str
    start: int
    end: int


@dataclass(frozen=True)
class Result:
    """C6."""

    text: str = ""
    score: float = 0.0
    words: tuple[Word, ...] = ()


def decode(emit: np.ndarray, trie: Trie, lm: LanguageModel, cfg: SearchConfig = SearchConfig()) -> Result:  # noqa: B008
    """``emit`` is frames x 3 models of the trie, state 1 of model 0 first."""
    frames = len(emit)
    if not frames or not trie.models or (not len(trie.root) and trie.silence < 0):
        return Result()
    ahead = lm.best_start() * cfg.lm_weight
    word, before, came = [0], [0], [0]  # history nodes: word number, previous node, frame in which the word ended
    text = ["", *trie.words]

    @lru_cache(maxsize=None)
    def lm_score(h2: int, h1: int, w: str) -> float:
        history = [text[x] for x in (h2, h1) if x] or [START]
        weight = cfg.lm_weight
        if cfg.lm_interpolation > 0:
            if w not in lm.uni:
                weight *= 1 - cfg.lm_interpolation
            elif history[-1] != START and history[-1] not in lm.uni:
                weight *= 1 - cfg.lm_interpolation / 2
        return lm.log_prob(history, w) * weight

    sil = trie.silence
    model = np.r_[trie.node_model, sil]  # node -1 is the silence
    root_emit = 3 * model[trie.root]
    node = np.r_[trie.root, -1] if sil >= 0 else trie.root.copy()
    state = np.ones(len(node), np.int64)
    hist = np.zeros(len(node), np.int64)
    score = emit[0][3 * model[node]] + np.where(node >= 0, ahead, 0.0)

    def entries(base: np.ndarray, h: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, ...]:
        """From each base score into all root children, and into the silence."""
        k, n = len(trie.root), len(base)
        parts = [np.tile(trie.root, n)], [(base[:, None] + now[root_emit][None, :] + ahead).ravel()], [np.repeat(h, k)]
        if sil >= 0:
            parts[0].append(np.full(n, -1))
            parts[1].append(base + now[3 * sil])
            parts[2].append(h)
        a, b, c = (np.concatenate(p) for p in parts)
        return a, np.ones(len(a), np.int64), c, b

    for t in range(1, frames):
        now = emit[t]
        m = model[node]
        moves = trie.trans[m, state]
        stay = moves[np.arange(len(node)), state]
        on = moves[np.arange(len(node)), np.minimum(state + 1, STATES)]
        out = np.where(moves[:, STATES + 1] <= LOG_ZERO + 1, HALF, moves[:, STATES + 1])  # Q3
        base = score + out
        ok = stay > LOG_ZERO + 1
        step = (state < STATES) & (on > LOG_ZERO + 1)
        parts = [(node[ok], state[ok], hist[ok], score[ok] + stay[ok] + now[3 * m[ok] + state[ok] - 1]), (node[step], state[step] + 1, hist[step], score[step] + on[step] + now[3 * m[step] + state[step]])]
        inner = np.flatnonzero(node >= 0)
        counts = trie.first[node[inner] + 1] - trie.first[node[inner]]
        who = np.repeat(inner, counts)
        if len(who):
            kid = trie.child[np.repeat(trie.first[node[inner]], counts) + np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)]
            parts.append((kid, np.ones(len(kid), np.int64), hist[who], base[who] + now[3 * model[kid]]))
        best = max((float(p[3].max()) for p in parts if len(p[3])), default=-np.inf)
        alive = base >= best - cfg.beam  # F14
        quiet = np.flatnonzero((node < 0) & alive)
        if len(quiet):
            parts.append(entries(base[quiet], hist[quiet], now))
        done: list[tuple[float, int, int]] = []
        for i in np.flatnonzero((node >= 0) & alive):
            if trie.ending[node[i]]:
                h = int(hist[i])
                h1 = word[h]
                h2 = word[before[h]] if h else 0
                for w in trie.ends[node[i]]:
                    done.append((float(base[i]) - ahead + lm_score(h2, h1, w) + cfg.word_penalty, h, trie.number[w]))
        if cfg.max_word_ends and len(done) > cfg.max_word_ends:
            done = sorted(done, key=lambda d: (-d[0], d[2], word[d[1]]))[: cfg.max_word_ends]  # O6
        if done:
            fresh = []
            for _, h, w in done:
                word.append(w)
                before.append(h)
                came.append(t)
                fresh.append(len(word) - 1)
            parts.append(entries(np.array([d[0] for d in done]), np.array(fresh), now))
        node, state, hist, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(node):
            return Result()
        keep = score >= score.max() - cfg.beam  # F13
        node, state, hist, score = node[keep], state[keep], hist[keep], score[keep]
        last = np.array(word)[hist]
        prev = np.array(word)[np.array(before)[hist]]
        order = np.lexsort((-score, prev, last, state, node))  # A21: stable, so of equal scores the earlier stays
        same = np.zeros(len(order), bool)
        for k in (node, state, last, prev):
            v = k[order]
            same[1:] |= v[1:] != v[:-1]
        same[:1] = True
        order = order[same]
        if cfg.max_tokens and len(order) > cfg.max_tokens:
            order = order[np.sort(np.argsort(-score[order], kind="stable")[: cfg.max_tokens])]  # O5
        node, state, hist, score = node[order], state[order], hist[order], score[order]

    i = int(np.argmax(score))
    h, top, final = int(hist[i]), float(score[i]), None
    if node[i] >= 0 and trie.ends[node[i]]:
        h1, h2 = word[h], word[before[h]] if h else 0
        s, w = max(((lm_score(h2, h1, w) - ahead + cfg.word_penalty + top, w) for w in trie.ends[node[i]]), key=lambda x: x[0])
        if s > top - cfg.beam:
            final = w
    chain: list[tuple[str, int]] = [] if final is None else [(final, frames)]
    while h:
        chain.append((text[word[h]], came[h]))
        h = before[h]
    chain.reverse()
    return _result(chain, frames, top)


def _result(chain: list[tuple[str, int]], frames: int, score: float) -> Result:
    """Of (word, frame in which it ended), in order; there may be none."""
    if not chain:
        return Result("", score)
    starts = [0, *[end for _, end in chain[:-1]]]
    # a word's frames end where the next one's start (Q2); silence behind the last word counts to it
    words = tuple(Word(w, a, b - 1) for (w, _), a, b in zip(chain, starts, [*starts[1:], frames], strict=True))
    return Result(" ".join(w for w, _ in chain), score, words)


def _best_of(values: np.ndarray, who: np.ndarray, n: int) -> np.ndarray:
    """The greatest value of each of n utterances."""
    out = np.full(n, -np.inf)
    np.maximum.at(out, who, values)
    return out


def _place(who: np.ndarray) -> np.ndarray:
    """The place of each row among those of its utterance; ``who`` ascends."""
    return np.arange(len(who)) - np.searchsorted(who, who)


def decode_all(emits: list[np.ndarray], trie: Trie, lm: LanguageModel, cfg: SearchConfig = SearchConfig()) -> list[Result]:  # noqa: B008
    """:func:`decode` of many utterances: those of a length move together, as many as BATCH_TOKENS allows."""
    out: list[Result] = [Result()] * len(emits)
    if not trie.models or (not len(trie.root) and trie.silence < 0):
        return out
    by_length: dict[int, list[int]] = {}
    for i, e in enumerate(emits):
        if len(e):
            by_length.setdefault(len(e), []).append(i)
    step = max(1, BATCH_TOKENS // max(cfg.max_tokens or 1000, 3 * len(trie.node_model) if not cfg.max_tokens else 1))
    for ids in by_length.values():
        for at in range(0, len(ids), step):
            some = ids[at : at + step]
            for i, r in zip(some, _decode_together(np.stack([emits[i] for i in some]), trie, lm, cfg), strict=True):
                out[i] = r
    return out


def _decode_together(emit: np.ndarray, trie: Trie, lm: LanguageModel, cfg: SearchConfig) -> list[Result]:
    """Utterances x frames x 3 models. Tokens carry their utterance, by which they are ordered first; all else is as in :func:`decode`."""
    n, frames = emit.shape[:2]
    ahead = lm.best_start() * cfg.lm_weight
    word, before, came = (np.zeros(1, np.int64) for _ in range(3))
    text = ["", *trie.words]
    end_first = np.r_[0, np.cumsum([len(e) for e in trie.ends])]
    end_word = np.array([trie.number[w] for e in trie.ends for w in e], np.int64)

    @lru_cache(maxsize=None)
    def lm_score(h2: int, h1: int, w: str) -> float:
        history = [text[x] for x in (h2, h1) if x] or [START]
        weight = cfg.lm_weight
        if cfg.lm_interpolation > 0:
            if w not in lm.uni:
                weight *= 1 - cfg.lm_interpolation
            elif history[-1] != START and history[-1] not in lm.uni:
                weight *= 1 - cfg.lm_interpolation / 2
        return lm.log_prob(history, w) * weight

    sil = trie.silence
    model = np.r_[trie.node_model, sil]
    root = np.r_[trie.root, -1] if sil >= 0 else trie.root.copy()
    k = len(root)
    gain = np.where(root >= 0, ahead, 0.0)

    def entries(base: np.ndarray, h: np.ndarray, u: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, ...]:
        got = base[:, None] + now[u[:, None], 3 * model[root][None, :]] + gain[None, :]
        return np.tile(root, len(base)), np.ones(k * len(base), np.int64), np.repeat(h, k), got.ravel(), np.repeat(u, k)

    utt = np.repeat(np.arange(n), k)
    node, state, hist = np.tile(root, n), np.ones(n * k, np.int64), np.zeros(n * k, np.int64)
    score = emit[utt, 0, 3 * model[node]] + np.where(node >= 0, ahead, 0.0)
    for t in range(1, frames):
        now = emit[:, t]
        m = model[node]
        moves = trie.trans[m, state]
        at = np.arange(len(node))
        stay, on = moves[at, state], moves[at, np.minimum(state + 1, STATES)]
        base = score + np.where(moves[:, STATES + 1] <= LOG_ZERO + 1, HALF, moves[:, STATES + 1])  # Q3
        ok = stay > LOG_ZERO + 1
        step = (state < STATES) & (on > LOG_ZERO + 1)
        parts = [
            (node[ok], state[ok], hist[ok], score[ok] + stay[ok] + now[utt[ok], 3 * m[ok] + state[ok] - 1], utt[ok]),
            (node[step], state[step] + 1, hist[step], score[step] + on[step] + now[utt[step], 3 * m[step] + state[step]], utt[step]),
        ]
        inner = np.flatnonzero(node >= 0)
        counts = trie.first[node[inner] + 1] - trie.first[node[inner]]
        who = np.repeat(inner, counts)
        if len(who):
            kid = trie.child[np.repeat(trie.first[node[inner]], counts) + np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)]
            parts.append((kid, np.ones(len(kid), np.int64), hist[who], base[who] + now[utt[who], 3 * model[kid]], utt[who]))
        best = _best_of(np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts]), n)
        alive = base >= best[utt] - cfg.beam  # F14
        quiet = np.flatnonzero((node < 0) & alive)
        if len(quiet):
            parts.append(entries(base[quiet], hist[quiet], utt[quiet], now))
        ends = np.flatnonzero((node >= 0) & alive & trie.ending[node])
        if len(ends):
            counts = end_first[node[ends] + 1] - end_first[node[ends]]
            who = np.repeat(ends, counts)
            w = end_word[np.repeat(end_first[node[ends]], counts) + np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)]
            h, u = hist[who], utt[who]
            h1, h2 = word[h], word[before[h]]
            asked, back = np.unique(np.stack([h2, h1, w], 1), axis=0, return_inverse=True)
            said = np.array([lm_score(int(a), int(b), text[c]) for a, b, c in asked])[back.ravel()]
            value = base[who] - ahead + said + cfg.word_penalty
            if cfg.max_word_ends:
                over = np.bincount(u, minlength=n)[u] > cfg.max_word_ends
                order = np.lexsort((np.where(over, h1, 0), np.where(over, w, 0), np.where(over, -value, 0), u))  # O6
                order = order[_place(u[order]) < cfg.max_word_ends]
                value, h, w, u = value[order], h[order], w[order], u[order]
            fresh = len(word) + np.arange(len(w))
            word, before, came = np.r_[word, w], np.r_[before, h], np.r_[came, np.full(len(w), t)]
            parts.append(entries(value, fresh, u, now))
        node, state, hist, score, utt = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = score >= _best_of(score, utt, n)[utt] - cfg.beam  # F13
        node, state, hist, score, utt = node[keep], state[keep], hist[keep], score[keep], utt[keep]
        last, prev = word[hist], word[before[hist]]
        order = np.lexsort((-score, prev, last, state, node, utt))  # A21: stable, so of equal scores the earlier stays
        same = np.zeros(len(order), bool)
        for c in (utt, node, state, last, prev):
            v = c[order]
            same[1:] |= v[1:] != v[:-1]
        same[:1] = True
        order = order[same]
        if cfg.max_tokens:
            best_first = np.lexsort((-score[order], utt[order]))
            order = order[np.sort(best_first[_place(utt[order][best_first]) < cfg.max_tokens])]  # O5
        node, state, hist, score, utt = node[order], state[order], hist[order], score[order], utt[order]

    out = [Result()] * n
    first = np.lexsort((-score, utt))
    for i in first[_place(utt[first]) == 0]:
        h, top, final = int(hist[i]), float(score[i]), None
        if node[i] >= 0 and trie.ends[node[i]]:
            h1, h2 = int(word[h]), int(word[before[h]])
            s, w = max(((lm_score(h2, h1, w) - ahead + cfg.word_penalty + top, w) for w in trie.ends[node[i]]), key=lambda x: x[0])
            if s > top - cfg.beam:
                final = w
        chain: list[tuple[str, int]] = [] if final is None else [(final, frames)]
        while h:
            chain.append((text[word[h]], int(came[h])))
            h = int(before[h])
        chain.reverse()
        out[utt[i]] = _result(chain, frames, top)
    return out


def emission_matrix(trie: Trie, per_model: dict[str, np.ndarray]) -> np.ndarray:
    """C4: frames x 3 models from frames x 3 arrays by model name."""
    return np.concatenate([per_model[m] for m in trie.models], 1)


def class_emissions(trie: Trie, model: dict[str, Hmm], scores: np.ndarray, phonemes: list[str]) -> np.ndarray:
    """C4 from a network's classes; LOG_ZERO for a phoneme without one (Q11)."""
    out = np.full((len(scores), 3 * len(trie.models)), LOG_ZERO)
    for k, m in enumerate(trie.models):
        if model[m].phoneme in phonemes:
            c = 3 * phonemes.index(model[m].phoneme)
            out[:, 3 * k : 3 * k + 3] = scores[:, c : c + 3]
    return out
