"""Numpy kernels that run inside Arrow functions: spectra, cepstra, Gaussian mixtures and hidden Markov recursions.

D4, D5, D8, D12-D18, D24; M1-M3, M7-M12; A12-A16; I1-I8. None of them knows Spark.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np

from phonoflow.functions.phonemes import LOG_ZERO
from phonoflow.functions.signal import KNEE_HIGH, KNEE_LOW, hamming_window, lifter_weights

STATES = 3
HALF = math.log(0.5)
ALPHAS = [round(0.82 + 0.02 * i, 2) for i in range(20)]


# ---------------------------------------------------------------- features
@dataclass(frozen=True)
class FeatureConfig:
    """Parameters of the cepstra."""

    rate: int = 16000
    frame_ms: float = 25.0
    shift_ms: float = 10.0
    emphasis: float = 0.97
    filters: int = 26
    cepstra: int = 13
    low: float = 0.0
    high: float = 8000.0
    n_fft: int = 512
    delta: bool = True
    delta_delta: bool = True
    lifter: int = 22
    mean_norm: bool = True
    alpha: float = 1.0

    @property
    def frame(self) -> int:
        return int(self.frame_ms * self.rate / 1000)

    @property
    def shift(self) -> int:
        return int(self.shift_ms * self.rate / 1000)

    @property
    def dim(self) -> int:
        """D24; what is counted is also appended (Q7)."""
        return self.cepstra * (1 + self.delta + self.delta_delta)


def warp(f: float, alpha: float, low: float, high: float) -> float:
    """D7 for one frequency."""
    if f <= KNEE_LOW:
        return f * alpha if low == KNEE_LOW else low + (f - low) * (KNEE_LOW * alpha - low) / (KNEE_LOW - low)
    if f < KNEE_HIGH or high == KNEE_HIGH:
        return f * alpha
    return KNEE_HIGH * alpha + (f - KNEE_HIGH) * (high - KNEE_HIGH * alpha) / (high - KNEE_HIGH)


def mel_bank(filters: int, n_fft: int, rate: int, low: float, high: float, alpha: float = 1.0) -> np.ndarray:
    """Filters x (n_fft / 2 + 1) weights of triangles between mel-spaced bins."""
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    at = [mel(low) + i * (mel(high) - mel(low)) / (filters + 1) for i in range(filters + 2)]
    hz = [700 * (10 ** (m / 2595) - 1) for m in at]
    edge = [math.floor((warp(f, alpha, low, high) if alpha != 1 else f) * (n_fft + 1) / rate) for f in hz]
    bank, bins = np.zeros((filters, n_fft // 2 + 1)), np.arange(n_fft // 2 + 1)
    for row, (a, b, c) in zip(bank, zip(edge, edge[1:], edge[2:]), strict=False):
        up, down = (bins >= a) & (bins < b), (bins >= b) & (bins <= c)
        if b > a:
            row[up] = (bins[up] - a) / (b - a)
        if c > b:
            row[down] = (c - bins[down]) / (c - b)
    return bank


def dct_matrix(n: int, count: int) -> np.ndarray:
    """Count x n, not normalised."""
    return np.cos(np.pi * np.arange(count)[:, None] * (np.arange(n) + 0.5) / n)


def framed(x: np.ndarray, length: int, shift: int) -> np.ndarray:
    """D2."""
    return np.lib.stride_tricks.sliding_window_view(x, length)[::shift] if len(x) >= length else np.zeros((0, length))


def power_spectrum(frames: np.ndarray, n_fft: int) -> np.ndarray:
    """|FFT|^2 / n_fft of zero-padded frames."""
    f = np.fft.rfft(frames, n_fft, axis=-1)
    return (f.real**2 + f.imag**2) / n_fft


def spectra(x: np.ndarray, cfg: FeatureConfig) -> np.ndarray:
    """Windowed power spectra of all frames of a signal."""
    y = np.r_[x[:1], x[1:] - cfg.emphasis * x[:-1]]
    return power_spectrum(framed(y, cfg.frame, cfg.shift) * np.array(hamming_window(cfg.frame)), cfg.n_fft)


def deltas(x: np.ndarray, reach: int = 2) -> np.ndarray:
    """D14."""
    at = np.arange(len(x))
    out = sum(k * (x[np.minimum(at + k, len(x) - 1)] - x[np.maximum(at - k, 0)]) for k in range(1, reach + 1))
    return out / (2 * sum(k * k for k in range(1, reach + 1)))


def from_spectra(power: np.ndarray, cfg: FeatureConfig) -> np.ndarray:
    """D9, D10, D11, D13, D15 of power spectra."""
    bank = mel_bank(cfg.filters, cfg.n_fft, cfg.rate, cfg.low, cfg.high, cfg.alpha)
    c = np.log(np.maximum(power @ bank.T, 1e-30)) @ dct_matrix(cfg.filters, cfg.cepstra).T
    if cfg.lifter > 0:
        c = c * np.array(lifter_weights(cfg.cepstra, cfg.lifter))
    if cfg.mean_norm and len(c):
        c = c - c.mean(0)
    parts = [c]
    if len(c) and (cfg.delta or cfg.delta_delta):
        d = deltas(c)
        parts += [d] * cfg.delta + ([deltas(d)] if cfg.delta_delta else [])
    return np.concatenate(parts, 1)


def mfcc(x: np.ndarray, cfg: FeatureConfig = FeatureConfig()) -> np.ndarray:  # noqa: B008
    """D12; F17: too little audio for one frame is an error."""
    if not len(x):
        raise ValueError("empty samples")
    if len(x) < cfg.frame:
        raise ValueError("audio too short for a single frame")
    return from_spectra(spectra(x, cfg), cfg)


def best_warp(x: np.ndarray, cfg: FeatureConfig, score) -> tuple[np.ndarray, float]:
    """Features of the warp that ``score`` likes best; the first of equals."""
    power = spectra(x, cfg)
    tried = [(from_spectra(power, replace(cfg, alpha=a)), a) for a in ALPHAS]
    return max(tried, key=lambda t: (score(t[0]), -t[1]))


# ---------------------------------------------------------------- mixtures
def log_sum_exp(a: np.ndarray, axis: int = -1) -> np.ndarray:
    """A14; LOG_ZERO where nothing is above it."""
    top = a.max(axis=axis, keepdims=True)
    out = np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis=axis))
    return np.where(np.squeeze(top, axis) <= LOG_ZERO + 1, LOG_ZERO, out)


def log_sub(a: float, b: float) -> float:
    """log(exp(a) - exp(b)); LOG_ZERO for b >= a."""
    return a + math.log1p(-math.exp(b - a)) if b < a else LOG_ZERO


@dataclass
class Hmm:
    """M5: a left-to-right phoneme model: trans is 5 x 5 in logs; mean and var are 3 x mixtures x dim, log_weight 3 x mixtures."""

    phoneme: str
    mean: np.ndarray
    var: np.ndarray
    log_weight: np.ndarray
    trans: np.ndarray = field(default_factory=lambda: default_transitions())

    def clone(self) -> Hmm:
        return Hmm(self.phoneme, self.mean.copy(), self.var.copy(), self.log_weight.copy(), self.trans.copy())


def default_transitions() -> np.ndarray:
    """M5: in by state 1; stay or go on with one half."""
    t = np.full((STATES + 2, STATES + 2), LOG_ZERO)
    t[0, 1] = 0.0
    for i in range(1, STATES + 1):
        t[i, i] = t[i, i + 1] = HALF
    return t


def new_hmm(phoneme: str, dim: int, mixtures: int, seed: int = 0) -> Hmm:
    """M4: normal means of a fixed seed (Q9), unit variances, equal weights."""
    rng = np.random.default_rng([seed, *phoneme.encode()])
    return Hmm(phoneme, rng.normal(size=(STATES, mixtures, dim)), np.ones((STATES, mixtures, dim)), np.full((STATES, mixtures), -math.log(mixtures)))


def component_logs(x: np.ndarray, mean: np.ndarray, var: np.ndarray, log_weight: np.ndarray) -> np.ndarray:
    """M1, M3: frames x mixtures log(weight * density), as two matrix products."""
    inv = 1 / var
    bias = log_weight - 0.5 * (x.shape[1] * math.log(2 * math.pi) + np.log(var).sum(1) + (mean * mean * inv).sum(1))
    return -0.5 * (x * x) @ inv.T + x @ (mean * inv).T + bias


def mixture_logs(x: np.ndarray, mean: np.ndarray, var: np.ndarray, log_weight: np.ndarray) -> np.ndarray:
    """M2: log-likelihood of every frame."""
    return log_sum_exp(component_logs(x, mean, var, log_weight))


def emissions(h: Hmm, x: np.ndarray) -> np.ndarray:
    """M9: frames x states."""
    return np.stack([mixture_logs(x, h.mean[s], h.var[s], h.log_weight[s]) for s in range(STATES)], 1)


def frame_likelihood(hmms: list[Hmm], x: np.ndarray) -> float:
    """The sum over frames of the best state's log-likelihood; minus infinity without frames or states."""
    return float(np.concatenate([emissions(h, x) for h in hmms], 1).max(1).sum()) if len(x) and hmms else -math.inf


# ---------------------------------------------------------------- recursions
def forward(trans: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """M7: frames x states."""
    a, inner = np.full(emit.shape, LOG_ZERO), trans[1:-1, 1:-1]
    a[0] = np.where(trans[0, 1:-1] > LOG_ZERO + 1, trans[0, 1:-1] + emit[0], LOG_ZERO)
    for t in range(1, len(emit)):
        s = log_sum_exp(np.maximum(a[t - 1][:, None] + inner, LOG_ZERO), 0)
        a[t] = np.where(s > LOG_ZERO + 1, s + emit[t], LOG_ZERO)
    return a


def backward(trans: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """M8; the last frame holds the exits."""
    b, inner = np.full(emit.shape, LOG_ZERO), trans[1:-1, 1:-1]
    b[-1] = trans[1:-1, -1]
    for t in range(len(emit) - 2, -1, -1):
        b[t] = log_sum_exp(np.maximum(inner + (emit[t + 1] + b[t + 1])[None, :], LOG_ZERO), 1)
    return b


def total_likelihood(alpha: np.ndarray) -> float:
    """Without the exit."""
    return float(log_sum_exp(alpha[-1]))


@dataclass
class Statistics:
    """Sums over sequences, in plain numbers: transitions 3 x 4 (the last is the exit), occupancy, first and second moments."""

    ll: float
    moves: np.ndarray
    occupancy: np.ndarray
    first: np.ndarray
    second: np.ndarray

    def __add__(self, o: Statistics) -> Statistics:
        return Statistics(self.ll + o.ll, self.moves + o.moves, self.occupancy + o.occupancy, self.first + o.first, self.second + o.second)


def empty_statistics(h: Hmm) -> Statistics:
    """Of no sequence."""
    return Statistics(0.0, np.zeros((STATES, STATES + 1)), np.zeros(h.log_weight.shape), np.zeros(h.mean.shape), np.zeros(h.mean.shape))


def statistics(h: Hmm, x: np.ndarray) -> Statistics:
    """A12 of one sequence; one without any path adds nothing."""
    out = empty_statistics(h)
    if not len(x):
        return out
    parts = [component_logs(x, h.mean[s], h.var[s], h.log_weight[s]) for s in range(STATES)]
    emit = np.stack([log_sum_exp(p) for p in parts], 1)
    a, b = forward(h.trans, emit), backward(h.trans, emit)
    ll = float(log_sum_exp(a[-1] + b[-1]))
    if ll <= LOG_ZERO + 1:
        return out
    out.ll = ll
    inner = h.trans[1:-1, 1:-1]
    if len(x) > 1:
        xi = a[:-1, :, None] + inner[None] + (emit[1:] + b[1:])[:, None, :] - ll
        out.moves[:, :STATES] = np.exp(xi).sum(0)
    out.moves[:, STATES] = np.exp(a[-1] + h.trans[1:-1, -1] - ll)
    gamma = a + b - ll
    for s in range(STATES):
        post = np.exp(gamma[:, s : s + 1] + parts[s] - emit[:, s : s + 1])
        out.occupancy[s] = post.sum(0)
        out.first[s], out.second[s] = post.T @ x, post.T @ (x * x)
    return out


def re_estimated(h: Hmm, s: Statistics, floor: float = 0.01) -> Hmm:
    """The entry stays; so does what has an occupancy below 1e-30; variances have a floor."""
    new = h.clone()
    for i in range(STATES):
        total = s.moves[i].sum()
        if total > 0:
            with np.errstate(divide="ignore"):
                new.trans[i + 1, 1:] = np.where(s.moves[i] > 0, np.log(s.moves[i] / total), LOG_ZERO)
        use = s.occupancy[i] >= 1e-30
        occ = s.occupancy[i][use]
        new.log_weight[i, use] = np.log(occ / s.occupancy[i].sum()) if use.any() else new.log_weight[i, use]
        new.mean[i, use] = s.first[i][use] / occ[:, None]
        new.var[i, use] = np.maximum(s.second[i][use] / occ[:, None] - new.mean[i, use] ** 2, floor)
    return new


def trained(h: Hmm, sequences: list[np.ndarray], iterations: int = 20, threshold: float = 0.01, floor: float = 0.01) -> tuple[Hmm, list[float]]:
    """(model, log-likelihood of each E-step). Converged is tested before the M-step."""
    if not sequences:
        raise ValueError("no training sequences")
    history: list[float] = []
    for i in range(iterations):
        s = sum((statistics(h, x) for x in sequences), empty_statistics(h))
        history.append(s.ll)
        if i and history[-1] - history[-2] < threshold:
            break
        h = re_estimated(h, s, floor)
    return h, history


def align(hmms: list[Hmm], emit: np.ndarray) -> np.ndarray:
    """The best path's flat state (3 * position + state - 1) at each frame. Ties go to staying, then to the state before.

    ``emit`` is frames x 3N. Errors: no phoneme, fewer frames than phonemes, no path (fewer than 3 frames a phoneme).
    """
    t_all, n = len(emit), len(hmms)
    if not n:
        raise ValueError("empty phoneme sequence")
    if t_all < n:
        raise ValueError(f"too few frames ({t_all}) for {n} phonemes")
    size = n * STATES
    stay, come = np.empty(size), np.empty(size)
    for p, h in enumerate(hmms):
        for s in range(STATES):
            stay[p * STATES + s] = h.trans[s + 1, s + 1]
            if s:
                come[p * STATES + s] = h.trans[s, s + 1]
            elif p:
                out = hmms[p - 1].trans[STATES, STATES + 1]
                come[p * STATES] = HALF if out <= LOG_ZERO + 1 else out
            else:
                come[0] = LOG_ZERO
    score = np.full(size, LOG_ZERO)
    score[0] = hmms[0].trans[0, 1] + emit[0, 0]
    moved = np.zeros((t_all, size), bool)
    for t in range(1, t_all):
        keep = score + stay
        step = np.r_[LOG_ZERO, score[:-1]] + come
        moved[t] = step > np.maximum(keep, LOG_ZERO)
        best = np.where(moved[t], step, keep)
        score = np.where(best > LOG_ZERO + 1, best + emit[t], LOG_ZERO)
    last = size - STATES + int(np.argmax(score[-STATES:]))
    if score[last] <= LOG_ZERO + 1:
        raise ValueError("no valid path")
    path = np.empty(t_all, np.int64)
    for t in range(t_all - 1, -1, -1):
        path[t] = last
        last -= moved[t, last]
    return path


def segments(path: np.ndarray) -> list[tuple[int, int, int]]:
    """(position, first frame, frame after the last) of runs of one position."""
    p = path // STATES
    cut = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
    return [(int(p[a]), int(a), int(b)) for a, b in zip(cut, np.r_[cut[1:], len(p)], strict=True)]
