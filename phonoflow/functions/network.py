"""A feed-forward network in numpy: forward pass, gradients, Adam, batch norm, dropout, label smoothing."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from phonoflow.functions.phonemes import PHONEMES

BN_EPS, BN_MOMENTUM = 1e-5, 0.1


@dataclass
class Network:
    """Weights (out x in), biases and, with batch norm, (gamma, beta, running mean, running variance) of hidden layers."""

    w: list[np.ndarray]
    b: list[np.ndarray]
    context: int = 5
    dropout: float = 0.0
    bn: list[list[np.ndarray]] | None = None
    log_prior: np.ndarray | None = None
    phonemes: list[str] = field(default_factory=lambda: list(PHONEMES))

    def parameters(self) -> list[np.ndarray]:
        """What training changes, in a fixed order."""
        return [*self.w, *self.b, *([x for g in self.bn for x in g[:2]] if self.bn else [])]


def new_network(feature_dim: int, hidden: int = 256, context: int = 5, layers: int = 2, dropout: float = 0.0, batch_norm: bool = False, seed: int = 0, phonemes: list[str] | None = None, outputs: int | None = None) -> Network:
    """Normal weights, by fan-in for hidden layers with batch norm, else by fan-in and fan-out; a fixed seed (Q9)."""
    phonemes = list(PHONEMES) if phonemes is None else phonemes
    rng, sizes = np.random.default_rng(seed), [(2 * context + 1) * feature_dim, *[hidden] * layers, outputs or 3 * len(phonemes)]
    w = []
    for i, (n_in, n_out) in enumerate(zip(sizes, sizes[1:], strict=False)):
        scale = math.sqrt(2 / n_in) if batch_norm and i < layers else math.sqrt(2 / (n_in + n_out))
        w.append(rng.normal(0, scale, (n_out, n_in)))
    bn = [[np.ones(hidden), np.zeros(hidden), np.zeros(hidden), np.ones(hidden)] for _ in range(layers)] if batch_norm else None
    return Network(w, [np.zeros(n) for n in sizes[1:]], context, dropout, bn, np.zeros(sizes[-1]), phonemes)


def log_softmax(z: np.ndarray) -> np.ndarray:
    """Rows of log-probabilities."""
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def forward(net: Network, x: np.ndarray) -> np.ndarray:
    """Log posteriors; batch norm by running statistics, no dropout."""
    for i, (w, b) in enumerate(zip(net.w, net.b, strict=True)):
        x = x @ w.T + b
        if i < len(net.w) - 1:
            if net.bn:
                gamma, beta, mean, var = net.bn[i]
                x = gamma * (x - mean) / np.sqrt(var + BN_EPS) + beta
            x = np.maximum(x, 0)
    return log_softmax(x)


def windows(features: np.ndarray, context: int) -> np.ndarray:
    """Frames x (2 context + 1) dim, the ends repeated."""
    at = np.clip(np.arange(len(features))[:, None] + np.arange(-context, context + 1), 0, max(len(features) - 1, 0))
    return features[at].reshape(len(features), -1)


def likelihoods(net: Network, features: np.ndarray) -> np.ndarray:
    """Pseudo log-likelihoods of every frame's classes."""
    return forward(net, windows(features, net.context)) - net.log_prior


@dataclass
class Gradients:
    """Sums over rows, in the order of ``parameters``; loss, hits and rows; batch mean and variance times rows."""

    g: list[np.ndarray]
    loss: float
    hits: int
    rows: int
    moments: list[tuple[np.ndarray, np.ndarray]]

    def __add__(self, o: Gradients) -> Gradients:
        return Gradients([a + b for a, b in zip(self.g, o.g, strict=True)], self.loss + o.loss, self.hits + o.hits, self.rows + o.rows, [(a[0] + b[0], a[1] + b[1]) for a, b in zip(self.moments, o.moments, strict=True)])


def gradients(net: Network, x: np.ndarray, target: np.ndarray, smooth: float = 0.0, rng: np.random.Generator | None = None) -> Gradients:
    """Of the (smoothed) cross-entropy, added over the rows of one batch."""
    n, last = len(x), len(net.w) - 1
    inputs, kept, norm, moments = [], [], [], []
    a = x
    for i in range(last):
        inputs.append(a)
        z = a @ net.w[i].T + net.b[i]
        if net.bn:
            gamma, beta = net.bn[i][:2]
            mean, var = z.mean(0), z.var(0)
            inv = 1 / np.sqrt(var + BN_EPS)
            hat = (z - mean) * inv
            norm.append((hat, inv))
            moments.append((mean * n, var * n))
            z = gamma * hat + beta
        a = np.maximum(z, 0)
        mask = (z > 0).astype(float)
        if net.dropout > 0 and rng is not None:
            drop = (rng.random(a.shape) >= net.dropout) / (1 - net.dropout)
            a, mask = a * drop, mask * drop
        kept.append(mask)
    inputs.append(a)
    logs = log_softmax(a @ net.w[last].T + net.b[last])
    p, classes = np.exp(logs), logs.shape[1]
    y = np.full((n, classes), smooth / classes)
    y[np.arange(n), target] += 1 - smooth
    loss = -float((y * np.log(np.maximum(p, 1e-30))).sum())
    d = p - y
    gw, gb, gn = [None] * (last + 1), [None] * (last + 1), []
    for i in range(last, -1, -1):
        if i < last:
            d = (d @ net.w[i + 1]) * kept[i]
            if net.bn:
                hat, inv = norm[i]
                gn = [(d * hat).sum(0), d.sum(0), *gn]
                h = d * net.bn[i][0]
                d = inv / n * (n * h - h.sum(0) - hat * (h * hat).sum(0))
        gw[i], gb[i] = d.T @ inputs[i], d.sum(0)
    return Gradients([*gw, *gb, *gn], loss, int((p.argmax(1) == target).sum()), n, moments)


@dataclass
class Adam:
    """Moments of every parameter."""

    rate: float = 0.001
    beta1: float = 0.9
    beta2: float = 0.999
    eps: float = 1e-8
    t: int = 0
    m: list[np.ndarray] | None = None
    v: list[np.ndarray] | None = None

    def step(self, parameters: list[np.ndarray], g: list[np.ndarray], scale: float, rate: float | None = None) -> None:
        """In place; gradients are multiplied by ``scale``."""
        if self.m is None:
            self.m, self.v = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
        self.t += 1
        for p, x, m, v in zip(parameters, g, self.m, self.v, strict=True):
            x = x * scale
            m += (1 - self.beta1) * (x - m)
            v += (1 - self.beta2) * (x * x - v)
            p -= (rate or self.rate) * (m / (1 - self.beta1**self.t)) / (np.sqrt(v / (1 - self.beta2**self.t)) + self.eps)


def cosine_rate(rate: float, epoch: int, epochs: int) -> float:
    """From the rate down to a hundredth of it."""
    low = rate * 0.01
    return low + (rate - low) * 0.5 * (1 + math.cos(math.pi * epoch / epochs))


def update(net: Network, adam: Adam, g: Gradients, rate: float) -> None:
    """One step: weights by Adam, running statistics by their moving average."""
    adam.step(net.parameters(), g.g, 1 / g.rows, rate)
    for s, (mean, var) in zip(net.bn or [], g.moments, strict=True):
        s[2] += BN_MOMENTUM * (mean / g.rows - s[2])
        s[3] += BN_MOMENTUM * (var / g.rows - s[3])


def evaluate(net: Network, x: np.ndarray, target: np.ndarray) -> tuple[float, float]:
    """(loss, accuracy)."""
    logs = forward(net, x)
    return -float(logs[np.arange(len(x)), target].mean()), float((logs.argmax(1) == target).mean())


def fit(net: Network, x: np.ndarray, target: np.ndarray, rate: float = 0.001, epochs: int = 20, batch: int = 256, workers: int = 8, held_out: float = 0.1, patience: int = 3, smooth: float = 0.0, schedule: str = "", seed: int = 0) -> list[tuple[float, float, float, float]]:
    """(train loss, train accuracy, held-out loss, held-out accuracy) by epoch; ``net`` changes in place.

    A step is ``workers`` batches, each with batch statistics of its own. The last weights stay, not the best (Q17).
    """
    if not len(target):
        raise ValueError("no training samples")
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(target))
    cut = len(target) - max(1, int(len(target) * held_out))
    own, other = order[:cut], order[cut:]
    adam, best, bad, log = Adam(rate), math.inf, 0, []
    for epoch in range(epochs):
        lr = cosine_rate(rate, epoch, epochs) if schedule == "cosine" else rate
        rng.shuffle(own)
        loss, hits = 0.0, 0
        for at in range(0, len(own), batch * workers):
            parts = [own[s : s + batch] for s in range(at, min(len(own), at + batch * workers), batch)]
            got = [gradients(net, x[i], target[i], smooth, rng) for i in parts]
            total = got[0]
            for g in got[1:]:
                total = total + g
            update(net, adam, total, lr)
            loss, hits = loss + total.loss, hits + total.hits
        held = evaluate(net, x[other], target[other])
        log.append((loss / max(1, len(own)), hits / max(1, len(own)), *held))
        if patience > 0:
            best, bad = (held[0], 0) if held[0] < best - 1e-4 else (best, bad + 1)
            if bad >= patience:
                break
    return log
