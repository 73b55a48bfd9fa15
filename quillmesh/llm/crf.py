"""Linear-chain conditional random fields in numpy, over batches of sequences.

Sequences of one batch are laid out step by step (first all first items, then
all second items, ...), longest first, so that each step of a recursion is a
few array operations over all sequences that are that long.
"""

from __future__ import annotations

import numpy as np


class Layout:
    """How the items of sequences with these lengths (1 or more each) are laid out by steps."""

    def __init__(self, lengths: np.ndarray):
        lengths = np.asarray(lengths, np.int64)
        self.order = np.argsort(-lengths, kind="stable")
        self.sorted = lengths[self.order]
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)[self.order] if len(lengths) else np.zeros(0, np.int64)
        steps = int(self.sorted[0]) if len(lengths) else 0
        self.active = np.searchsorted(-self.sorted, -np.arange(steps), side="left")  # sequences longer than t
        self.ends = np.cumsum(self.active)
        first = self.ends - self.active
        t = np.repeat(np.arange(steps), self.active)
        self.items = starts[np.arange(len(t)) - first[t]] + t if steps else np.zeros(0, np.int64)

    def steps(self):
        """For each step its slice, of the laid-out items."""
        return [slice(int(e - n), int(e)) for e, n in zip(self.ends, self.active)]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(unary: np.ndarray, trans: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of each item's states, expected transition counts, and the log partition function's sum."""
    u = unary[layout.items]
    alpha, beta = np.empty_like(u), np.zeros_like(u)
    steps = layout.steps()
    for k, s in enumerate(steps):
        if k:
            n = s.stop - s.start
            before = alpha[steps[k - 1].start : steps[k - 1].start + n]
            alpha[s] = u[s] + _lse(before[:, :, None] + trans[None], 1)
        else:
            alpha[s] = u[s]
    pair = np.zeros_like(trans)
    z = np.empty(len(layout.sorted))
    for k in range(len(steps) - 1, -1, -1):
        s = steps[k]
        n = layout.active[k + 1] if k + 1 < len(steps) else 0
        z[n : layout.active[k]] = _lse(alpha[s.start + n : s.stop], 1)
        if n:
            a, b = slice(s.start, s.start + n), steps[k + 1]
            after = u[b] + beta[b]
            beta[a] = _lse(trans[None] + after[:, None, :], 2)
            pair += np.exp(alpha[a][:, :, None] + trans[None] + after[:, None, :] - z[:n, None, None]).sum(0)
    which = np.arange(len(u)) - np.repeat(layout.ends - layout.active, layout.active)
    marginal = np.empty_like(u)
    marginal[layout.items] = np.exp(alpha + beta - z[which][:, None]) if len(u) else u
    return marginal, pair, float(z.sum())


def viterbi(unary: np.ndarray, trans: np.ndarray, layout: Layout) -> np.ndarray:
    """The best states; ties go to the smaller state."""
    u = unary[layout.items]
    steps = layout.steps()
    back = np.zeros(u.shape, np.int8)
    score = u[steps[0]].copy() if steps else u
    finals = []
    for k, s in enumerate(steps):
        n = s.stop - s.start
        if k:
            finals.append(score[n:].argmax(1))
            step = score[:n, :, None] + trans[None]
            back[s] = step.argmax(1)
            score = step.max(1) + u[s]
    finals.append(score.argmax(1))
    best = np.zeros(len(u), np.int8)
    now = np.zeros(0, np.int64)
    for k in range(len(steps) - 1, -1, -1):
        s = steps[k]
        if k + 1 < len(steps):
            b = steps[k + 1]
            now = back[b][np.arange(len(now)), now].astype(np.int64)
            now = np.concatenate([now, finals[k]])
        else:
            now = finals[-1]
        best[s] = now
    out = np.empty(len(u), np.int8)
    out[layout.items] = best
    return out


def minimise(f, x: np.ndarray, rounds: int = 60, memory: int = 8, tol: float = 1e-5) -> np.ndarray:
    """L-BFGS with backtracking; f gives a value and its gradient."""
    value, g = f(x)
    old: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        d, parts = -g, []
        for s, y in reversed(old):
            a = s @ d / (y @ s)
            parts.append(a)
            d = d - a * y
        if old:
            s, y = old[-1]
            d = d * (s @ y / (y @ y))
        for (s, y), a in zip(old, reversed(parts)):
            d = d + s * (a - y @ d / (y @ s))
        slope = g @ d
        if slope > -1e-12:
            break
        step = 1.0 if old else min(1.0, 1.0 / (np.abs(g).sum() + 1e-12))
        while True:
            new, ng = f(x + step * d)
            if new <= value + 1e-4 * step * slope or step < 1e-10:
                break
            step /= 2
        s, y = step * d, ng - g
        x, done, value, g = x + s, value - new < tol * max(1.0, abs(value)), new, ng
        if s @ y > 1e-12:
            old = [*old[1 - memory :], (s, y)] if memory > 1 else [(s, y)]
        if done:
            break
    return x


def fit(x: np.ndarray, labels: np.ndarray, lengths: np.ndarray, states: int, ridge: float = 1.0, rounds: int = 60, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features by states) and transitions for dense features x, by penalised likelihood.

    State 0 is the base: its weights stay zero. weights (by sequence) aren't needed for most uses.
    """
    layout = Layout(lengths)
    n = x.shape[1]
    ends = np.cumsum(lengths)
    inner = np.ones(len(x), bool)
    inner[ends - 1] = False
    a = np.flatnonzero(inner)
    seen_pairs = np.zeros((states, states))
    np.add.at(seen_pairs, (labels[a], labels[a + 1]), 1)
    onehot = np.eye(states)[labels]
    seen = x.T @ onehot

    def objective(p):
        w = np.zeros((n, states))
        w[:, 1:] = p[: n * (states - 1)].reshape(n, states - 1)
        t = p[n * (states - 1) :].reshape(states, states)
        marginal, pairs, z = forward_backward(x @ w, t, layout)
        value = z - (seen * w).sum() - (seen_pairs * t).sum() + 0.5 * ridge * (p @ p)
        grad = np.concatenate([(x.T @ marginal - seen)[:, 1:].ravel(), (pairs - seen_pairs).ravel()]) + ridge * p
        scale = 1.0 / max(1, len(x))
        return value * scale, grad * scale

    p = minimise(objective, np.zeros(n * (states - 1) + states * states), rounds)
    w = np.zeros((n, states))
    w[:, 1:] = p[: n * (states - 1)].reshape(n, states - 1)
    return w, p[n * (states - 1) :].reshape(states, states)
