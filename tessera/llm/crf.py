"""Linear-chain conditional random field on sparse binary features, in numpy.

Training is full-batch (forward-backward in log space, Adam) on the features that occur, without
dense feature matrices; decoding is Viterbi for a whole batch of sequences at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Model:
    """``index``: feature -> row of ``emit`` (features x labels); ``move``: label to label;
    ``start``: first label."""

    labels: tuple[str, ...]
    index: dict[str, int]
    emit: np.ndarray
    move: np.ndarray
    start: np.ndarray


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(sequences: list[list[tuple[list[str], str]]], labels: tuple[str, ...], decay: float = 1e-3, steps: int = 150, rate: float = 0.1, rare: int = 2) -> Model:
    """Maximise the penalised likelihood of labelled sequences (lists of (features, label)).
    Features seen in fewer than ``rare`` places are left out. Deterministic."""
    seen: dict[str, int] = {}
    for s in sequences:
        for fs, _ in s:
            for f in set(fs):
                seen[f] = seen.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= rare))}
    k, n, t = len(labels), len(sequences), max(map(len, sequences))
    number = {x: i for i, x in enumerate(labels)}
    y = np.zeros((n, t), dtype=np.int64)
    on = np.zeros((n, t), dtype=bool)
    cell, ids = [], []  # each feature that occurs: its place in the padded sequences, its number
    for i, s in enumerate(sequences):
        for j, (fs, lab) in enumerate(s):
            found = [index[f] for f in set(fs) if f in index]
            ids += found
            cell += [i * t + j] * len(found)
            y[i, j], on[i, j] = number[lab], True
    cell, ids = np.array(cell, dtype=np.int64), np.array(ids, dtype=np.int64)

    def totals(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(at, weights=values[:, c], minlength=size) for c in range(k)], 1)

    params = [np.zeros((len(index), k)), np.zeros((k, k)), np.zeros(k)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    gold = np.eye(k)[y] * on[..., None]
    pairs = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    for step in range(1, steps + 1):
        emit, move, start = params
        e = totals(cell, emit[ids], n * t).reshape(n, t, k)
        a, b = np.empty((n, t, k)), np.zeros((n, t, k))
        a[:, 0] = e[:, 0] + start
        for j in range(1, t):
            a[:, j] = np.where(on[:, j, None], _lse(a[:, j - 1, :, None] + move, 1) + e[:, j], a[:, j - 1])
        for j in range(t - 2, -1, -1):
            b[:, j] = np.where(on[:, j + 1, None], _lse(move + (e[:, j + 1] + b[:, j + 1])[:, None, :], 2), b[:, j + 1])
        z = _lse(a[:, -1], 1)
        p = np.exp(a + b - z[:, None, None]) * on[..., None]
        q = np.zeros((k, k))
        for j in range(1, t):
            w = np.exp(a[:, j - 1, :, None] + move + (e[:, j] + b[:, j])[:, None, :] - z[:, None, None])
            q += (w * on[:, j, None, None]).sum(0)
        grads = [totals(ids, (gold - p).reshape(n * t, k)[cell], len(index)), pairs - q, (gold[:, 0] - p[:, 0]).sum(0)]
        for i, g in enumerate(grads):
            g = g / n - decay * params[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            params[i] = params[i] + rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return Model(labels, index, *params)


def decode(model: Model, sequences: list[list[list[str]]]) -> list[list[str]]:
    """Most likely labels of each sequence of feature lists; sequences may be empty."""
    if not sequences:
        return []
    index, k = model.index, len(model.labels)
    rows = [[index[f] for f in fs if f in index] for s in sequences for fs in s]
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    scores = np.zeros((len(rows), k))
    if sizes.sum():
        at = np.repeat(np.arange(len(rows)), sizes)
        ids = np.fromiter((i for r in rows for i in r), dtype=np.int64, count=int(sizes.sum()))
        for c in range(k):
            scores[:, c] = np.bincount(at, weights=model.emit[ids, c], minlength=len(rows))
    lengths = np.array([len(s) for s in sequences], dtype=np.int64)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, dtype=np.int64)
    out: list[list[str]] = [[] for _ in sequences]
    for t in np.unique(lengths):
        if t == 0:
            continue
        who = np.flatnonzero(lengths == t)
        e = scores[begin[who][:, None] + np.arange(t)]
        v, back = e[:, 0] + model.start, []
        for j in range(1, t):
            w = v[:, :, None] + model.move
            back.append(w.argmax(1))
            v = w.max(1) + e[:, j]
        path = [v.argmax(1)]
        for bk in reversed(back):
            path.append(bk[np.arange(len(who)), path[-1]])
        path = np.stack(path[::-1], 1)
        for r, i in enumerate(who):
            out[i] = [model.labels[c] for c in path[r]]
    return out
