"""A linear-chain conditional random field in NumPy.

Sequences are lists of tokens, a token a list of feature strings (hashed into
``buckets``). Training is full-batch gradient ascent on the L2-penalised
log-likelihood; decoding is Viterbi over a batch of sequences of one length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np


def bucket(feature: str, buckets: int) -> int:
    return zlib.crc32(feature.encode("utf-8")) % buckets


@dataclass
class Crf:
    labels: list[str]
    buckets: int
    emit: np.ndarray  # (buckets, labels)
    move: np.ndarray  # (labels, labels)
    start: np.ndarray  # (labels,)

    def scores(self, tokens: list[list[int]]) -> np.ndarray:
        """(tokens, labels): summed feature weights; each token's list is of
        any length."""
        flat = np.fromiter((i for t in tokens for i in t), dtype=np.int64)
        at = np.cumsum([0] + [len(t) for t in tokens[:-1]])
        return np.add.reduceat(self.emit[flat], at, axis=0)

    def viterbi(self, scores: np.ndarray) -> np.ndarray:
        """Best label paths of (batch, length, labels) token scores."""
        n, length, k = scores.shape
        best = scores[:, 0] + self.start
        back = np.zeros((n, length, k), dtype=np.int16)
        for t in range(1, length):
            via = best[:, :, None] + self.move[None]
            back[:, t] = via.argmax(axis=1)
            best = via.max(axis=1) + scores[:, t]
        path = np.zeros((n, length), dtype=np.int16)
        path[:, -1] = best.argmax(axis=1)
        for t in range(length - 1, 0, -1):
            path[:, t - 1] = back[np.arange(n), t, path[:, t]]
        return path


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train(
    sequences: list[tuple[list[list[str]], list[str]]],
    labels: list[str],
    allowed_moves: np.ndarray,
    buckets: int = 1 << 13,
    steps: int = 80,
    rate: float = 0.5,
    l2: float = 1e-3,
) -> Crf:
    """``sequences``: (features of each token, label of each token).
    ``allowed_moves[a, b]``: False forbids label b after a (a row more, the
    last, for the start)."""
    k = len(labels)
    at = {x: i for i, x in enumerate(labels)}
    wall = np.where(allowed_moves, 0.0, -1e4)
    model = Crf(labels, buckets, np.zeros((buckets, k)), wall[:k].copy(), wall[k].copy())
    data = [([[bucket(f, buckets) for f in t] for t in toks], [at[y] for y in ys]) for toks, ys in sequences if toks]
    sums = [np.zeros_like(model.emit), np.zeros((k, k)), np.zeros(k)]
    for _ in range(steps):
        grad = [-l2 * model.emit, -l2 * np.where(allowed_moves[:k], model.move, 0), -l2 * np.where(allowed_moves[k], model.start, 0)]
        for toks, ys in data:
            s, n = model.scores(toks), len(toks)
            fwd, bwd = np.zeros((n, k)), np.zeros((n, k))
            fwd[0] = s[0] + model.start
            for t in range(1, n):
                fwd[t] = _lse(fwd[t - 1][:, None] + model.move, 0) + s[t]
            for t in range(n - 2, -1, -1):
                bwd[t] = _lse(model.move + (s[t + 1] + bwd[t + 1])[None], 1)
            z = _lse(fwd[-1], 0)
            post = -np.exp(fwd + bwd - z)
            post[np.arange(n), ys] += 1
            for t in range(n):
                np.add.at(grad[0], toks[t], post[t])
            grad[2] += post[0]
            for t in range(1, n):
                grad[1] -= np.exp(fwd[t - 1][:, None] + model.move + (s[t] + bwd[t])[None] - z)
                grad[1][ys[t - 1], ys[t]] += 1
        for w, g, h in zip((model.emit, model.move, model.start), grad, sums, strict=True):
            h += g * g  # AdaGrad
            w += rate * g / np.sqrt(h + 1e-8)
        model.move[~allowed_moves[:k]] = -1e4
        model.start[~allowed_moves[k]] = -1e4
    return model
