"""A linear-chain conditional random field over sparse features, trained with full log-likelihood in numpy.

A sequence is a list of rows, each the numbers of the features that hold and their values; a dense matrix is taken too.
"""

from __future__ import annotations

import numpy as np


Row = tuple[np.ndarray, np.ndarray]


def _rows(x) -> list[Row]:
    if isinstance(x, np.ndarray):
        return [(at := np.flatnonzero(r), r[at]) for r in x]
    return [(np.asarray(i, np.int64), np.asarray(v, float)) for i, v in x]


class LinearChainCRF:
    """emit: features x tags; move: tags x tags; first: tags."""

    def __init__(self, n_features: int, n_tags: int):
        self.emit, self.move, self.first = np.zeros((n_features, n_tags)), np.zeros((n_tags, n_tags)), np.zeros(n_tags)

    def scores(self, x) -> np.ndarray:
        """rows x tags."""
        return np.array([v @ self.emit[i] for i, v in _rows(x)]).reshape(-1, len(self.first))

    def fit(self, xs: list, ys: list[np.ndarray], steps: int = 250, rate: float = 0.5, decay: float = 1e-3) -> LinearChainCRF:
        """Batch gradient steps with AdaGrad; sequences of equal length are computed together."""
        by_len: dict[int, list[tuple[list[Row], np.ndarray]]] = {}
        for x, y in zip(xs, ys):
            if len(y):
                by_len.setdefault(len(y), []).append((_rows(x), y))
        groups, rows = [], []
        for n in sorted(by_len):  # a group's rows lie in the order of sequences, then places
            begin = len(rows)
            for x, _ in by_len[n]:
                rows += x
            groups.append((begin, len(rows), np.array([y for _, y in by_len[n]])))
        sizes = np.array([len(i) for i, _ in rows])
        flat, value = np.concatenate([*(i for i, _ in rows), np.zeros(0, np.int64)]), np.concatenate([*(v for _, v in rows), np.zeros(0)])
        owner = np.repeat(np.arange(len(rows)), sizes)
        starts = np.minimum(np.cumsum(sizes) - sizes, max(0, len(flat) - 1))
        total, tags = len(xs), len(self.first)
        params = (self.emit, self.move, self.first)
        seen = [np.full_like(p, 1e-6) for p in params]
        eye = np.eye(tags)
        for _ in range(steps):
            grads = [-decay * p for p in params]
            every = np.add.reduceat(self.emit[flat] * value[:, None], starts, axis=0) * (sizes > 0)[:, None]
            gaps = np.zeros_like(every)
            for begin, end, y in groups:
                n = y.shape[1]
                s = every[begin:end].reshape(len(y), n, tags).copy()
                s[:, 0] += self.first
                fwd = [s[:, 0]]
                for t in range(1, n):
                    fwd.append(_lse(fwd[-1][:, :, None] + self.move, 1) + s[:, t])
                bwd = [np.zeros_like(s[:, 0])]
                for t in range(n - 1, 0, -1):
                    bwd.insert(0, _lse(self.move + (s[:, t] + bwd[0])[:, None, :], 2))
                z = _lse(fwd[-1], 1)
                gap = np.stack([eye[y[:, t]] - np.exp(fwd[t] + bwd[t] - z[:, None]) for t in range(n)], axis=1)
                gaps[begin:end] = gap.reshape(-1, tags)
                grads[2] += gap[:, 0].sum(0) / total
                for t in range(1, n):
                    both = np.exp(fwd[t - 1][:, :, None] + self.move + (s[:, t] + bwd[t])[:, None, :] - z[:, None, None])
                    np.add.at(grads[1], (y[:, t - 1], y[:, t]), 1 / total)
                    grads[1] -= both.sum(0) / total
            for k in range(tags):
                grads[0][:, k] += np.bincount(flat, weights=gaps[owner, k] * value, minlength=len(self.emit)) / total
            for p, g, h in zip(params, grads, seen):
                h += g * g
                p += rate * g / np.sqrt(h)
        return self

    def tags(self, x) -> list[int]:
        """The best tag sequence (Viterbi)."""
        s = self.scores(x)
        best, back = s[0] + self.first, []
        for t in range(1, len(s)):
            c = best[:, None] + self.move
            back.append(c.argmax(0))
            best = c.max(0) + s[t]
        out = [int(best.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis))
