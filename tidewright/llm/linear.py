"""Linear models on sparse indicator features, small enough to fit on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np


class Sparse:
    """Rows of active feature numbers, flattened in row order and in column order: both products are sums of contiguous runs."""

    def __init__(self, rows: list[np.ndarray], width: int):
        flat = np.concatenate(rows) if rows else np.empty(0)
        self._set(flat.astype(np.int32), np.array([len(r) for r in rows], dtype=np.int64), width)

    def _set(self, cols: np.ndarray, counts: np.ndarray, width: int) -> None:
        self.cols, self.counts, self.n, self.width = cols, counts, len(counts), width
        order = np.argsort(cols, kind="stable")
        self.rows = np.repeat(np.arange(self.n, dtype=np.int32), counts)[order]
        self.by_row, self.by_col = _runs(counts), _runs(np.bincount(cols, minlength=width))

    @classmethod
    def of(cls, cols: np.ndarray, counts: np.ndarray, width: int) -> Sparse:
        """From the rows' feature numbers one after another, and how many each row has."""
        out = cls.__new__(cls)
        out._set(cols.astype(np.int32, copy=False), counts.astype(np.int64, copy=False), width)
        return out

    def part(self, rows: np.ndarray, features: np.ndarray) -> Sparse:
        """The rows and features marked; features are numbered anew."""
        owner = np.repeat(np.arange(self.n, dtype=np.int32), self.counts)
        keep = rows[owner] & features[self.cols]
        number = (np.cumsum(features) - 1).astype(np.int32)
        return Sparse.of(number[self.cols[keep]], np.bincount(owner[keep], minlength=self.n)[rows], int(features.sum()))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return _run_sums(w[self.cols], *self.by_row, self.n)

    def transposed_dot(self, v: np.ndarray) -> np.ndarray:
        return _run_sums(v[self.rows], *self.by_col, self.width)


def _runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which runs have members, and where those start."""
    full = np.flatnonzero(counts)
    return full, (np.cumsum(counts) - counts)[full]


def _run_sums(values: np.ndarray, full: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    if len(full):
        out[full] = np.add.reduceat(values, starts)
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: Sparse, y: np.ndarray, dense: np.ndarray, l2: float = 0.5, steps: int = 12, inner: int = 20, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of sparse features, of dense columns and the intercept: Newton steps on the regularised log loss, each solved by preconditioned conjugate gradients.

    start: weights, dense weights and intercept to begin with, for a fit that lies near another; the optimum is the same.
    """
    m, k = x.width, dense.shape[1]
    penalty = np.append(np.full(m + k, l2), 1e-6)

    def times(t: np.ndarray) -> np.ndarray:
        return x.dot(t[:m]) + dense @ t[m : m + k] + t[-1]

    def back(v: np.ndarray) -> np.ndarray:
        return np.concatenate([x.transposed_dot(v), dense.T @ v, [v.sum()]])

    def loss(t: np.ndarray, z: np.ndarray) -> float:
        return float(np.logaddexp(0, z).sum() - (y * z).sum() + (penalty * t * t).sum() / 2)

    theta = np.zeros(m + k + 1) if start is None else start.copy()
    z = times(theta)
    value = loss(theta, z)
    for _ in range(steps):
        p = sigmoid(z)
        gradient = back(p - y) + penalty * theta
        if np.abs(gradient).max() < 1e-3:
            break
        h = np.maximum(p * (1 - p), 1e-6)
        scale = np.concatenate([x.transposed_dot(h), (dense**2).T @ h, [h.sum()]]) + penalty
        move, rest = np.zeros_like(theta), -gradient
        held = rest / scale
        way, size = held.copy(), float(rest @ held)
        first = size
        for _ in range(inner):
            bent = back(h * times(way)) + penalty * way
            step = size / float(way @ bent)
            move, rest = move + step * way, rest - step * bent
            held = rest / scale
            size, before = float(rest @ held), size
            if size < 1e-4 * first:
                break
            way = held + size / before * way
        length = 1.0
        while length > 1e-4:
            new = theta + length * move
            nz = times(new)
            if (found := loss(new, nz)) < value:
                break
            length /= 2
        else:
            break
        done = value - found < 1e-6 * abs(value)
        theta, z, value = new, nz, found
        if done:
            break
    return theta[:m], theta[m : m + k], float(theta[-1])


def fit_hinge_dual(rows: list[np.ndarray], scale: np.ndarray, y: np.ndarray, c: float = 1.0, passes: int = 12, seed: int = 6) -> tuple[np.ndarray, float]:
    """Linear support vector machine (hinge loss) by dual coordinate descent; features are scale[column] where active, plus a constant 1.

    y in {-1, 1}. Each step solves one document's dual variable exactly and keeps the weights up to date.
    """
    w, b = np.zeros(len(scale)), 0.0
    alpha = np.zeros(len(rows))
    values = [scale[r] for r in rows]
    diag = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        most = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            g = y[i] * (float(w[r] @ v) + b) - 1.0
            new = min(max(alpha[i] - g / diag[i], 0.0), c)
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[r] += step * y[i] * v
                b += step * y[i]
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w, b


def fit_platt(margin: np.ndarray, y01: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """a, b of sigmoid(a margin + b), by Newton steps on smoothed targets."""
    pos, neg = float(y01.sum()), float(len(y01) - y01.sum())
    t = np.where(y01 > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * margin + b)
        g, h = p - t, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([g @ margin, g.sum()]) + 1e-6 * np.array([a, b])
        hess = np.array([[h @ (margin**2), h @ margin], [h @ margin, h.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)
