"""Ridge regression with leave-one-out choice of the penalty.

One penalty serves all targets: the one with the least mean squared
leave-one-out error.  With fewer rows than features the dual form is solved on
the driver, where rows times features are bounded; with more rows the primal
form is, from moments and cross products that tasks add up in blocks, so the
driver holds features squared, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DEFAULT_ALPHAS = np.logspace(-10, 10, 20)


@dataclass(frozen=True)
class Ridge:
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray  # targets x features, on standardised features
    intercept: np.ndarray
    alpha: float
    loo: np.ndarray  # mean squared leave-one-out error of each penalty

    def scores(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.mean) / self.scale) @ self.coef.T + self.intercept


def standardise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of columns; deviation 0 counts as 1."""
    mean, scale = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64)
    return mean, np.where(scale > 1e-12 * np.maximum(1.0, np.abs(mean)), scale, 1.0)


def _orthogonal_to_ones(n: int) -> np.ndarray:
    """n x (n - 1) orthonormal columns, each summing to zero."""
    v = np.full(n, 1 / np.sqrt(n))
    v[0] -= 1.0
    norm = v @ v
    h = np.eye(n) - (2 / norm) * np.outer(v, v) if norm > 0 else np.eye(n)
    return h[:, 1:]


def fit(x: np.ndarray, y: np.ndarray, alphas=None, scaled: tuple[np.ndarray, np.ndarray] | None = None) -> Ridge:
    """Ridge on rows in memory; y: rows x targets."""
    alphas = DEFAULT_ALPHAS if alphas is None else np.asarray(list(alphas), np.float64)
    mean, scale = standardise(x) if scaled is None else scaled
    z = (x - mean) / scale
    y = np.asarray(y, np.float64)
    ybar = y.mean(0)
    r = y - ybar
    n, p = z.shape
    zbar = z.mean(0)
    z = z - zbar
    if n <= p:
        # in a basis orthogonal to the constant, which the intercept takes; the
        # leave-one-out error is then a ratio free of cancellation
        h = _orthogonal_to_ones(n)
        zh = h.T @ z
        w, u = np.linalg.eigh(zh @ zh.T)
        w = np.maximum(w, 0.0)
        uy = u.T @ (h.T @ r)
        u = h @ u
        u2 = u * u
        loo = []
        for a in alphas:
            c = 1 / (w + a)
            loo.append((((u @ (c[:, None] * uy)) / np.maximum(u2 @ c, 1e-300)[:, None]) ** 2).mean())
        a = alphas[int(np.argmin(loo))]
        coef = (z.T @ (u @ (uy / (w + a)[:, None]))).T
    else:
        w, v = np.linalg.eigh(z.T @ z)
        w = np.maximum(w, 0.0)
        zv = z @ v
        zy = zv.T @ r
        loo = []
        for a in alphas:
            h = np.minimum(1 - 1e-10, 1.0 / n + (zv * zv) @ (1 / (w + a)))
            loo.append((((r - zv @ (zy / (w + a)[:, None])) / (1 - h)[:, None]) ** 2).mean())
        a = alphas[int(np.argmin(loo))]
        coef = (v @ (zy / (w + a)[:, None])).T
    return Ridge(mean, scale, coef, ybar - coef @ zbar, float(a), np.array(loo))


class Moments:
    """Counts, sums and cross products of (features, targets); they add up.

    Of the matrix of cross products only rows ``lo`` to ``hi``, if given.
    """

    def __init__(self, p: int, k: int, lo: int = 0, hi: int | None = None):
        self.lo, self.hi = lo, p + k if hi is None else min(hi, p + k)
        self.n = 0
        self.s = np.zeros(self.hi - self.lo)
        self.g = np.zeros((self.hi - self.lo, p))

    def add(self, x: np.ndarray, y: np.ndarray) -> None:
        both = np.concatenate([x, y], 1, dtype=np.float64)
        here = both[:, self.lo : self.hi]
        self.n += len(x)
        self.s += here.sum(0)
        self.g += here.T @ both[:, : x.shape[1]]


def fit_moments(n: int, s: np.ndarray, g: np.ndarray, alphas, loo_errors) -> Ridge:
    """Primal ridge from moments; ``loo_errors`` gives each
    penalty's leave-one-out error in one more pass over the rows."""
    p = g.shape[1]
    mean = s[:p] / n
    var = np.maximum(np.diag(g[:p]) / n - mean**2, 0.0)
    scale = np.sqrt(var)
    scale = np.where(scale > 1e-9 * np.maximum(1.0, np.abs(mean)), scale, 1.0)
    ybar = s[p:] / n
    gram = (g[:p] - n * np.outer(mean, mean)) / np.outer(scale, scale)
    zy = ((g[p:] - n * np.outer(ybar, mean)) / scale).T
    w, v = np.linalg.eigh(gram)
    w = np.maximum(w, 0.0)
    alphas = DEFAULT_ALPHAS if alphas is None else np.asarray(list(alphas), np.float64)
    rotated = v.T @ zy
    loo = loo_errors(n, mean, scale, ybar, v, w, rotated, alphas)
    a = alphas[int(np.argmin(loo))]
    coef = (v @ (rotated / (w + a)[:, None])).T
    return Ridge(mean, scale, coef, ybar, float(a), np.asarray(loo))
