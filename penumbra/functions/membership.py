"""Numerical kernels that all soft partitions share; each works on a block of rows."""

from __future__ import annotations

import math

import numpy as np

TINY = np.finfo(float).tiny


def sqdist(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of rows to centres, (n, k)."""
    d = (x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2.0 * (x @ c.T)
    return np.maximum(d, 0.0)


def dist(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances by differences, which loses no digits for near points."""
    return np.sqrt(((x[:, None, :] - c[None, :, :]) ** 2).sum(2))


def softmax(a: np.ndarray) -> np.ndarray:
    e = np.exp(a - a.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def ratio(d: np.ndarray, p: float) -> np.ndarray:
    """Shares in proportion to d ** -p within each row; the ratios to the least of a row are at most 1, so that nothing overflows."""
    d = np.maximum(d, TINY)
    w = d.min(1, keepdims=True) / d
    if p != 1.0:
        w **= p
    return w / w.sum(1, keepdims=True)


def logsumexp(a: np.ndarray) -> np.ndarray:
    m = a.max(1)
    return m + np.log(np.exp(a - m[:, None]).sum(1))


def _mix(z: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def uniform(ids: np.ndarray, k: int, seed: int) -> np.ndarray:
    """(n, k) uniforms in (0, 1) that depend on id, column and seed only, so not on how rows are partitioned."""
    with np.errstate(over="ignore"):
        a = _mix(ids.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) % 2**64))
        z = _mix(a[:, None] + (np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :])
    return ((z >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def dirichlet(ids: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Rows uniform over the simplex."""
    e = -np.log(uniform(ids, k, seed))
    return e / e.sum(1, keepdims=True)


def digamma(x: np.ndarray) -> np.ndarray:
    """Recurrence up to 6, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        out[low] -= 1 / x[low]
        x[low] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


lgamma = np.vectorize(math.lgamma, otypes=[float])


def betaln(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return lgamma(a) + lgamma(b) - lgamma(np.asarray(a) + np.asarray(b))


def cholesky_or_ridge(s: np.ndarray, ridge: float) -> np.ndarray:
    """Cholesky factor of s, with `ridge` on the diagonal if it needs one."""
    try:
        return np.linalg.cholesky(s)
    except np.linalg.LinAlgError:
        return np.linalg.cholesky(s + ridge * np.eye(len(s)))


def mahalanobis(x: np.ndarray, c: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Squared Mahalanobis distances of rows to one centre, from the lower Cholesky factor of its covariance."""
    return (np.linalg.solve(factor, (x - c).T) ** 2).sum(0)
