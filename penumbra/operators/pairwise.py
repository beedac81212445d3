"""Partitions that compare points with each other. Quadratic by definition, so they take up to QUADRATIC points.

Within that bound all points fit on every executor; a pass is spread over blocks of query points, each held against all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from penumbra.functions.membership import TINY, dirichlet, dist, ratio, softmax, sqdist, uniform
from penumbra.functions.optimise import lbfgs
from penumbra.operators.base import Estimator, Model, Points, held, long_form, register
from penumbra.operators.prototypes import moments

QUADRATIC = 200_000
DENSE = 6_000  # points whose matrix is held whole
BLOCK = 2_048
BROADCAST_BYTES = 400_000_000  # of all points, which every task of a pass holds


def pair_map(spark: SparkSession, x: np.ndarray, fn: Callable[[np.ndarray, np.ndarray, int], np.ndarray]) -> np.ndarray:
    """Rows of fn(query block, all points, index of the block's first row), stacked. One task for each block of queries."""
    n = len(x)
    if n <= held(2 * BLOCK) or not n:
        return np.concatenate([fn(x[i : i + BLOCK], x, i) for i in range(0, n, BLOCK)]) if n else np.zeros(0)
    if x.nbytes > BROADCAST_BYTES:
        raise ValueError(f"{x.nbytes} bytes of points go to every task: the limit is {BROADCAST_BYTES}")
    everything = spark.sparkContext.broadcast(x)
    blocks = -(-n // BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                a = everything.value
                out = np.ascontiguousarray(fn(a[k * BLOCK : (k + 1) * BLOCK], a, k * BLOCK), float)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([out.tobytes()]), pa.array([out.shape[1] if out.ndim > 1 else 0])], names=["k", "v", "m"])

    rows = spark.range(0, blocks, 1, blocks).mapInArrow(run, "k bigint, v binary, m bigint").collect()
    parts = [np.frombuffer(r["v"]).reshape((-1, r["m"]) if r["m"] else -1) for r in sorted(rows, key=lambda r: r["k"])]
    everything.unpersist()
    return np.concatenate(parts)


class _Pairwise(Estimator):
    def rows(self, df, limit: int = QUADRATIC) -> tuple[Points, np.ndarray, np.ndarray]:
        p = self.points(df)
        ids, x, _ = p.all(limit, type(self).__name__)
        return p, ids, x

    def result(self, p: Points, ids: np.ndarray, u: np.ndarray, **more) -> Model:
        return Model(type(self).__name__, lambda: long_form(p.spark, ids, u), u.shape[1], constrained=self.CONSTRAINED, **more)


@register
class SCM(_Pairwise):
    """Subtractive clustering: centres are points of high potential. er has no effect. extras: potentials (id order)."""

    PARAMS = {"ra": 0.5, "ea": 0.5, "er": 0.15}
    FINDS_K = True

    def fit(self, df, *_):
        p, ids, x = self.rows(df)
        lo, span = x.min(0), np.ptp(x, axis=0)
        z = (x - lo) / np.where(span == 0, 1.0, span)
        alpha, beta = 4 / self.ra**2, 4 / (1.5 * self.ra) ** 2
        first = pot = pair_map(p.spark, z, lambda q, a, _: np.exp(-alpha * sqdist(q, a)).sum(1))
        top, chosen = pot.max(), []
        while True:
            i = int(pot.argmax())
            if pot[i] < self.ea * top:
                break
            chosen.append(i)
            pot = pot - pot[i] * np.exp(-beta * sqdist(z, z[[i]])[:, 0])
        w = np.exp(-alpha * sqdist(z, z[chosen]))
        return self.result(p, ids, w / np.maximum(w.sum(1, keepdims=True), TINY), centers=x[chosen], extras={"potentials": first})


def nearest(spark: SparkSession, x: np.ndarray, k: int, own: bool = False) -> np.ndarray:
    """Row numbers of the k nearest points of each, the lower one of equals first; `own` counts a point among its own nearest."""

    def rows(q, a, i):
        d = sqdist(q, a)
        if not own:
            d[np.arange(len(q)), i + np.arange(len(q))] = np.inf
        return np.argsort(d, axis=1, kind="stable")[:, :k].astype(float)

    return pair_map(spark, x, rows).astype(int).reshape(len(x), -1)


def core_points(spark: SparkSession, x: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """Which points have min_samples points, themselves included, within eps."""
    return pair_map(spark, x, lambda q, a, _: (dist_blocked(q, a) <= eps).sum(1).astype(float)) >= min_samples


def dbscan(spark: SparkSession, x: np.ndarray, eps: float, min_samples: int) -> np.ndarray:
    """Labels from 0, -1 for noise. Clusters are numbered by their first core point; a border point goes to the first cluster near it."""
    near = lambda q, a: dist_blocked(q, a) <= eps
    core = core_points(spark, x, eps, min_samples)
    label = np.where(core, np.arange(len(x)), len(x)).astype(float)
    while True:  # the least core index that is linked, by steps over neighbours and over labels
        new = pair_map(spark, x, lambda q, a, i, label=label: np.where(near(q, a) & core[None, :], label[None, :], len(a)).min(1))
        new = np.where(core, np.minimum(new, label), label)
        new = np.where(core, new[np.minimum(new, len(x) - 1).astype(int)], new)
        if (new == label).all():
            break
        label = new
    roots = np.unique(label[core])
    number = {r: k for k, r in enumerate(roots)}
    out = np.array([number[v] if c else -1 for v, c in zip(label, core)])
    border = pair_map(spark, x, lambda q, a, i: np.where(near(q, a) & core[None, :], label[None, :], np.inf).min(1))
    return np.where(core, out, np.array([number.get(v, -1) for v in border]))


def dist_blocked(q: np.ndarray, a: np.ndarray) -> np.ndarray:
    return np.sqrt(sqdist(q, a))


@register
class SoftDBSCANGM(_Pairwise):
    """DBSCAN's clusters, and each noise point as one, softened by Mahalanobis distances. extras: dbscan labels."""

    PARAMS = {"eps": 0.5, "min_samples": 5, "m": 2.0, "max_iter": 100, "tol": 1e-4}
    FINDS_K = True

    def fit(self, df, *_):
        p, ids, x = self.rows(df)
        n, d = x.shape
        raw = dbscan(p.spark, x, self.eps, self.min_samples)
        clusters = int(raw.max()) + 1
        col = np.where(raw >= 0, raw, clusters + np.cumsum(raw < 0) - 1)
        k = clusters + int((raw < 0).sum())
        if n * k > 50_000_000:
            raise ValueError(f"{k} clusters and noise points over {n} points: eps is too small for this data")
        u, c, steps = np.zeros((n, k)), np.zeros((k, d)), 0
        u[np.arange(n), col] = 1
        rows = max(1, 4_000_000 // max(1, k * d))
        for _ in range(self.max_iter):
            w = u**self.m
            before, s0 = c, w.sum(0)
            c = (w.T @ x) / (s0[:, None] + 1e-10)
            cov = np.zeros((k, d, d))
            for a in range(0, n, rows):
                e = x[a : a + rows, None, :] - c[None]
                cov += np.einsum("nk,nkd,nke->kde", w[a : a + rows], e, e, optimize=True)
            inv = np.linalg.inv(cov / (s0[:, None, None] + 1e-10) + 1e-6 * np.eye(d))
            for a in range(0, n, rows):
                e = x[a : a + rows, None, :] - c[None]
                q = np.sqrt(np.maximum(np.einsum("nkd,kde,nke->nk", e, inv, e, optimize=True), 0))
                u[a : a + rows] = ratio(np.maximum(q, 1e-10), 2 / (self.m - 1))
            steps += 1
            if np.linalg.norm(c - before) < self.tol:
                break
        return self.result(p, ids, u, centers=c, n_iter=steps, extras={"dbscan": raw})


@register
class KFCCL(_Pairwise):
    """Kernel fuzzy competitive learning over the Gaussian Gram matrix; above DENSE points its rows are made anew in each pass."""

    PARAMS = {"k": 2, "lambda_": 10.0, "gamma": 1.0, "epsilon": 1e-4, "max_iter": 100, "seed": 0, "init": None}

    def fit(self, df, *_):
        p, ids, x = self.rows(df)
        gram = np.exp(-self.gamma * sqdist(x, x)) if len(x) <= DENSE else None

        def times(u):  # u (k, n)
            return u @ gram if gram is not None else pair_map(p.spark, x, lambda q, a, _: np.exp(-self.gamma * sqdist(q, a)) @ u.T).T

        pik = uniform(ids, self.k, self.seed).T * 0.01 if self.init is None else np.array(self.init, float).T  # init: (n, k) in the order of ids
        v, steps = np.ones(self.k), 0
        for t in range(self.max_iter):
            eta, old = 0.05 / (1 + t), pik
            u = softmax(self.lambda_ * pik.T).T
            uk = times(u)
            v = v + 2 * eta * (u * pik).sum(1) + eta**2 * (uk * u).sum(1)
            pik, steps = (pik + eta * uk) / np.sqrt(v)[:, None], steps + 1
            if np.abs(pik - old).max() < self.epsilon:
                break
        return self.result(p, ids, u.T, n_iter=steps)


@register
class AFCM(_Pairwise):
    """Fuzzy c-means in a spectral embedding of the nearest-neighbour graph that follows the memberships."""

    PARAMS = {"k": 3, "lambda_": 1.0, "m": 2.0, "max_iter": 100, "tol": 1e-5, "n_neighbors": 5, "seed": 0}

    def fit(self, df, *_):
        p, ids, x = self.rows(df, DENSE)
        n, k = len(x), self.k
        order = nearest(p.spark, x, self.n_neighbors, own=True)
        w = np.zeros((n, n))
        w[np.arange(n)[:, None], order] = 1
        w[np.arange(n), np.arange(n)] = 1
        lap = np.diag(w.sum(1)) - w
        lower = np.tril(lap) + np.tril(lap, -1).T  # a directed graph; its lower triangle counts
        u, steps = dirichlet(ids, k, self.seed), 0
        for _ in range(self.max_iter):
            b = np.eye(n) - u @ np.linalg.pinv(u.T @ u) @ u.T
            e = np.linalg.eigh(lower + self.lambda_ * b)[1][:, :k]
            s0, s1 = moments(u**self.m, e)
            new, steps = ratio(dist(e, s1 / s0[:, None]) + 1e-8, 2 / (self.m - 1)), steps + 1
            if np.linalg.norm(new - u) < self.tol:
                break
            u = new
        return self.result(p, ids, u, n_iter=steps, extras={"degree": w.sum(1)})


def credal_stress(flat: np.ndarray, delta: np.ndarray, k: int, norm: float) -> tuple[float, np.ndarray]:
    """Stress between degrees of conflict and dissimilarities, and its gradient by the logits of the masses."""
    m = softmax(flat.reshape(len(delta), k + 1))
    s = m[:, :k]
    t = s.sum(1)
    gap = np.outer(t, t) - s @ s.T - delta
    np.fill_diagonal(gap, 0.0)
    g = np.zeros_like(m)
    g[:, :k] = 2 / norm * ((gap @ t)[:, None] - gap @ s)
    return 0.5 * float((gap**2).sum()) / norm, (m * (g - (g * m).sum(1, keepdims=True))).ravel()


@register
class EVCLUS(_Pairwise):
    """Evidential clustering of dissimilarities; with metric="precomputed" features are rows of the matrix. extras: masses, stress."""

    PARAMS = {"k": 3, "max_iter": 200, "n_init": 3, "tol": 1e-6, "metric": "euclidean", "seed": 0, "init": None}

    def fit(self, df, *_):
        p, ids, x = self.rows(df, DENSE)
        n, k = len(x), self.k
        delta = x.copy() if self.metric == "precomputed" else np.sqrt(sqdist(x, x))
        np.fill_diagonal(delta, 0.0)
        delta = delta / (delta.max() or 1.0)
        norm = 0.5 * float((delta**2).sum())
        if norm <= 0:  # all alike: nothing is known
            m, stress = np.eye(k + 1)[np.full(n, k)], 0.0
        else:
            rng = np.random.default_rng(self.seed)
            starts = [np.array(self.init, float).ravel()] if self.init is not None else [rng.normal(scale=0.1, size=n * (k + 1)) for _ in range(self.n_init)]  # logits
            runs = [lbfgs(lambda f: credal_stress(f, delta, k, norm), s, self.max_iter, self.tol) for s in starts]
            best, stress, _ = min(runs, key=lambda r: r[1])
            m = softmax(best.reshape(n, k + 1))
        return self.result(p, ids, m[:, :k] + m[:, [k]] / k, extras={"masses": m, "stress": stress, "ignorance": m[:, k]})


@register
class SoftKSC(_Pairwise):
    """Semi-supervised kernel clustering into two; the column `label` is 1, -1 or null. Has a rule for new points."""

    PARAMS = {"gamma": 1.0, "C": 1.0}

    def fit(self, df, *_):
        p = Points(df, ("label",)) if not isinstance(df, Points) else df
        ids, x, extra = p.all(DENSE, "SoftKSC")
        y = np.nan_to_num(np.asarray(extra[0], float))
        a = np.exp(-self.gamma * sqdist(x, x)) + self.C * np.eye(len(x))
        coef = np.linalg.solve(a, np.column_stack([y == 1, y == -1]).astype(float))

        def rule(q):
            f = np.abs(np.exp(-self.gamma * sqdist(q, x)) @ coef)
            s = 1 - f / (f.sum(1, keepdims=True) + 1e-10)
            return s / np.where(s.sum(1, keepdims=True) > 0, s.sum(1, keepdims=True), 1)

        return self.result(p, ids, rule(x), extras={"coefficients": coef, "signed": lambda d: Points(d).assign(lambda i, q: (rule(q).argmax(1) * 2 - 1)[:, None])}, rule=rule)


__all__ = ["SCM", "SoftDBSCANGM", "KFCCL", "AFCM", "EVCLUS", "SoftKSC", "dbscan", "pair_map", "DataFrame"]
