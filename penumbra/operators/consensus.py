"""One partition out of several soft ones: an ensemble (run, id, k, u) in long form."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penumbra.operators.base import Estimator, Model, Points, kmeanspp, register
from penumbra.functions.membership import sqdist
from penumbra.operators.mixtures import lloyd


def stacked(ensemble: DataFrame, norm: str | None) -> DataFrame:
    """(id, features): the memberships of all runs side by side in the order of run and k, missing ones 0, rows normalised (l1, l2 or not).

    The columns are the distinct (run, k), a number that does not grow with the rows.
    """
    cols = [(r["run"], r["k"]) for r in ensemble.select("run", "k").distinct().orderBy("run", "k").limit(10_001).collect()]
    if len(cols) > 10_000:
        raise ValueError("more than 10000 clusters in the ensemble")
    wide = ensemble.groupBy("id").agg(F.array(*[F.coalesce(F.sum(F.when((F.col("run") == r) & (F.col("k") == k), F.col("u"))), F.lit(0.0)) for r, k in cols]).alias("v"))
    size = {"l1": "aggregate(v, 0D, (s, x) -> s + x)", "l2": "sqrt(aggregate(v, 0D, (s, x) -> s + x * x))"}
    return wide.select("id", F.expr(f"transform(v, x -> x / ({size[norm]} + 1e-8))" if norm else "v").alias("features"))


def kmeans(p: Points, k: int, n_init: int, max_iter: int, seed: int) -> np.ndarray:
    """Centres of least inertia out of n_init starts."""
    best = (np.inf, None)
    for s in range(n_init):
        c = lloyd(p, kmeanspp(p, k, seed + 101 * s), max_iter, 1e-4)
        inertia = float(p.reduce(lambda ids, x, c=c: (sqdist(x, c).min(1).sum(),))[0])
        if inertia < best[0]:
            best = (inertia, c)
    return best[1]


class _Rows(Estimator):
    NORM = "l2"

    def fit(self, df, *_):
        p = self.points(stacked(df, self.NORM))
        c = kmeans(p, self.k, self.params.get("n_init", 10), self.params.get("max_iter", 300), self.seed)
        return self.model(p, lambda ids, x: np.eye(len(c))[sqdist(x, c).argmin(1)], self.k, centers=c)


@register
class SCSPA(_Rows):
    """k-means over the rows of all memberships, of unit length. Crisp."""

    PARAMS = {"k": 3, "n_init": 10, "seed": 42}


@register
class SHBGF(_Rows):
    """k-means over the rows of all memberships, summing to one, with few steps. Crisp."""

    PARAMS = {"k": 3, "n_init": 10, "max_iter": 10, "seed": 42}
    NORM = "l1"


def gram(ensemble: DataFrame) -> DataFrame:
    """(a, b, dot) of all pairs of clusters of the ensemble, numbered in the order of run and k; one row per pair of clusters."""
    p = Points(stacked(ensemble, None))
    m = p.reduce(lambda ids, x: (x.T @ x,))[0]
    return p.spark.createDataFrame([(i, j, float(m[i, j])) for i in range(len(m)) for j in range(len(m))], "a int, b int, dot double")


@register
class SMCLA(Estimator):
    """k-means over the clusters of all runs as vectors, by their inner products only; memberships of a meta-cluster are added up. extras: meta."""

    PARAMS = {"k": 3, "n_init": 10, "seed": 42}

    def fit(self, df, *_):
        p = self.points(stacked(df, None))
        g = p.reduce(lambda ids, x: (x.T @ x,))[0]
        if self.k > len(g):
            raise ValueError(f"k={self.k} is more than the {len(g)} clusters of the ensemble")
        rng, best = np.random.default_rng(self.seed), (np.inf, None)
        for _ in range(self.n_init):
            chosen = [int(rng.integers(len(g)))]
            while len(chosen) < self.k:
                d = np.maximum((np.diag(g)[:, None] + np.diag(g)[chosen][None, :] - 2 * g[:, chosen]).min(1), 0)
                chosen.append(int(rng.choice(len(g), p=d / d.sum())) if d.sum() > 0 else int(rng.integers(len(g))))
            lab = (np.diag(g)[:, None] + np.diag(g)[chosen][None, :] - 2 * g[:, chosen]).argmin(1)
            for _ in range(300):
                h = np.eye(self.k)[lab] / np.maximum(np.bincount(lab, minlength=self.k), 1)
                d = np.diag(g)[:, None] - 2 * g @ h + np.einsum("ak,ab,bk->k", h, g, h)
                d[:, np.bincount(lab, minlength=self.k) == 0] = np.inf
                new = d.argmin(1)
                if (new == lab).all():
                    break
                lab = new
            inertia = d[np.arange(len(g)), lab].sum()
            if inertia < best[0]:
                best = (inertia, lab)
        meta = np.eye(self.k)[best[1]]

        def share(ids, x):
            s = x @ meta
            return np.eye(self.k)[(s / (s.sum(1, keepdims=True) + 1e-8)).argmax(1)]

        return self.model(p, share, self.k, extras={"meta": best[1]})
