"""Clustering over clients that keep their rows: (client, id, feature, value) in long form, values may be missing.

Each client is fitted where its rows are; what leaves it are its number of rows, its number of clusters and its centres.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penumbra.functions.assign import min_cost_assignment
from penumbra.functions.membership import TINY, dist, ratio, sqdist
from penumbra.operators.base import Estimator, Model, register
from penumbra.session import materialize

CLIENT_ROWS = 5_000


def common_features(clients: DataFrame) -> DataFrame:
    """(feature): those that all clients have."""
    n = clients.select("client").distinct().count()
    return clients.select("client", "feature").distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == n).select("feature")


def sammon(x: np.ndarray, steps: int, tol: float = 1e-9) -> np.ndarray:
    """Two-dimensional projection that keeps distances: diagonal Newton steps from the principal components, halved until the stress falls."""
    n = len(x)
    if n < 2:
        return np.zeros((n, 2))
    off = ~np.eye(n, dtype=bool)
    high = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    positive = high[off & (high > 0)]
    floor = max(positive.min() * 1e-6, 1e-12) if positive.size else 1e-9
    high = np.where(off, np.maximum(high, floor), 1.0)
    scale = high[off].sum() / 2
    z = x - x.mean(0)
    y = z @ np.linalg.svd(z, full_matrices=False)[2][:2].T
    y = np.hstack([y, np.zeros((n, 2 - y.shape[1]))])
    gaps = lambda q: np.sqrt(((q[:, None] - q[None]) ** 2).sum(2))
    stress = lambda q: float((((high - gaps(q)) ** 2 / high)[off]).sum() / 2 / scale)
    now = stress(y)
    for _ in range(max(steps, 1)):
        low = np.where(off, np.maximum(gaps(y), floor), 1.0)
        delta, inv, e = high - low, np.where(off, 1 / (high * low), 0.0), y[:, None] - y[None]
        first = -(2 / scale) * ((inv * delta)[..., None] * e).sum(1)
        second = -(2 / scale) * (inv[..., None] * (delta[..., None] - e**2 / low[..., None] * (1 + (delta / low)[..., None]))).sum(1)
        move, size = first / np.maximum(np.abs(second), 1e-12), 0.3
        new = y - size * move
        value = stress(new)
        for _ in range(10):
            if value <= now:
                break
            size /= 2
            new = y - size * move
            value = stress(new)
        if now - value < tol:
            return new if value < now else y
        y, now = new, value
    return y


def fuzzy(x: np.ndarray, k: int, m: float, steps: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    c = x[rng.choice(len(x), k, replace=False)]
    rule = lambda c: ratio(sqdist(x, c), 1 / (m - 1))
    u = rule(c)
    for _ in range(steps - 1):
        w = u**m
        c = (w.T @ x) / np.maximum(w.sum(0), TINY)[:, None]
        new = rule(c)
        moved, u = np.abs(new - u).max(), new
        if moved < 1e-6:
            break
    return c, u


def xie_beni(x: np.ndarray, u: np.ndarray, c: np.ndarray, m: float) -> float:
    sep = sqdist(c, c) + np.where(np.eye(len(c)) > 0, np.inf, 0)
    return float((u**m * sqdist(x, c)).sum() / (len(x) * sep.min())) if np.isfinite(sep.min()) and sep.min() > 0 else np.inf


def signature(x: np.ndarray, u: np.ndarray, k: int) -> np.ndarray:
    own = x[u.argmax(1) == k]
    return np.concatenate([[len(own)], own.mean(0), own.min(0), own.max(0), own.std(0), np.median(own, 0)]) if len(own) else np.zeros(1 + 5 * x.shape[1])


@register
class FeMIFuzzy(Estimator):
    """Federated fuzzy c-means with multiple imputation. Missing values are imputed before each client's projection. extras: client_sizes.

    A client needs 2 to CLIENT_ROWS rows, as projecting is quadratic. The id of a membership is the row's id, which must be unique over clients.
    """

    PARAMS = {"fuzzifier": 2.0, "n_imputations": 5, "max_iter": 100, "max_clusters": 10, "seed": 0}
    FINDS_K = True

    def fit(self, clients, *_):
        spark = clients.sparkSession
        names = sorted(r[0] for r in common_features(clients).limit(10_001).collect())
        if not names:
            raise ValueError("the clients have no feature in common")
        m, n_imp, steps, top, seed = self.fuzzifier, self.n_imputations, self.max_iter, self.max_clusters, self.seed

        def local(p: pd.DataFrame) -> pd.DataFrame:
            wide = p.pivot_table(index="id", columns="feature", values="value", aggfunc="mean", dropna=False).reindex(columns=names)
            x, n = wide.to_numpy(float), len(wide)
            if not 2 <= n <= CLIENT_ROWS:
                raise ValueError(f"a client has {n} rows; it must have 2 to {CLIENT_ROWS}")
            rng, gap = np.random.default_rng(seed), np.isnan(x)
            means = np.nan_to_num(np.nanmean(np.where(gap.all(0), 0.0, x), axis=0))
            views = []
            for _ in range(n_imp if gap.any() else 1):
                views.append(sammon(np.where(gap, means + rng.normal(scale=0.01, size=x.shape), x), steps))
            runs = [[fuzzy(views[i % len(views)], k, m, steps, rng) for i in range(n_imp)] for k in range(2, min(top, n) + 1)]
            score = np.array([[xie_beni(views[i % len(views)], u, c, m) for i, (c, u) in enumerate(r)] for r in runs])
            k, i = np.unravel_index(score.argmin(), score.shape)
            c0, u0 = runs[k][i]
            base, aligned = views[i % len(views)], [c0]
            for j, (c, u) in enumerate(runs[k]):
                if j != i:
                    a = np.array([signature(base, u0, q) for q in range(len(c0))])
                    b = np.array([signature(views[j % len(views)], u, q) for q in range(len(c))])
                    aligned.append(c[[q for _, q in min_cost_assignment(dist(a, b))]])
            centre = np.mean(aligned, 0).ravel().tolist()
            return pd.DataFrame({"client": p["client"].iloc[0], "id": wide.index, "x": base[:, 0], "y": base[:, 1], "n": n, "centers": [centre] * n})

        cols = clients.select("client", F.col("id").cast("bigint").alias("id"), "feature", F.col("value").cast("double").alias("value"))
        kind = clients.schema["client"].dataType.simpleString()
        rows = materialize(cols.groupBy("client").applyInPandas(local, f"client {kind}, id bigint, x double, y double, n bigint, centers array<double>"), "clients")
        done = rows.groupBy("client").agg(F.first("n").alias("n"), F.first("centers").alias("c")).orderBy("client").collect()
        sizes, found = [r["n"] for r in done], [np.array(r["c"]).reshape(-1, 2) for r in done]
        k = max(1, int(round(sum(n * len(c) for n, c in zip(sizes, found)) / sum(sizes))))
        g = np.zeros((k, 2))
        for j in range(k):
            own = [(n, c[j]) for n, c in zip(sizes, found) if j < len(c)]
            if own:
                g[j] = sum(n * c for n, c in own) / sum(n for n, _ in own)

        def score_all(it):
            for b in it:
                u = ratio(dist(b[["x", "y"]].to_numpy(float), g), 2 / (m - 1))
                yield pd.DataFrame({"id": np.repeat(b["id"].to_numpy(), k), "k": np.tile(np.arange(k), len(b)), "u": u.ravel()})

        return Model("FeMIFuzzy", rows.select("id", "x", "y").mapInPandas(score_all, "id bigint, k int, u double"), k, centers=g, extras={"client_sizes": {r["client"]: r["n"] for r in done}, "client_centers": found})
