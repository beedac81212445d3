"""Partitions of images: pixels (row, col, value) or (row, col, features), of one image that fits in memory."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from penumbra.functions.membership import dirichlet, ratio, sqdist
from penumbra.operators.base import Estimator, Model, long_form, register
from penumbra.operators.pairwise import DENSE, pair_map

PIXELS = 4_000_000


def read_pixels(df: DataFrame, limit: int = PIXELS) -> tuple[np.ndarray, int, int]:
    """(values (h * w, d), h, w) of a full image in row order; missing or repeated pixels raise."""
    col = "value" if "value" in df.columns else "features"
    n = df.count()
    if n > limit:
        raise ValueError(f"{n} pixels: one image is limited to {limit}; tile larger ones")
    t = df.select("row", "col", F.col(col).alias("v")).orderBy("row", "col").toArrow()
    v = np.array(t["v"].to_pylist(), float).reshape(n, -1)
    h, w = (int(max(t[c].to_pylist(), default=-1)) + 1 for c in ("row", "col"))
    if h * w != n or not np.isfinite(v).all():
        raise ValueError(f"{n} pixels do not fill {h} x {w}, or some have no finite value")
    return v, h, w


def correlate(img: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Two-dimensional correlation; the image is mirrored at its edges (edge pixels twice)."""
    a, b = kernel.shape[0] // 2, kernel.shape[1] // 2
    pad = np.pad(img, ((a, a), (b, b)), mode="symmetric")
    return sum(kernel[i, j] * pad[i : i + img.shape[0], j : j + img.shape[1]] for i in range(kernel.shape[0]) for j in range(kernel.shape[1]))


def box3(img: np.ndarray) -> np.ndarray:
    return correlate(img, np.full((3, 3), 1 / 9))


def gauss(img: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    t = np.arange(-int(4 * sigma + 0.5), int(4 * sigma + 0.5) + 1)
    g = np.exp(-(t**2) / (2 * sigma**2))
    g /= g.sum()
    return correlate(correlate(img, g[:, None]), g[None, :])


def laplace(img: np.ndarray) -> np.ndarray:
    return correlate(img, np.array([[0, 1, 0], [1, -4, 1], [0, 1, 0]], float))


@register
class AFCMAdaptive(Estimator):
    """Fuzzy c-means of grey values with a smooth gain field. Ids are row * width + col. extras: multiplier, shape."""

    PARAMS = {"k": 3, "m": 2.0, "k1": 0.1, "k2": 0.1, "max_iter": 100, "tol": 1e-4, "seed": 0, "init": None}

    def fit(self, df, *_):
        v, h, w = read_pixels(df)
        img, ids = v[:, 0].reshape(h, w), np.arange(h * w)
        u, b = (dirichlet(ids, self.k, self.seed) if self.init is None else np.array(self.init, float)).reshape(h, w, self.k), np.ones((h, w))
        c, steps = np.linspace(img.min(), img.max(), self.k), 0
        for _ in range(self.max_iter):
            q, before = u**self.m, c
            n = q.sum((0, 1)) + 1e-8
            square = (q * (img**2 / (b**2 + 1e-8))[..., None]).sum((0, 1))
            plain = (q * (img / (b + 1e-8))[..., None]).sum((0, 1))
            c = plain / n / (square / n + 1e-8)
            top = (q * (img[..., None] - b[..., None] * c) * -c).sum(2)
            b = top / ((q * c**2).sum(2) + 1e-8) - self.k1 * gauss(b) + self.k2 * laplace(b)
            d = np.maximum((img[..., None] - b[..., None] * c) ** 2, 1e-8)
            u, steps = ratio(d.reshape(h * w, -1), 1 / (self.m - 1)).reshape(h, w, -1), steps + 1
            if np.linalg.norm(c - before) < self.tol:
                break
        return Model("AFCMAdaptive", lambda: long_form(df.sparkSession, ids, u.reshape(h * w, -1)), self.k, centers=c[:, None], n_iter=steps, extras={"multiplier": b, "shape": (h, w)})


@register
class SKFCM(Estimator):
    """Kernel fuzzy c-means with a spatial term: neighbours in the image pull a pixel to their cluster."""

    PARAMS = {"k": 3, "m": 2.0, "gamma": 1.0, "lambda_": 0.5, "max_iter": 100, "tol": 1e-5, "seed": 0, "init": None}

    def fit(self, df, *_):
        x, h, w = read_pixels(df, 60_000)
        n, ids, spark = len(x), np.arange(len(x)), df.sparkSession
        gram = np.exp(-self.gamma * sqdist(x, x)) if n <= DENSE else None
        u, steps = dirichlet(ids, self.k, self.seed) if self.init is None else np.array(self.init, float), 0
        for _ in range(self.max_iter):
            q = u**self.m
            kq = gram @ q if gram is not None else pair_map(spark, x, lambda a, b, _: np.exp(-self.gamma * sqdist(a, b)) @ q)
            s = q.sum(0)
            near = np.column_stack([box3(u[:, k].reshape(h, w)).ravel() for k in range(self.k)])
            d = 1 - 2 / s * kq + (q * kq).sum(0) / s**2 + self.lambda_ * (1 - near)
            new, steps = ratio(np.maximum(d, 1e-10), 1 / (self.m - 1)), steps + 1
            moved, u = np.linalg.norm(new - u), new
            if moved < self.tol:
                break
        return Model("SKFCM", lambda: long_form(spark, ids, u), self.k, n_iter=steps, extras={"shape": (h, w)})
