"""Fuzzy clusters in the code of an autoencoder that is trained along with them."""

from __future__ import annotations

import numpy as np

from penumbra.functions.membership import dist, uniform
from penumbra.functions.optimise import Adam
from penumbra.operators.base import Model, long_form, register
from penumbra.operators.pairwise import _Pairwise, nearest


class Net:
    """Dense layers with tanh between them."""

    def __init__(self, sizes: list[int], rng: np.random.Generator, prefix: str):
        self.names = [(f"{prefix}w{i}", f"{prefix}b{i}") for i in range(len(sizes) - 1)]
        self.par = {}
        for (w, b), m, n in zip(self.names, sizes, sizes[1:]):
            self.par[w], self.par[b] = rng.uniform(-1, 1, (m, n)) * np.sqrt(6 / (m + n)), np.zeros(n)

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out = [x]
        for i, (w, b) in enumerate(self.names):
            a = out[-1] @ self.par[w] + self.par[b]
            out.append(np.tanh(a) if i < len(self.names) - 1 else a)
        return out

    def backward(self, acts: list[np.ndarray], grad: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(gradients of the parameters, gradient of the input)."""
        out = {}
        for i in range(len(self.names) - 1, -1, -1):
            if i < len(self.names) - 1:
                grad = grad * (1 - acts[i + 1] ** 2)
            w, b = self.names[i]
            out[w], out[b] = acts[i].T @ grad, grad.sum(0)
            grad = grad @ self.par[w].T
        return out, grad


def convolve(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Images (n, channels in, h, w) under kernels (channels out, channels in, k, k), k odd; zeros around, so that the size stays."""
    return np.tensordot(_windows(x, w.shape[2]), w, axes=([1, 4, 5], [1, 2, 3])).transpose(0, 3, 1, 2)


def _windows(x: np.ndarray, k: int) -> np.ndarray:
    pad = np.pad(x, ((0, 0), (0, 0), (k // 2, k // 2), (k // 2, k // 2)))
    return np.lib.stride_tricks.sliding_window_view(pad, (k, k), axis=(2, 3))


class ImageNet:
    """Convolutions with rectified outputs and one dense layer: from an image to its code, or (back) from a code to an image in (0, 1)."""

    def __init__(self, image: tuple[int, int], channels: list[int], kernels: list[int], code: int, rng: np.random.Generator, prefix: str, back: bool = False):
        self.image, self.channels, self.kernels, self.back, self.prefix = image, channels, kernels, back, prefix
        flat = channels[-1] * image[0] * image[1]
        he = lambda shape, into: rng.standard_normal(shape) * np.sqrt(2 / into)
        m, n = (code, flat) if back else (flat, code)
        self.par = {f"{prefix}w": he((m, n), m), f"{prefix}b": np.zeros(n)}
        ends = list(zip([1, *channels], channels))
        self.layers = [(o, i, k) if not back else (i, o, k) for (i, o), k in zip(ends, kernels)]  # channels out and in, width
        if back:
            self.layers.reverse()
        for j, (o, i, k) in enumerate(self.layers):
            self.par |= {f"{prefix}k{j}": he((o, i, k, k), i * k * k), f"{prefix}c{j}": np.zeros(o)}

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """What each layer gives; the last is the output, with one row for each image."""
        out, p = [x], self.prefix
        if self.back:
            out.append((x @ self.par[f"{p}w"] + self.par[f"{p}b"]).reshape(-1, self.channels[-1], *self.image))
        else:
            out.append(x.reshape(-1, 1, *self.image))
        for j in range(len(self.layers)):
            a = convolve(out[-1], self.par[f"{p}k{j}"]) + self.par[f"{p}c{j}"][:, None, None]
            out.append(np.maximum(a, 0) if not self.back or j < len(self.layers) - 1 else 1 / (1 + np.exp(-a)))
        flat = out[-1].reshape(len(x), -1)
        out.append(flat if self.back else flat @ self.par[f"{p}w"] + self.par[f"{p}b"])
        return out

    def backward(self, acts: list[np.ndarray], grad: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """(gradients of the parameters, gradient of the input)."""
        p, out = self.prefix, {}
        if not self.back:
            out |= {f"{p}w": acts[-2].reshape(len(grad), -1).T @ grad, f"{p}b": grad.sum(0)}
            grad = grad @ self.par[f"{p}w"].T
        grad = grad.reshape(acts[-2].shape)
        for j in range(len(self.layers) - 1, -1, -1):
            y = acts[j + 2]
            grad = grad * (y * (1 - y) if self.back and j == len(self.layers) - 1 else y > 0)
            w = self.par[f"{p}k{j}"]
            out |= {f"{p}k{j}": np.tensordot(grad, _windows(acts[j + 1], w.shape[2]), axes=([0, 2, 3], [0, 2, 3])), f"{p}c{j}": grad.sum((0, 2, 3))}
            grad = convolve(grad, w.transpose(1, 0, 2, 3)[:, :, ::-1, ::-1])
        grad = grad.reshape(len(grad), -1)
        if self.back:
            out |= {f"{p}w": acts[0].T @ grad, f"{p}b": grad.sum(0)}
            grad = grad @ self.par[f"{p}w"].T
        return out, grad


@register
class RDFKC(_Pairwise):
    """Robust deep fuzzy k-means: each round a step of the networks, then centres, then memberships that neighbours smooth.

    encoder and decoder are lists of layer widths; neighbours and their similarities are those of the first code. With image, the height and
    width of one-channel pictures whose rows of pixels are the features, the networks are convolutions (channels, kernels). extras: code, loss.
    """

    # fixed values: the channels and kernel widths of the usual networks for pictures
    PARAMS = {"k": 3, "encoder": None, "decoder": None, "image": None, "channels": (6, 12, 16), "kernels": (5, 3, 3), "code": 8, "max_iter": 100, "lr": 1e-4, "mu": 1.0, "gamma": 1e-4, "tau": 0.1, "neighbors": 10, "seed": 0}

    def robust(self, d):
        return (1 + self.tau) * (d + 2 * self.tau) / (2 * (d + self.tau) ** 2)

    def loss(self, x, enc, dec, u, v):
        """(loss, gradients by name, code) of reconstruction, clusters and weights."""
        ea = enc.forward(x)
        z = ea[-1]
        da = dec.forward(z)
        e = da[-1] - x
        gd, gz = dec.backward(da, 2 * e / e.size)
        d = np.maximum(dist(z, v), 1e-12)
        t, w = self.tau, u**2
        value = (1 + t) / 2 * (d + 2 * t) * d**2 / (d + t) ** 2
        slope = (1 + t) / 2 * ((3 * d**2 + 4 * t * d) * (d + t) - 2 * (d**3 + 2 * t * d**2)) / (d + t) ** 3
        gz = gz + ((w * slope / d)[:, :, None] * (z[:, None] - v[None])).sum(1)
        ge, _ = enc.backward(ea, gz)
        par = {**enc.par, **dec.par}
        grads = {k: g + 2 * self.gamma * par[k] for k, g in {**ge, **gd}.items()}
        return float((e**2).mean() + (w * value).sum() + self.gamma * sum((p**2).sum() for p in par.values())), grads, z

    def fit(self, df, *_):
        p, ids, x = self.rows(df)
        rng, k = np.random.default_rng(self.seed), self.k
        enc_sizes = [p.d, *(self.encoder or [max(2 * self.code, p.d), self.code])]
        if self.image is not None:
            if self.image[0] * self.image[1] != p.d:
                raise ValueError(f"{p.d} features are no picture of {self.image[0]} x {self.image[1]}")
            shape = (tuple(self.image), list(self.channels), list(self.kernels), self.code, rng)
            enc, dec = ImageNet(*shape, "e"), ImageNet(*shape, "d", back=True)
        else:
            enc, dec = Net(enc_sizes, rng, "e"), Net([*(self.decoder or enc_sizes[::-1])], rng, "d")
        z = enc.forward(x)[-1]
        u = uniform(ids, k, self.seed)
        u /= u.sum(1, keepdims=True)
        v = rng.standard_normal((k, z.shape[1]))
        nn = min(self.neighbors, p.n - 1)
        near_of = lambda z: nearest(p.spark, z, nn) if nn else np.zeros((len(z), 0), int)
        # similarities as a sorted table of pairs, each neighbour counted in both directions
        first = near_of(z)
        a, b = np.repeat(np.arange(len(z)), nn), first.ravel()
        half = np.exp(-np.linalg.norm(z[a] - z[b], axis=1) / 0.5) / 2
        pair, at = np.unique(np.concatenate([a * len(z) + b, b * len(z) + a]), return_inverse=True)
        sim = np.bincount(at, np.concatenate([half, half]), len(pair)) if len(pair) else np.zeros(0)

        def similarity(near):
            want = (np.arange(len(near))[:, None] * len(near) + near).ravel()
            i = np.minimum(np.searchsorted(pair, want), max(len(pair) - 1, 0))
            return np.where(pair[i] == want, sim[i], 0.0).reshape(near.shape) if len(pair) else np.zeros(near.shape)

        adam, history = Adam(self.lr), []
        for _ in range(self.max_iter):
            value, grads, z = self.loss(x, enc, dec, u, v)
            par = {**enc.par, **dec.par}
            adam.step(par, grads)
            w = u**2 * self.robust(dist(z, v))
            v = (w.T @ z) / (w.sum(0)[:, None] + 1e-8)
            near = near_of(z)
            s = similarity(near)
            d = dist(z, v) + 1e-8
            pull = 2 * self.mu * np.einsum("nj,njk->nk", s, u[near])
            q = (1 + self.tau) * d**2 / (d + self.tau) + self.mu * s.sum(1, keepdims=True)
            lam = (2 - (pull / q).sum(1)) / ((1 / q).sum(1) + 1e-8)
            u = (pull + lam[:, None]) / (2 * q + 1e-8)
            history.append(value)
        u = np.maximum(u, 0)
        return Model("RDFKC", lambda: long_form(p.spark, ids, u / np.maximum(u.sum(1, keepdims=True), 1e-12)), k, centers=v, history=history, n_iter=len(history), extras={"code": z})
