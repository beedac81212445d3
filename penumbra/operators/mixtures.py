"""Partitions with shapes: covariance-norm c-means and finite mixtures. A sweep sums moments; small dense algebra is done on the driver."""

from __future__ import annotations

import numpy as np

from penumbra.functions.membership import TINY, betaln, cholesky_or_ridge, dirichlet, dist, logsumexp, mahalanobis, ratio, softmax, sqdist, uniform
from penumbra.operators.base import Estimator, Points, kmeanspp, random_rows, register
from penumbra.operators.prototypes import EPS, floored, moments


def second(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Weighted sums of outer products, (k, d, d)."""
    return np.stack([(x * v[:, None]).T @ x for v in w.T])


def covariances(s0, s1, s2, c, floor=0.0):
    """Weighted covariances about the centres c from the moments."""
    n = s0 + floor
    cross = np.einsum("kd,ke->kde", s1, c)
    return (s2 - cross - cross.transpose(0, 2, 1) + s0[:, None, None] * np.einsum("kd,ke->kde", c, c)) / n[:, None, None]


@register
class GK(Estimator):
    """Fuzzy c-means with a volume-preserving Mahalanobis norm for each cluster. extras: covariances, metrics."""

    PARAMS = {"k": 3, "m": 2.0, "max_iter": 300, "tol": 1e-5, "init": "kmeans++", "reg_covar": 1e-6, "seed": 0}

    def d2(self, x, c, factors):
        d = np.column_stack([np.exp(2 * np.log(np.diag(f)).sum() / x.shape[1]) * mahalanobis(x, v, f) for v, f in zip(c, factors)])
        return np.maximum(d, 1e-18)

    def u(self, x, c, factors):
        return floored(ratio(self.d2(x, c, factors), 1 / (self.m - 1)))

    def fit(self, df, *_):
        p = self.points(df)
        k, eye, eps = self.k, np.eye(p.d), 10 * np.finfo(float).eps
        if isinstance(self.init, str) and self.init == "random":
            now = lambda ids, x: dirichlet(ids, k, self.seed)
            s0, s1 = p.reduce(lambda ids, x: moments(now(ids, x) ** self.m, x))
            c = s1 / (s0[:, None] + EPS)
        else:
            c = self.start(p, "kmeans++")
            now = lambda ids, x: np.full((len(x), k), 1 / k)
        s0, s1, s2 = p.reduce(lambda ids, x: (*moments(w := now(ids, x) ** self.m, x), second(w, x)))
        old, history = np.inf, []
        for _ in range(self.max_iter):
            cov = covariances(s0, s1, s2, c, EPS) + self.reg_covar * eye
            factors = [cholesky_or_ridge(s, eps) for s in cov]

            def step(ids, x, c=c, f=factors):
                d = self.d2(x, c, f)
                w = floored(ratio(d, 1 / (self.m - 1))) ** self.m
                return (*moments(w, x), second(w, x), (w * d).sum())

            s0, s1, s2, obj = p.reduce(step)
            now = lambda ids, x, c=c, f=factors: self.u(x, c, f)
            c = s1 / (s0[:, None] + EPS)
            history.append(float(obj))
            if abs(old - float(obj)) <= self.tol:
                break
            old = float(obj)
        metrics = np.array([np.exp(2 * np.log(np.diag(f)).sum() / p.d) * np.linalg.inv(f @ f.T) for f in factors])
        return self.model(p, now, k, centers=c, history=history, n_iter=len(history), extras={"covariances": cov, "metrics": metrics})


@register
class GathGeva(Estimator):
    """Fuzzy maximum-likelihood clustering with exponential distances. extras: covariances, priors."""

    PARAMS = {"k": 3, "m": 2.0, "max_iter": 100, "tol": 1e-5, "reg_covar": 1e-6, "init": "fcm", "init_iter": 20, "seed": 0}

    def shapes(self, p: Points, s0, s1, s2):
        n = np.maximum(s0, TINY)
        c = s1 / n[:, None]
        cov = covariances(s0, s1, s2, c)
        scale, ridge = max(float(np.abs(np.trace(cov, axis1=1, axis2=2)).mean()), 1.0), self.reg_covar
        for _ in range(12):
            try:
                factors = np.linalg.cholesky(cov + np.eye(p.d) * ridge * scale)
                break
            except np.linalg.LinAlgError:
                ridge = ridge * 10 if ridge > 0 else 1e-10
        else:
            ridge, factors = 1.0, np.linalg.cholesky(cov + np.eye(p.d) * scale)
        return c, cov + np.eye(p.d) * ridge * scale, factors, np.maximum(n / p.n, TINY)

    def u(self, x, c, factors, priors):
        log = np.column_stack([np.log(np.diag(f)).sum() - np.log(q) + 0.5 * mahalanobis(x, v, f) for v, f, q in zip(c, factors, priors)])
        return softmax(-log / (self.m - 1))

    def fit(self, df, *_):
        p = self.points(df)
        k = self.k
        if isinstance(self.init, str) and self.init == "random":
            now = lambda ids, x: dirichlet(ids, k, self.seed)
        else:
            c = np.array(self.init, float) if not isinstance(self.init, str) else kmeanspp(p, k, self.seed)
            for _ in range(max(1, self.init_iter)):
                now = lambda ids, x, c=c: ratio(dist(x, c), 2 / (self.m - 1))
                s0, s1 = p.reduce(lambda ids, x, now=now: moments(now(ids, x) ** self.m, x))
                c = s1 / np.maximum(s0, TINY)[:, None]
        steps = 0
        sums = lambda now: p.reduce(lambda ids, x: (*moments(w := now(ids, x) ** self.m, x), second(w, x)))
        for _ in range(self.max_iter):
            c, cov, factors, priors = self.shapes(p, *sums(now))
            new = lambda ids, x, a=(c, factors, priors): self.u(x, *a)
            ids, x = p.first(lambda ids, x, now=now, new=new: -np.abs(new(ids, x) - now(ids, x)).max(1), 1)
            moved = np.abs(new(ids, x) - now(ids, x)).max()
            now, steps = new, steps + 1
            if moved < self.tol:
                break
        c, cov, factors, priors = self.shapes(p, *sums(now))
        return self.model(p, now, k, centers=c, n_iter=steps, extras={"covariances": cov, "priors": priors})


def lloyd(p: Points, c: np.ndarray, max_iter: int = 100, tol: float = 1e-6) -> np.ndarray:
    """k-means to convergence; a cluster without points keeps its centre."""
    for _ in range(max_iter):
        n, s = p.reduce(lambda ids, x, c=c: moments(np.eye(len(c))[sqdist(x, c).argmin(1)], x))
        new = np.where((n > 0)[:, None], s / np.maximum(n, 1)[:, None], c)
        moved, c = np.abs(new - c).max(), new
        if moved <= tol:
            break
    return c


@register
class GMM(Estimator):
    """Gaussian mixture by EM; covariance_type full, diag or spherical. history is the log likelihood. extras: weights, covariances."""

    PARAMS = {"k": 3, "covariance_type": "full", "reg_covar": 1e-6, "max_iter": 100, "tol": 1e-3, "init": "kmeans", "seed": 0}

    def check(self):
        super().check()
        if self.covariance_type not in ("full", "diag", "spherical"):
            raise ValueError(f"no covariance_type {self.covariance_type}")

    def log_joint(self, x, w, c, cov):
        d, e, out = x.shape[1], self.reg_covar, []
        for k in range(len(c)):
            if self.covariance_type == "full":
                f = cholesky_or_ridge(cov[k] + e * np.eye(d), 10 * e)
                out.append(-0.5 * (d * np.log(2 * np.pi) + 2 * np.log(np.diag(f)).sum() + mahalanobis(x, c[k], f)))
            elif self.covariance_type == "diag":
                v = cov[k] + e
                out.append(-0.5 * (np.log(2 * np.pi * v).sum() + ((x - c[k]) ** 2 / v).sum(1)))
            else:
                v = cov[k] + e
                out.append(-0.5 * (d * np.log(2 * np.pi * v) + ((x - c[k]) ** 2).sum(1) / v))
        return np.column_stack(out) + np.log(w + 1e-32)

    def fit(self, df, *_):
        p = self.points(df)
        k, d = self.k, p.d
        if isinstance(self.init, str):
            c = random_rows(p, k, self.seed) if self.init == "random" else kmeanspp(p, k, self.seed)
            c = lloyd(p, c) if self.init == "kmeans" else c
        else:
            c = np.array(self.init, float)
        s, outer = p.reduce(lambda ids, x: (x.sum(0), x.T @ x))
        total = (outer - np.outer(s, s) / p.n) / max(p.n - 1, 1)
        base = {"full": total + self.reg_covar * np.eye(d), "diag": np.diag(total) + self.reg_covar, "spherical": np.diag(total).mean() + self.reg_covar}[self.covariance_type]
        w, cov, old, history = np.full(k, 1 / k), np.array([base] * k), -np.inf, []
        for _ in range(self.max_iter):

            def resp(ids, x, a=(w, c, cov)):
                return softmax(self.log_joint(x, *a))

            def step(ids, x, a=(w, c, cov), resp=resp):
                r = resp(ids, x)
                quad = second(r, x) if self.covariance_type == "full" else r.T @ (x * x)
                return (logsumexp(self.log_joint(x, *a)).sum(), *moments(r, x), quad)

            ll, s0, s1, s2 = p.reduce(step)
            n = s0 + EPS
            w, c = n / p.n, s1 / n[:, None]
            if self.covariance_type == "full":
                cov = covariances(s0, s1, s2, c, EPS) + self.reg_covar * np.eye(d)
            else:
                v = (s2 - 2 * c * s1 + s0[:, None] * c * c) / n[:, None]
                cov = (v if self.covariance_type == "diag" else v.mean(1)) + self.reg_covar
            history.append(float(ll))
            if abs(float(ll) - old) <= self.tol:
                break
            old = float(ll)
        return self.model(p, resp, k, centers=c, history=history, n_iter=len(history), extras={"weights": w, "covariances": cov, "lower_bound": history[-1]}, rule=lambda x: softmax(self.log_joint(x, w, c, cov)))


def _beta_shapes(mean, var):
    """Method of moments, with the mean clipped after the variance was taken about it."""
    mean, var = np.clip(mean, 0.001, 0.999), np.maximum(var, 1e-5)
    common = mean * (1 - mean) / var - 1
    return np.maximum(mean * common, 0.01), np.maximum((1 - mean) * common, 0.01)


def _log_beta(x, a, b):
    """Sums over features of log beta densities, (n, k); 0 times log 0 is 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        l0, l1 = np.log(x), np.log1p(-x)
        one = lambda e, l: np.where(e == 0, 0.0, e * l)
        return np.column_stack([(one(a[k] - 1, l0) + one(b[k] - 1, l1) - betaln(a[k], b[k])).sum(1) for k in range(len(a))])


@register
class MBMM(Estimator):
    """Mixture of products of beta densities, for features in (0, 1). extras: weights, alpha, beta."""

    PARAMS = {"k": 3, "max_iter": 100, "tol": 1e-5, "seed": 0, "alpha": None, "beta": None}

    def fit(self, df, *_):
        p = self.points(df)
        lo, hi = p.reduce(lambda ids, x: ((x <= 0).sum(), (x >= 1).sum()))
        if lo or hi:
            raise ValueError("all features must lie between 0 and 1")
        rng = np.random.default_rng(self.seed)
        draw = lambda v: rng.uniform(1, 3, (self.k, p.d)) if v is None else np.array(v, float)
        a, b, w, old, history = draw(self.alpha), draw(self.beta), np.full(self.k, 1 / self.k), -np.inf, []
        for _ in range(self.max_iter):

            def r(ids, x, s=(w, a, b)):
                return softmax(np.log(s[0] + 1e-10) + _log_beta(x, s[1], s[2]))

            s0, s1, s2 = p.reduce(lambda ids, x, r=r: (*moments(q := r(ids, x), x), q.T @ (x * x)))
            n = s0 + 1e-10
            w, mean = n / p.n, s1 / n[:, None]
            a, b = _beta_shapes(mean, (s2 - 2 * mean * s1 + s0[:, None] * mean * mean) / n[:, None])
            ll = float(p.reduce(lambda ids, x, r=r, s=(w, a, b): ((r(ids, x) * (np.log(s[0] + 1e-10) + _log_beta(x, s[1], s[2]))).sum(),))[0])
            history.append(ll)
            if abs(ll - old) < self.tol:
                break
            old = ll
        return self.model(p, r, self.k, history=history, n_iter=len(history), extras={"weights": w, "alpha": a, "beta": b})


@register
class BGMM(Estimator):
    """Mixture over two views: a normal one (features[0]) and one in (0, 1) (features[1]). extras: weights, mu, sigma, alpha, beta.

    init="quantile" starts the normal means apart; with init="uniform" all components start alike and stay so.
    """

    PARAMS = {"k": 3, "max_iter": 100, "tol": 1e-5, "init": "quantile", "seed": 0}

    def fit(self, df, *_):
        p = self.points(df)
        k = self.k
        s, q = p.reduce(lambda ids, x: (x[:, 0].sum(), (x[:, 0] ** 2).sum()))
        mean, std = s / p.n, np.sqrt(max(q / p.n - (s / p.n) ** 2, 0))
        mu = np.full(k, mean) if self.init == "uniform" else mean + std * 2 * ((np.arange(k) + 0.5) / k - 0.5) * 1.5
        sigma, a, b, w, old, history = np.full(k, std + 0.001), np.full((k, 1), 2.0), np.full((k, 1), 2.0), np.full(k, 1 / k), -np.inf, []

        def log(x, s):
            w, mu, sigma, a, b = s
            return np.log(w + 1e-10) - 0.5 * np.log(2 * np.pi) - np.log(sigma) - 0.5 * ((x[:, :1] - mu) / sigma) ** 2 + _log_beta(x[:, 1:2], a, b)

        for _ in range(self.max_iter):
            state = (w, mu, sigma, a, b)
            s0, s1, s2 = p.reduce(lambda ids, x, s=state: (*moments(r := softmax(log(x, s)), x[:, :2]), r.T @ (x[:, :2] ** 2)))
            n = s0 + 1e-10
            w, m = n / p.n, s1 / n[:, None]
            v = (s2 - 2 * m * s1 + s0[:, None] * m * m) / n[:, None]
            mu, sigma = m[:, 0], np.sqrt(np.maximum(v[:, 0], 0)) + 0.001
            a, b = _beta_shapes(m[:, 1:2], v[:, 1:2])
            ll = float(p.reduce(lambda ids, x, s=state, t=(w, mu, sigma, a, b): ((softmax(log(x, s)) * log(x, t)).sum(),))[0])
            history.append(ll)
            if abs(ll - old) < self.tol:
                break
            old = ll
        return self.model(p, lambda ids, x: softmax(log(x, state)), k, history=history, n_iter=len(history), extras={"weights": w, "mu": mu, "sigma": sigma, "alpha": a[:, 0], "beta": b[:, 0]})


__all__ = ["GK", "GathGeva", "GMM", "MBMM", "BGMM", "lloyd", "uniform"]
