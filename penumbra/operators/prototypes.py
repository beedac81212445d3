"""Partitions around centres whose step is linear in the points: fuzzy, possibilistic, evidential, rough and kernel means.

In each, the memberships of a point follow from the centres (and a few numbers per cluster), so that a step is one sweep that sums the
weighted moments of every cluster; memberships are never stored between steps.
"""

from __future__ import annotations

import numpy as np

from penumbra.functions.membership import TINY, dirichlet, dist, ratio, softmax, sqdist, uniform
from penumbra.operators.base import Estimator, Extras, Model, Points, kmeanspp, random_rows, register
from penumbra.session import forget

EPS = 1e-12


def floored(u: np.ndarray) -> np.ndarray:
    u = np.maximum(u, EPS)
    return u / u.sum(1, keepdims=True)


def moments(w: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Total weight of each cluster and weighted sums of the points."""
    return w.sum(0), w.T @ x


@register
class FCM(Estimator):
    """Fuzzy c-means. history is the objective at the new centres with the memberships that gave them."""

    PARAMS = {"k": 3, "m": 2.0, "max_iter": 300, "tol": 1e-5, "init": "kmeans++", "seed": 0}

    def u(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return floored(ratio(sqdist(x, c) + EPS, 1 / (self.m - 1)))

    def fit(self, df, *_):
        p = self.points(df)
        if isinstance(self.init, str) and self.init == "random":
            s0, s1 = p.reduce(lambda ids, x: moments(dirichlet(ids, self.k, self.seed) ** self.m, x))
            c = s1 / (s0[:, None] + EPS)
        else:
            c = self.start(p, "kmeans++")
        old, history, before = np.inf, [], c
        for _ in range(self.max_iter):

            def step(ids, x, c=c):
                w = self.u(x, c) ** self.m
                return (*moments(w, x), w.T @ (x * x).sum(1))

            s0, s1, s2 = p.reduce(step)
            before, c = c, s1 / (s0[:, None] + EPS)
            obj = float((s2 - 2 * (c * s1).sum(1) + s0 * (c * c).sum(1)).sum())
            history.append(obj)
            if abs(old - obj) <= self.tol:
                break
            old = obj
        return self.model(p, lambda ids, x: self.u(x, before), len(c), centers=c, history=history, n_iter=len(history), rule=lambda x: self.u(x, c))


@register
class PCM(Estimator):
    """Possibilistic c-means: typicalities, which need not sum to one. extras: etas."""

    PARAMS = {"k": 3, "m": 2.0, "alpha": 1.0, "max_iter": 300, "tol": 1e-5, "init": "kmeans++", "seed": 0}
    CONSTRAINED = False

    def t(self, x, c, eta):
        return np.clip(1 / (1 + ((sqdist(x, c) + EPS) / (eta[None, :] + EPS)) ** (1 / (self.m - 1))), EPS, 1.0)

    def fit(self, df, *_):
        p = self.points(df)
        c = self.start(p, "random" if isinstance(self.init, str) and self.init == "random" else "kmeans++")

        def spread(ids, x):
            d = sqdist(x, c)
            own = np.eye(len(c))[d.argmin(1)]
            return own.sum(0), (own * d).sum(0), d.sum(0)

        n, own, every = p.reduce(spread)
        eta = np.maximum(self.alpha * (np.where(n > 0, own / np.maximum(n, 1), every / p.n) + EPS), EPS)
        old, history = np.inf, []

        def step(ids, x, c, eta):
            """Moments under the typicalities of c and eta, and the objective of both."""
            d = sqdist(x, c)
            t = np.clip(1 / (1 + ((d + EPS) / (eta[None, :] + EPS)) ** (1 / (self.m - 1))), EPS, 1.0)
            w = t**self.m
            return (*moments(w, x), w.T @ (x * x).sum(1), (w * d).sum() + (eta * (1 - t) ** self.m).sum())

        s0, s1, s2, obj = p.reduce(lambda ids, x: step(ids, x, c, eta))
        for _ in range(self.max_iter):
            new = s1 / (s0[:, None] + EPS)
            d = np.maximum(s2 - 2 * (new * s1).sum(1) + s0 * (new * new).sum(1), 0.0)
            eta = np.maximum(self.alpha * (d / (s0 + EPS) + EPS), EPS)
            c = new
            s0, s1, s2, obj = p.reduce(lambda ids, x, c=c, eta=eta: step(ids, x, c, eta))
            history.append(float(obj))
            if abs(old - obj) <= self.tol:
                break
            old = obj
        return self.model(p, lambda ids, x: self.t(x, c, eta), len(c), centers=c, history=history, n_iter=len(history), extras={"etas": eta}, rule=lambda x: self.t(x, c, eta))


@register
class PFCM(Estimator):
    """Possibilistic fuzzy c-means. extras: gamma, typicalities (id, k, u); transform gives memberships of new points."""

    PARAMS = {"k": 3, "m": 2.0, "typicality_fuzzifier": 2.0, "membership_weight": 1.0, "typicality_weight": 1.0, "max_iter": 150, "tol": 1e-5, "init": None, "seed": 0}

    def u(self, x, c):
        return ratio(sqdist(x, c) + 1e-10, 1 / (self.m - 1))

    def t(self, x, c, gamma):
        return 1 / (1 + ((sqdist(x, c) + 1e-10) / gamma) ** (1 / (self.typicality_fuzzifier - 1)))

    def fit(self, df, *_):
        p = self.points(df)
        c, steps, gamma, before = self.start(p), 0, np.ones(self.k), None
        for _ in range(self.max_iter):

            def spread(ids, x, c=c):
                w = self.u(x, c) ** self.m
                return w.sum(0), (w * (sqdist(x, c) + 1e-10)).sum(0)

            s0, sd = p.reduce(spread)
            gamma, steps, before = sd / s0, steps + 1, c

            def step(ids, x, c=c, gamma=gamma):
                return moments(self.membership_weight * self.u(x, c) ** self.m + self.typicality_weight * self.t(x, c, gamma) ** self.typicality_fuzzifier, x)

            s0, s1 = p.reduce(step)
            c = s1 / s0[:, None]
            if np.sqrt(((c - before) ** 2).sum(1)).max() < self.tol:
                break
        return self.model(p, lambda ids, x: self.u(x, before), self.k, centers=c, n_iter=steps, extras=Extras({"gamma": gamma}, {"typicalities": lambda: p.assign(lambda ids, x: self.t(x, before, gamma))}), rule=lambda x: self.u(x, c))


class _Alternating(Estimator):
    """Memberships and centres in turn, stopping by the shift of centres before the new ones are taken."""

    def u(self, x, c, m=None):
        return ratio(dist(x, c) + 1e-8, 2 / ((m or self.m) - 1))

    def new_centres(self, s0, s1):
        return s1 / s0[:, None]

    def run(self, p: Points, c: np.ndarray, m: float):
        """(centres, centres that gave the accepted memberships or None, steps)."""
        gave, steps = None, 0
        for _ in range(self.max_iter):
            s0, s1 = p.reduce(lambda ids, x, c=c: moments(self.u(x, c, m) ** m, x))
            new, steps = self.new_centres(s0, s1), steps + 1
            if np.linalg.norm(c - new) < self.tol:
                break
            gave, c = c, new
        return c, gave, steps


@register
class CAFCM(_Alternating):
    """Fuzzy c-means with a fuzzifier that cools from m_start to m_end."""

    PARAMS = {"k": 3, "m_start": 2.0, "m_end": 1.01, "cooling_rate": 0.95, "max_iter": 100, "tol": 1e-5, "init": None, "seed": 0}

    def fit(self, df, *_):
        p = self.points(df)
        c, m, steps, last = self.start(p), self.m_start, 0, None
        while m > self.m_end:
            c, gave, n = self.run(p, c, m)
            steps += n
            if gave is not None:
                last = (gave, m)
            m *= self.cooling_rate
        at, m = last or (c, self.m_start)
        return self.model(p, lambda ids, x: self.u(x, at, m), self.k, centers=c, n_iter=steps)


@register
class CAFHFCM(_Alternating):
    """Fuzzy c-means whose centres are pushed by their distances to each other (alpha)."""

    PARAMS = {"k": 3, "m": 2.0, "alpha": 0.1, "max_iter": 100, "tol": 1e-5, "init": None, "seed": 0}

    def new_centres(self, s0, s1):
        base = s1 / s0[:, None]
        return base - self.alpha * (len(base) * base - base.sum(0))

    def fit(self, df, *_):
        p = self.points(df)
        c, gave, steps = self.run(p, self.start(p), self.m)
        at = c if gave is None else gave
        return self.model(p, lambda ids, x: self.u(x, at), self.k, centers=c, n_iter=steps)


@register
class AFCMSimple(_Alternating):
    """Fuzzy c-means from random memberships, stopping by how far memberships move."""

    PARAMS = {"k": 3, "m": 2.0, "max_iter": 100, "tol": 1e-5, "init": None, "seed": 0}

    def fit(self, df, *_):
        p = self.points(df)
        init = None if self.init is None else np.array(self.init, float)
        now = (lambda ids, x: dirichlet(ids, self.k, self.seed)) if init is None else (lambda ids, x: self.u(x, init))
        c, steps = init, 0
        s0, s1 = p.reduce(lambda ids, x: moments(now(ids, x) ** self.m, x))
        for _ in range(self.max_iter):
            c, steps = s1 / s0[:, None], steps + 1

            def step(ids, x, c=c, now=now):
                u = self.u(x, c)
                return (((u - now(ids, x)) ** 2).sum(), *moments(u**self.m, x))

            moved, s0, s1 = p.reduce(step)
            if np.sqrt(moved) < self.tol:
                break
            now = lambda ids, x, c=c: self.u(x, c)
        return self.model(p, now, self.k, centers=c, n_iter=steps)


@register
class ENTROPYFCM(_Alternating):
    """Fuzzy c-means that starts from random memberships; extras: compactness and entropy. entropy_weight has no effect on the fit."""

    PARAMS = {"k": 3, "m": 2.0, "entropy_weight": 1.0, "max_iter": 100, "tol": 1e-5, "init": None, "seed": 0}

    def fit(self, df, *_):
        p = self.points(df)
        init = self.init
        c = random_rows(p, self.k, self.seed) if init is None else np.array(init, float)
        now = (lambda ids, x: dirichlet(ids, self.k, self.seed)) if init is None else (lambda ids, x, c=c: self.u(x, c))
        steps = 0
        for _ in range(self.max_iter):
            s0, s1 = p.reduce(lambda ids, x, now=now: moments(now(ids, x) ** self.m, x))
            new, steps = s1 / s0[:, None], steps + 1
            if np.linalg.norm(c - new) < self.tol:
                break
            c = new
            now = lambda ids, x, c=c: self.u(x, c)

        def value(ids, x):
            u = now(ids, x)
            return (u**self.m * dist(x, c) ** 2).sum(), -(u * np.log(u + 1e-8)).sum()

        a, b = p.reduce(value)
        return self.model(p, now, self.k, centers=c, n_iter=steps, extras={"compactness": float(a), "entropy": float(b)})


@register
class ECM(Estimator):
    """Evidential c-means over single clusters and noise. extras: mass (id, k, u), where the last k is noise."""

    PARAMS = {"k": 3, "m": 2.0, "delta": 10.0, "max_iter": 100, "tol": 1e-5, "init": None, "seed": 0}

    def mass(self, x, c):
        d = np.maximum(dist(x, c) ** 2, 1e-10)
        return ratio(np.column_stack([d, np.full(len(d), self.delta**2)]), 1 / (self.m - 1))

    def u(self, x, c):
        m = self.mass(x, c)[:, :-1]
        return m / np.maximum(m.sum(1, keepdims=True), EPS)

    def fit(self, df, *_):
        p = self.points(df)
        c, steps, gave = self.start(p), 0, None
        for _ in range(self.max_iter):
            s0, s1 = p.reduce(lambda ids, x, c=c: moments(self.mass(x, c)[:, :-1] ** self.m, x))
            new, steps, gave = s1 / (s0[:, None] + 1e-10), steps + 1, c
            if np.linalg.norm(new - c) < self.tol:
                break
            c = new
        return self.model(p, lambda ids, x: self.u(x, gave), self.k, centers=c, n_iter=steps, extras=Extras({}, {"mass": lambda: p.assign(lambda ids, x: self.mass(x, gave))}))


@register
class FCC(Estimator):
    """Fuzzy colour clustering: a point within the just noticeable difference of a centre belongs to it wholly."""

    PARAMS = {"k": 3, "jnd": 20.0, "max_iter": 100, "tol": 1e-5, "init": None, "seed": 0}

    def u(self, x, c):
        d = dist(x, c)
        w = np.where(d <= self.jnd, 1.0, 1 / (1 + np.maximum(d - self.jnd, 0)))
        return w / w.sum(1, keepdims=True)

    def fit(self, df, *_):
        p = self.points(df)
        c, steps, gave = self.start(p), 0, None
        for _ in range(self.max_iter):
            s0, s1 = p.reduce(lambda ids, x, c=c: moments(self.u(x, c) ** 2, x))
            new, steps, gave = s1 / (s0[:, None] + 1e-8), steps + 1, c
            if np.linalg.norm(c - new) < self.tol:
                break
            c = new
        return self.model(p, lambda ids, x: self.u(x, gave), self.k, centers=c, n_iter=steps)


@register
class KFCM(Estimator):
    """Kernel fuzzy c-means with a Gaussian kernel and centres in the space of the points."""

    PARAMS = {"k": 3, "m": 2.0, "sigma": 1.0, "epsilon": 0.01, "max_iter": 100, "init": "kmeans++", "seed": 0}

    def check(self):
        super().check()
        if self.sigma <= 0:
            raise ValueError("sigma must be positive")

    def kernel(self, x, c):
        return np.exp(-sqdist(x, c) / self.sigma**2)

    def u(self, x, c):
        d = 1 - self.kernel(x, c)
        return ratio(np.where(d == 0, np.finfo(float).eps, d), 1 / (self.m - 1))

    def fit(self, df, *_):
        p = self.points(df)
        given = self.init is not None and not isinstance(self.init, str)
        c, steps = self.start(p, "kmeans++"), 0
        now = (lambda ids, x, c=c: self.u(x, c)) if given else (lambda ids, x: uniform(ids, self.k, self.seed) / uniform(ids, self.k, self.seed).sum(1, keepdims=True))
        if p.local is not None:
            return self._held(p, c, now)
        for _ in range(self.max_iter):
            s0, s1 = p.reduce(lambda ids, x, c=c, now=now: moments(now(ids, x) ** self.m * self.kernel(x, c), x))
            c, steps = np.where((s0 > 1e-9)[:, None], s1 / np.maximum(s0, 1e-300)[:, None], c), steps + 1
            new = lambda ids, x, c=c: self.u(x, c)
            if steps < self.max_iter and _largest_move(p, now, new) < self.epsilon:
                now = new
                break
            now = new
        return self.model(p, now, self.k, centers=c, n_iter=steps)

    def _held(self, p: Points, c: np.ndarray, now) -> Model:
        """The same steps with the memberships held, as the points are."""
        ids, x, _ = p.local
        u, steps = now(ids, x), 0
        kern = self.kernel(x, c)
        for _ in range(self.max_iter):
            s0, s1 = moments(u**self.m * kern, x)
            c, steps = np.where((s0 > 1e-9)[:, None], s1 / np.maximum(s0, 1e-300)[:, None], c), steps + 1
            kern = self.kernel(x, c)
            d = 1 - kern
            new = ratio(np.where(d == 0, np.finfo(float).eps, d), 1 / (self.m - 1))
            moved, u = np.abs(new - u).max(), new
            if moved < self.epsilon:
                break
        return self.model(p, lambda ids, x: self.u(x, c), self.k, centers=c, n_iter=steps)


def _largest_move(p: Points, a, b) -> float:
    """Largest change of a membership; a maximum, so it goes by the row of largest change and not by sums."""
    ids, x = p.first(lambda ids, x: -np.abs(b(ids, x) - a(ids, x)).max(1), 1)
    return float(np.abs(b(ids, x) - a(ids, x)).max())


@register
class RoughKMeans(Estimator):
    """Rough k-means: points near several centres are in the upper approximation of each. extras: lower, upper (id, k, u)."""

    PARAMS = {"k": 2, "weight_lower": 0.7, "threshold": 1.2, "max_iter": 100, "tol": 1e-4, "init": None, "seed": 0}

    def check(self):
        super().check()
        if not 0 <= self.weight_lower <= 1 or self.threshold < 1:
            raise ValueError("weight_lower must be in [0, 1] and threshold at least 1")

    def sets(self, x, c):
        """(lower, upper) as 0 and 1."""
        d = dist(x, c)
        upper = d <= self.threshold * np.maximum(d.min(1, keepdims=True), TINY)
        upper |= np.eye(len(c), dtype=bool)[d.argmin(1)]
        one = upper.sum(1, keepdims=True) == 1
        return (upper & one).astype(float), upper.astype(float)

    def u(self, x, c):
        upper = self.sets(x, c)[1]
        return upper / upper.sum(1, keepdims=True)

    def fit(self, df, *_):
        p = self.points(df)
        c, steps, gave = self.start(p), 0, None
        for _ in range(self.max_iter):

            def step(ids, x, c=c):
                lower, upper = self.sets(x, c)
                return (*moments(lower, x), *moments(upper - lower, x))

            n, s, nf, sf = p.reduce(step)
            low, fringe = s / np.maximum(n, 1)[:, None], sf / np.maximum(nf, 1)[:, None]
            both = self.weight_lower * low + (1 - self.weight_lower) * fringe
            new = np.where(((n > 0) & (nf > 0))[:, None], both, np.where((n > 0)[:, None], low, np.where((nf > 0)[:, None], fringe, c)))
            moved, gave, c, steps = np.linalg.norm(new - c), c, new, steps + 1
            if moved < self.tol:
                break
        sets = {name: lambda i=i: p.assign(lambda ids, x: self.sets(x, gave)[i]) for i, name in enumerate(("lower", "upper"))}
        return self.model(p, lambda ids, x: self.u(x, gave), self.k, centers=c, n_iter=steps, extras=Extras({}, sets))


@register
class RPFKM(Estimator):
    """Robust projected fuzzy k-means: memberships in a d-dimensional projection learned along. extras: projection, means."""

    PARAMS = {"k": 3, "d": 2, "gamma": 0.1, "beta": 1.0, "max_iter": 50, "seed": 0, "init": None}

    def fit(self, df, *_):
        p = self.points(df)
        w = np.linalg.qr(np.random.default_rng(self.seed).standard_normal((p.d, self.d)))[0]
        if self.init is not None:  # (projection, centres among the points)
            w, start = (np.array(a, float) for a in self.init)
        n, s, outer = p.reduce(lambda ids, x: (len(x), x.sum(0), x.T @ x))
        total = outer - np.outer(s, s) / n
        u0 = lambda ids, x: dirichlet(ids, self.k, self.seed)
        if self.init is not None:
            u0 = lambda ids, x, w=w: softmax(-dist(x @ w, start @ w) / (2 * self.gamma))
        weight = u0
        now = u0
        means = None
        for _ in range(self.max_iter):
            s0, s1 = p.reduce(lambda ids, x, w=w, weight=weight: moments(weight(ids, x), x @ w))
            means = s1 / (s0[:, None] + 1e-10)

            def u(ids, x, w=w, means=means):
                return softmax(-dist(x @ w, means) / (2 * self.gamma))

            def pu(ids, x, w=w, means=means):
                d = dist(x @ w, means)
                return softmax(-d / (2 * self.gamma)) / (2 * (d + 1e-8))

            def scatter(ids, x, pu=pu):
                q = pu(ids, x)
                return (*moments(q, x), (x * q.sum(1)[:, None]).T @ x)

            s0, s1, xx = p.reduce(scatter)
            within = xx - (s1 / s0[:, None]).T @ s1
            now, weight = u, pu
            w = np.linalg.eigh(self.beta * total - within)[1][:, -self.d :]
        return self.model(p, now, self.k, n_iter=self.max_iter, extras={"projection": w, "means": means})


@register
class SFCMEP(Estimator):
    """Semi-supervised fuzzy clustering with prior memberships; input has a nullable column `label` besides the features. extras: prior.

    A step multiplies each membership, or 1 if it is near 0, by exp(-d2 / lam). Memberships are thus a state of the points: they follow from
    those last stored and the centres since then, and are stored again every REPLAY steps.
    """

    PARAMS = {"k": 3, "rho": 0.5, "lam": 1.0, "max_iter": 200, "tol": 1e-6, "seed": 0, "reset_share": 0.125}
    REPLAY = 8
    NEAR_ZERO = 1e-8  # fixed value

    def moved(self, u: np.ndarray, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The memberships after a step to centres c."""
        d = dist(x, c) ** 2
        if self.lam == 0:
            return np.eye(len(c))[d.argmin(1)]
        w = np.exp((d.min(1, keepdims=True) - d) / self.lam) * np.where(np.abs(u) <= self.NEAR_ZERO, 1.0, u)
        return w / (w.sum(1, keepdims=True) + 1e-12)

    def fit(self, df, *_):
        p = Points(df, ("label",)) if not isinstance(df, Points) else df
        k, eye = self.k, np.eye(self.k)
        lab = lambda y: np.where(np.isnan(y := np.asarray(y, float)), -1, y).astype(int)
        hot = lambda y: np.vstack([eye, np.zeros((1, k))])[lab(y)]
        n, s = p.reduce(lambda ids, x, y: moments(hot(y), x))
        c0 = s / np.maximum(n, 1)[:, None]
        if (n == 0).any():
            c0 = np.where((n > 0)[:, None], c0, random_rows(_plain(p), k, self.seed))

        def raw(x, y):
            d = np.maximum(dist(x, c0), TINY)
            v = d.min(1, keepdims=True) / d
            return np.minimum(np.where(hot(y) > 0, 1e-6 + self.rho * v, (1 - self.rho) * v), 1.0)

        def extremes(ids, x, y):
            r, on = raw(x, y), (lab(y) >= 0).astype(float)
            return on.sum(), (r.max(1) * on).sum(), (r.min(1) * on).sum()

        labelled, hi, lo = p.reduce(extremes)
        hat = 0.5 * (hi / labelled + 1 - (k - 1) * lo / labelled) if labelled else 1 / k
        chance = lambda ids: uniform(ids, 1, self.seed + 17)[:, 0]
        many = max(1, int(labelled * self.reset_share)) if labelled and self.reset_share > 0 else 0
        below = least_of(p, lambda ids, x, y: chance(ids)[lab(y) >= 0], many)

        def prior(ids, x, y):
            r, on = raw(x, y), lab(y) >= 0
            u = np.where(on[:, None], r, hat)
            reset = on & (chance(ids) <= below)
            return np.where(reset[:, None] & (np.arange(k)[None, :] != u.argmax(1)[:, None]), hat, u)

        kept, since = p.attach(lambda ids, x, y: self.moved(prior(ids, x, y), x, c0)), []

        def now(x, state, since):
            for c in since:
                state = self.moved(state, x, c)
            return state

        s0, s1 = kept.reduce(lambda ids, x, y, u: moments(u, x))
        c, steps = c0, 0
        for steps in range(1, self.max_iter + 1):
            new = s1 / (s0[:, None] + 1e-8)

            def step(ids, x, y, state, since=tuple(since), new=new):
                u = now(x, state, since)
                v = self.moved(u, x, new)
                return (((v - u) ** 2).sum(), *moments(v, x))

            change, s0, s1 = kept.reduce(step)
            since.append(new)
            still = np.sqrt(change) <= self.tol and np.linalg.norm(new - c) <= self.tol
            c = new
            if still:
                break
            if len(since) >= (1 if p.local is not None else self.REPLAY):
                at = tuple(since)
                before, kept, since = kept, kept.attach(lambda ids, x, y, state: now(x, state, at), replace=True), []
                forget(before.df)
        at = tuple(since)
        return self.model(kept, lambda ids, x, y, state: now(x, state, at), k, centers=c, n_iter=steps, extras=Extras({}, {"prior": lambda: p.assign(prior)}))


def least_of(p: Points, fn, m: int) -> float:
    """The m-th least of the numbers in (0, 1) that fn gives for a block; 0 if m is 0. By counts in ever finer bins."""
    if m == 0:
        return 0.0
    lo, width, bins = 0.0, 1.0, 4096
    for _ in range(5):
        count = p.reduce(lambda *a, lo=lo, width=width: (np.histogram(fn(*a), bins, (lo, lo + width))[0],))[0]
        at = int(np.searchsorted(np.cumsum(count), m))
        m -= int(count[:at].sum())
        lo, width = lo + at * width / bins, width / bins
        if count[at] == m:
            break
    return lo + width


def _plain(p: Points) -> Points:
    """The same points without further columns."""
    q = Points.__new__(Points)
    q.spark, q.n, q.d, q.df = p.spark, p.n, p.d, p.df.select("id", "features")
    q.local = None if p.local is None else (*p.local[:2], [])
    return q


__all__ = ["FCM", "PCM", "PFCM", "CAFCM", "CAFHFCM", "AFCMSimple", "ENTROPYFCM", "ECM", "FCC", "KFCM", "RoughKMeans", "RPFKM", "SFCMEP", "kmeanspp"]
