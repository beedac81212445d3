"""Small optimisers: Adam and limited-memory BFGS."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Adam:
    def __init__(self, lr: float, weight_decay: float = 0.0):
        self.lr, self.decay, self.t, self.m, self.v = lr, weight_decay, 0, {}, {}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        """Moves params in place."""
        self.t += 1
        for k, g in grads.items():
            g = g + self.decay * params[k]
            self.m[k] = 0.9 * self.m.get(k, 0.0) + 0.1 * g
            self.v[k] = 0.999 * self.v.get(k, 0.0) + 0.001 * g * g
            params[k] -= self.lr * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, max_iter: int = 200, ftol: float = 1e-6, memory: int = 10) -> tuple[np.ndarray, float, int]:
    """(minimiser, value, steps) by two-loop recursion with a backtracking line search that asks for sufficient decrease."""
    fx, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for it in range(max_iter):
        q, al = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (y @ s)
            al.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(al)):
            q += s * (a - (y @ q) / (y @ s))
        slope = -(g @ q)
        if slope >= 0:
            q, slope, pairs = g.copy(), -(g @ g), []
        t = 1.0 if pairs else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-12))
        while True:
            new = x - t * q
            fn, gn = f(new)
            if fn <= fx + 1e-4 * t * slope or t < 1e-14:
                break
            t *= 0.5
        s, y = new - x, gn - g
        if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
            pairs = [*pairs[1 - memory :], (s, y)] if len(pairs) >= memory else [*pairs, (s, y)]
        gain, x, fx, g = fx - fn, new, fn, gn
        if gain <= ftol * max(abs(fx), abs(fx + gain), 1.0) or np.abs(g).max() < 1e-8:
            return x, fx, it + 1
    return x, fx, max_iter
