"""Assignment problems of small dense matrices."""

from __future__ import annotations

import numpy as np


def min_cost_assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least total cost; min(rows, columns) of them. Shortest augmenting paths, O(n^3)."""
    c = np.asarray(cost, float)
    if c.size == 0:
        return []
    if c.shape[0] > c.shape[1]:
        return sorted((i, j) for j, i in min_cost_assignment(c.T))
    n, m = c.shape
    u, v, owner = np.zeros(n), np.zeros(m + 1), np.full(m + 1, -1)
    for i in range(n):
        dist, back, done = np.full(m, np.inf), np.full(m, m), np.zeros(m, bool)
        owner[m], j = i, m
        while owner[j] >= 0:
            if j < m:
                done[j] = True
            r = owner[j]
            step = c[r] - u[r] - v[:m] + (0.0 if j == m else dist[j])
            better = ~done & (step < dist)
            dist[better], back[better] = step[better], j
            j = int(np.argmin(np.where(done, np.inf, dist)))
        end = dist[j]
        for q in np.flatnonzero(done):
            u[owner[q]] += end - dist[q]
            v[q] -= end - dist[q]
        u[i] += end
        while j != m:
            owner[j] = owner[back[j]]
            j = back[j]
        owner[m] = -1
    return sorted((int(owner[j]), j) for j in range(m) if owner[j] >= 0)


def max_weight_matching(weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of largest total weight; pairs of no weight are left out."""
    return [(i, j) for i, j in min_cost_assignment(-np.asarray(weight, float)) if weight[i][j] > 0]
