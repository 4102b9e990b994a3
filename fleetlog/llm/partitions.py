"""Learned partitions: balanced cells of a neighbour graph and a small classifier that names them.

Fitted on a bounded sample of vectors (numpy only): its graph of nearest neighbours is cut into cells of equal size by
recursive bisection, and a classifier with one hidden layer learns how a vector's neighbours spread over the cells.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: neighbours of a sampled vector in the graph
NEIGHBOURS = 12
HIDDEN, EPOCHS, MINI, RATE = 96, 40, 256, 3e-3
#: one sampled vector in so many is kept from the fit to calibrate the routing
HELD_OUT = 5


def graph(x: np.ndarray, k: int, rows: int = 512) -> np.ndarray:
    """Places of the k nearest other rows of each row (fewer rows: all others), block by block."""
    k = min(k, len(x) - 1)
    half = (x * x).sum(axis=1) / 2
    out = np.empty((len(x), k), dtype=np.int64)
    for lo in range(0, len(x), rows):
        near = half - x[lo : lo + rows] @ x.T
        near[np.arange(len(near)), np.arange(lo, lo + len(near))] = np.inf
        out[lo : lo + rows] = np.argpartition(near, k - 1, axis=1)[:, :k] if k else 0
    return out


def _halves(n: int, a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Two halves of equal size (up to one) with few edges between them: smooth a vector over the edges, cut at its median, swap."""
    degree = np.maximum(np.bincount(a, minlength=n) + np.bincount(b, minlength=n), 1)
    v = start - start.mean()
    for _ in range(60):
        v = 0.5 * v + 0.5 * (np.bincount(a, weights=v[b], minlength=n) + np.bincount(b, weights=v[a], minlength=n)) / degree
        v -= np.average(v, weights=degree)
        v /= max(np.abs(v).max(), 1e-300)
    side = np.zeros(n, dtype=bool)
    side[np.argsort(v, kind="stable")[n // 2 :]] = True
    for _ in range(8):  # swap the nodes that gain most, as many from either side
        sign = np.where(side, 1.0, -1.0)
        pull = np.bincount(a, weights=sign[b], minlength=n) + np.bincount(b, weights=sign[a], minlength=n)
        gain = -sign * pull
        left, right = np.flatnonzero(~side), np.flatnonzero(side)
        left, right = left[np.argsort(-gain[left], kind="stable")], right[np.argsort(-gain[right], kind="stable")]
        m = min(len(left), len(right))
        swaps = int(((gain[left[:m]] + gain[right[:m]]) > 2).sum()) // 2  # half of them: neighbours move together
        if not swaps:
            break
        side[left[:swaps]], side[right[:swaps]] = True, False
    return side


def cells(x: np.ndarray, near: np.ndarray, n_cells: int) -> np.ndarray:
    """Cell of each row: ``n_cells`` (a power of two) cells of equal size, cut out of the neighbour graph."""
    out = np.zeros(len(x), dtype=np.int64)
    a, b = np.repeat(np.arange(len(x)), near.shape[1]), near.ravel()
    parts, rng = 1, np.random.Generator(np.random.PCG64(5))
    while parts < n_cells:
        new = out * 2
        for p in range(parts):
            own = np.flatnonzero(out == p)
            if len(own) < 2:
                continue
            place = np.full(len(x), -1)
            place[own] = np.arange(len(own))
            inside = (place[a] >= 0) & (place[b] >= 0)
            start = (x[own] - x[own].mean(axis=0)) @ rng.standard_normal(x.shape[1])
            new[own] += _halves(len(own), place[a[inside]], place[b[inside]], start)
        out, parts = new, parts * 2
    return out


@dataclass
class Router:
    """Centre, weights of both layers, and the share of probability that a query's cells must reach."""

    centre: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mass: float = 1.0

    def spread(self, x: np.ndarray) -> np.ndarray:
        """Probability of each cell for each row. Direction only: a vector of any length can be routed."""
        z = np.maximum(scaled(x, self.centre) @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def cell(self, x: np.ndarray) -> np.ndarray:
        """The most probable cell of each row."""
        return self.spread(x).argmax(axis=1)

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells of each row by falling probability, and how many of them reach the share."""
        p = self.spread(x)
        order = np.argsort(-p, axis=1, kind="stable")
        total = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1)
        return order, np.minimum((total < self.mass).sum(axis=1) + 1, p.shape[1])


def scaled(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    y = x - centre
    return y / np.maximum(np.sqrt((y * y).mean(axis=1, keepdims=True)), 1e-150)


def fit(x: np.ndarray, n_cells: int, recall: float, k: int = 10) -> Router:
    """A router over ``n_cells`` cells, calibrated to find ``recall`` of the k nearest among sampled rows it was not fitted on."""
    centre = x.mean(axis=0)
    n, dims = len(x), x.shape[1]
    held = np.arange(n) % HELD_OUT == 0
    near = graph(x, NEIGHBOURS)
    rng = np.random.Generator(np.random.PCG64(9))
    w = [rng.standard_normal((dims, HIDDEN)) * np.sqrt(2 / dims), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, n_cells)) * np.sqrt(1 / HIDDEN), np.zeros(n_cells)]
    if n_cells > 1 and n > 1:
        own = cells(x, near, n_cells)
        target = np.zeros((n, n_cells))
        np.add.at(target, (np.repeat(np.arange(n), near.shape[1]), own[near].ravel()), 1.0 / near.shape[1])
        np.add.at(target, (np.arange(n), own), 1.0)
        target /= target.sum(axis=1, keepdims=True)
        _teach(w, scaled(x, centre)[~held], target[~held], rng)
    router = Router(centre, *w)
    if not held.any() or n <= k + 1:
        return router
    # how much probability must be asked for: by the nearest of held-out rows among all sampled rows
    place, truth = router.cell(x), graph(x, k)[held]
    p = router.spread(x[held])
    order = np.argsort(-p, axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n_cells)[None, :], axis=1)
    before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
    needed = np.take_along_axis(before, np.take_along_axis(rank, place[truth], axis=1), axis=1).ravel()  # found once the share exceeds this
    router.mass = float(min(np.quantile(needed, recall, method="higher") + 1e-9, 1.0))
    return router


def _teach(w: list[np.ndarray], x: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> None:
    """Adam on the cross entropy, in place."""
    first, second, t = [np.zeros_like(v) for v in w], [np.zeros_like(v) for v in w], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        rate = RATE * (1 - epoch / EPOCHS)
        for lo in range(0, len(x), MINI):
            xs, ys = x[order[lo : lo + MINI]], target[order[lo : lo + MINI]]
            h = np.maximum(xs @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = (z / z.sum(axis=1, keepdims=True) - ys) / len(xs)
            back = (d @ w[2].T) * (h > 0)
            grads = (xs.T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ d + 1e-4 * w[2], d.sum(axis=0))
            t += 1
            for v, g, m, s in zip(w, grads, first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
