"""Shortest open walks over bed sets: exact for few beds, a proven lower bound for more."""

from __future__ import annotations

import numpy as np

#: Sets up to this size are solved exactly, up to the second a bound is offered, beyond it none.
EXACT_LIMIT, BOUND_LIMIT = 12, 256
ITERATIONS = 120


class BoundUnavailable(ValueError):
    """More beds than any bound covers."""


def open_walk(d: np.ndarray) -> float:
    """Length of the shortest walk through all points, ends free: subset programming over last points."""
    n = len(d)
    if n < 2:
        return 0.0
    best = np.full((1 << n, n), np.inf)
    best[1 << np.arange(n), np.arange(n)] = 0.0
    masks = np.arange(1 << n)
    size = (masks[:, None] >> np.arange(n) & 1).sum(1)
    for k in range(1, n):  # all sets of k points at once
        layer = masks[size == k]
        onward = (best[layer][:, :, None] + d[None, :, :]).min(1)
        for j in range(n):
            open_ = layer >> j & 1 == 0
            best[layer[open_] | 1 << j, j] = onward[open_, j]
    return float(best[-1].min())


def spanning_tree(d: np.ndarray) -> tuple[float, np.ndarray]:
    """Weight and degrees of a minimum spanning tree, grown from point 0, ties by the lower index."""
    n = len(d)
    degrees, weight = np.zeros(n, dtype=np.int64), 0.0
    near, parent, out = d[0].copy(), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    out[0] = False
    while out.any():
        i = int(np.argmin(np.where(out, near, np.inf)))
        weight += near[i]
        degrees[i] += 1
        degrees[parent[i]] += 1
        out[i] = False
        closer = out & (d[i] < near)
        near[closer], parent[closer] = d[i][closer], i
    return float(weight), degrees


def one_tree_bound(d: np.ndarray, iterations: int = ITERATIONS) -> float:
    """Lower bound of the shortest open walk: ascent on node prices of 1-trees.

    A point at distance 0 of all others turns walks into tours. Every step's value is a bound, so
    the best one is returned; a nearest-neighbour tour only sets the step length.
    """
    n = len(d) + 1
    if n < 3:
        return 0.0
    c = np.zeros((n, n))
    c[:-1, :-1] = d
    tour, at, left = 0.0, 0, set(range(1, n))
    while left:
        nxt = min(left, key=lambda k: (c[at, k], k))
        tour, at = tour + c[at, nxt], nxt
        left.discard(nxt)
    tour += c[at, 0]
    price, best = np.zeros(n), 0.0
    for t in range(iterations):
        priced = c + price[:, None] + price[None, :]
        weight, degrees = spanning_tree(priced[1:, 1:])
        two = np.argsort(priced[0, 1:], kind="stable")[:2]
        weight += priced[0, 1:][two].sum()
        degree = np.concatenate([[2], degrees])
        degree[1 + two] += 1
        bound = weight - 2 * price.sum()
        best = max(best, bound)
        off = degree - 2
        norm = float((off * off).sum())
        step = 2.0 * 0.95**t * max(tour - bound, 0.0) / norm if norm else 0.0
        if not step:
            break
        price = price + step * off
    return float(best)


def necessary(d: np.ndarray) -> tuple[float, str]:
    """Metres that any walk over these points needs, and how they were found."""
    n = len(d)
    if n < 2:
        return 0.0, "none"
    if n <= EXACT_LIMIT:
        return open_walk(d), "exact"
    if n <= BOUND_LIMIT:
        return max(spanning_tree(d)[0], one_tree_bound(d)), "bound"
    raise BoundUnavailable(f"{n} beds; no bound above {BOUND_LIMIT}")
