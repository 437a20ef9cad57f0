"""Metric trees by the anchors hierarchy, and nearest-entry passes over them.

Anchors are pivots that own the points nearest to them: the farthest point of the widest anchor becomes the next
one, and takes only points at least half as far from their owner as the two pivots are apart. Anchors are merged
pairwise up to one root, and each is divided the same way downwards. Every ball keeps the sum and the
number of its points, so a ball that one entry wholly owns is counted without looking at its points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Points that a ball is no longer divided below.
LEAF = 24
#: Relative margin of the test that drops an entry; far above the error of the doubles in it.
MARGIN = 1e-9


@dataclass
class BallTree:
    """Balls in arrays: a ball's points are ``order[low:high]``; ``first`` and ``second`` are its children or -1."""

    order: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    second: np.ndarray
    pivot: np.ndarray
    radius: np.ndarray
    total: np.ndarray


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` to the point ``b``."""
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def _anchors(points: np.ndarray) -> list[np.ndarray]:
    """Positions of the points of each anchor; about as many anchors as points in one, a single one if all are equal."""
    n = len(points)
    owner = np.zeros(n, np.int64)
    away = np.sqrt(_squares(points, points[0]).astype(float))
    pivots = [points[0]]
    for new in range(1, int(np.sqrt(n)) + 1):
        far = int(away.argmax())  # the farthest point of the widest anchor
        if away[far] == 0:
            break
        apart = np.sqrt(_squares(np.asarray(pivots), points[far]).astype(float))
        near = np.flatnonzero(away >= apart[owner] / 2)
        closer = np.sqrt(_squares(points[near], points[far]).astype(float))
        taken = closer < away[near]
        owner[near[taken]], away[near[taken]] = new, closer[taken]
        pivots.append(points[far])
    groups = np.argsort(owner, kind="stable")
    return [g for g in np.split(groups, np.flatnonzero(np.diff(owner[groups])) + 1) if len(g)]


def build(points: np.ndarray, leaf: int = LEAF) -> BallTree:
    """The tree over integer points (n, dimensions), n at least 1."""
    nodes: list[tuple] = []  # (first, second, positions of a leaf or None)

    def leaf_ball(at: np.ndarray) -> int:
        nodes.append((-1, -1, at))
        return len(nodes) - 1

    def grow(at: np.ndarray) -> int:
        if len(at) <= leaf:
            return leaf_ball(at)
        groups = _anchors(points[at])
        if len(groups) == 1:
            return leaf_ball(at)
        balls = [grow(at[g]) for g in groups]
        centre = np.array([points[at[g]].mean(axis=0) for g in groups])
        size = np.array([float(len(g)) for g in groups])
        radius = np.array([np.sqrt(_squares(points[at[g]], c).max()) for g, c in zip(groups, centre)])
        # merge the two anchors with the smallest ball around both, until one is left
        cost = np.sqrt(((centre[:, None] - centre) ** 2).sum(axis=2)) + radius[:, None] + radius
        np.fill_diagonal(cost, np.inf)
        for _ in range(len(balls) - 1):
            i, j = divmod(int(cost.argmin()), len(cost))
            nodes.append((balls[i], balls[j], None))
            balls[i] = len(nodes) - 1
            radius[i] = cost[i, j] / 2
            centre[i] = (centre[i] * size[i] + centre[j] * size[j]) / (size[i] + size[j])
            size[i] += size[j]
            cost[j], cost[:, j], size[j] = np.inf, np.inf, 0
            others = np.flatnonzero(size > 0)
            others = others[others != i]
            cost[i, others] = cost[others, i] = np.sqrt(((centre[others] - centre[i]) ** 2).sum(axis=1)) + radius[others] + radius[i]
        return next(b for b, s in zip(balls, size) if s > 0)

    root = grow(np.arange(len(points)))
    return _laid_out(points, nodes, root)


def _laid_out(points: np.ndarray, nodes: list[tuple], root: int) -> BallTree:
    """Numbers the balls from the root on and gives each a range of points, with its sum, pivot and radius."""
    count = len(nodes)
    number, stack, sequence = {}, [root], []
    while stack:
        k = stack.pop()
        number[k] = len(sequence)
        sequence.append(k)
        if nodes[k][2] is None:
            stack += [nodes[k][1], nodes[k][0]]
    order = np.concatenate([nodes[k][2] for k in sequence if nodes[k][2] is not None])
    first, second = np.full(count, -1), np.full(count, -1)
    low, high = np.zeros(count, np.int64), np.zeros(count, np.int64)
    at = 0
    for k in sequence:
        if nodes[k][2] is not None:
            low[number[k]], at = at, at + len(nodes[k][2])
            high[number[k]] = at
    for k in reversed(sequence):
        if nodes[k][2] is None:
            a, b, me = number[nodes[k][0]], number[nodes[k][1]], number[k]
            first[me], second[me], low[me], high[me] = a, b, min(low[a], low[b]), max(high[a], high[b])
    placed = points[order]
    running = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(placed, axis=0)])
    total = running[high] - running[low]
    pivot = total // (high - low)[:, None]
    radius = np.array([_squares(placed[a:b], p).max() for a, b, p in zip(low, high, pivot)], np.int64)
    return BallTree(order, low, high, first, second, pivot, radius, total)


def nearest(tree: BallTree, points: np.ndarray, entries: np.ndarray):
    """Yields (entry, balls) for whole balls and (entry per point, None, positions) for single points.

    A list of candidate entries goes down with each ball. An entry goes when another is nearer to
    every point of the ball: with the pivot p, the radius r and the best candidate b, entry c is farther throughout if
    |p-c|^2 - |p-b|^2 > 2 r |c-b|. Ties never drop an entry, except that of equal entries the first stays.
    """
    k = len(entries)
    gaps = np.sqrt(((entries[:, None] - entries) ** 2).sum(axis=2).astype(float))
    once = np.array([not (entries[:i] == entries[i]).all(axis=1).any() for i in range(k)])
    far = np.iinfo(np.int64).max
    balls, open_to = np.zeros(1, np.int64), once[None, :]
    while len(balls):
        pivots = tree.pivot[balls]
        away = ((pivots[:, None] - entries) ** 2).sum(axis=2)
        best = np.where(open_to, away, far).argmin(axis=1)
        reach = 2 * np.sqrt(tree.radius[balls].astype(float))[:, None] * gaps[best]
        lead = (away - away[np.arange(len(balls)), best][:, None]).astype(float)
        open_to = open_to & ~(lead > reach * (1 + MARGIN))
        owned = open_to.sum(axis=1) == 1
        if owned.any():
            yield best[owned], balls[owned], None
        leaf = ~owned & (tree.first[balls] < 0)
        if leaf.any():
            sizes = (tree.high - tree.low)[balls[leaf]]
            starts = np.repeat(tree.low[balls[leaf]] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
            at = tree.order[np.arange(len(starts)) + starts]
            own = ((points[at][:, None] - entries) ** 2).sum(axis=2)
            yield np.where(np.repeat(open_to[leaf], sizes, axis=0), own, far).argmin(axis=1), None, at
        inner = ~owned & ~leaf
        balls = np.concatenate([tree.first[balls[inner]], tree.second[balls[inner]]])
        open_to = np.concatenate([open_to[inner], open_to[inner]])


def sums(tree: BallTree, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the points nearest to each entry."""
    total, count = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    for entry, balls, at in nearest(tree, points, entries):
        np.add.at(total, entry, points[at] if balls is None else tree.total[balls])
        np.add.at(count, entry, 1 if balls is None else tree.high[balls] - tree.low[balls])
    return total, count


def labels(tree: BallTree, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of each point, the first of equally near ones."""
    out = np.empty(len(points), np.int64)
    for entry, balls, at in nearest(tree, points, entries):
        if balls is None:
            out[at] = entry
        else:
            for e, b in zip(entry, balls):
                out[tree.order[tree.low[b]:tree.high[b]]] = e
    return out
