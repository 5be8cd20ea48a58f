"""Metric trees by the anchors hierarchy, for sets of integer vectors of a few dimensions.

About sqrt(n) anchors are chosen, each the point farthest from the anchor that owns it; a new anchor takes the points that are
nearer to it, and only points at least half as far from their anchor as the two anchors are apart have to be looked at.  From
this middle the tree is built up by joining the two balls whose common ball is smallest, and down by doing the same inside
each anchor.  Every ball keeps its pivot, radius, count and sum of points, so a ball whose points all belong to one entry
of a codebook is added to that entry without a look at its points.

Distances are compared as squares.  Those of points are exact integers; bounds of balls carry a margin for rounding, so that what they
decide is right.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = 48
MARGIN = 1e-9


@dataclass
class Balls:
    """A tree over points in the order ``order``; ball k has the points begin[k]:end[k] of it, whose sum is total[k], and the balls left[k] and right[k] (-1: none)."""

    order: np.ndarray
    pivot: np.ndarray
    radius: np.ndarray
    total: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    left: np.ndarray
    right: np.ndarray


def anchors(points: np.ndarray, among: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """(pivot, members, radius) of about sqrt(n) anchors over the points with the numbers ``among``."""
    own = points[among].astype(np.float64)
    wanted = max(2, int(np.sqrt(len(among))))
    pivots = [own[0]]
    owner = np.zeros(len(among), np.int64)
    away = np.sqrt(((own - pivots[0]) ** 2).sum(1))
    while len(pivots) < wanted:
        far = int(away.argmax())
        if away[far] == 0:
            break
        new = own[far]
        apart = np.sqrt(((np.array(pivots) - new) ** 2).sum(1))
        near = np.flatnonzero(away >= apart[owner] / 2 * (1 - MARGIN))
        to = np.sqrt(((own[near] - new) ** 2).sum(1))
        taken = to < away[near]
        owner[near[taken]], away[near[taken]] = len(pivots), to[taken]
        pivots.append(new)
    by = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[by], np.arange(len(pivots) + 1))
    return [(pivots[k], among[by[cuts[k] : cuts[k + 1]]], float(away[by[cuts[k] : cuts[k + 1]]].max())) for k in range(len(pivots)) if cuts[k] < cuts[k + 1]]


def common(pivot: np.ndarray, radius: np.ndarray, one: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """(radius, share) of the smallest balls around each of some balls and one more; the center is pivot + share * (one - pivot)."""
    apart = np.sqrt(((pivot - one) ** 2).sum(-1))
    joint = np.maximum(np.maximum(radius, size), (apart + radius + size) / 2)
    return joint, np.clip((joint - radius) / np.where(apart > 0, apart, 1), 0, 1)


class Builder:
    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.nodes: list[list] = []  # pivot, radius, left, right, members of a leaf

    def node(self, *what) -> int:
        self.nodes.append(list(what))
        return len(self.nodes) - 1

    def ball(self, among: np.ndarray, pivot: np.ndarray, radius: float) -> int:
        """The tree of some points that lie in the ball."""
        if len(among) <= LEAF or radius == 0:
            return self.node(pivot, radius, -1, -1, among)
        found = anchors(self.points, among)
        if len(found) == 1:
            return self.node(found[0][0], found[0][2], -1, -1, among)
        roots = [self.ball(members, p, r) for p, members, r in found]
        return self.joined(roots)

    def joined(self, roots: list[int]) -> int:
        """Join the two balls with the smallest common ball, again and again."""
        alive = np.ones(len(roots), bool)
        pivot = np.array([self.nodes[k][0] for k in roots], np.float64)
        radius = np.array([self.nodes[k][1] for k in roots])
        cost = np.full((len(roots), len(roots)), np.inf)
        for k in range(1, len(roots)):
            cost[k, :k] = cost[:k, k] = common(pivot[:k], radius[:k], pivot[k], radius[k])[0]
        for _ in range(len(roots) - 1):
            a, b = divmod(int(cost.argmin()), len(roots))
            size, share = common(pivot[a], radius[a], pivot[b], radius[b])
            center = pivot[a] + share * (pivot[b] - pivot[a])
            size = float(size) * (1 + MARGIN) + MARGIN
            roots[a] = self.node(center, size, roots[a], roots[b], None)
            pivot[a], radius[a], alive[b] = center, size, False
            cost[b] = cost[:, b] = np.inf
            rest = np.flatnonzero(alive)
            rest = rest[rest != a]
            cost[a, rest] = cost[rest, a] = common(pivot[rest], radius[rest], center, size)[0]
        return roots[int(np.flatnonzero(alive)[0])]


def build(points: np.ndarray) -> Balls:
    """The tree of all points, ball 0 first; each ball comes before the balls in it."""
    made = Builder(points)
    root = made.ball(np.arange(len(points)), points[0].astype(np.float64), np.inf) if len(points) > LEAF else made.node(*whole(points), -1, -1, np.arange(len(points)))
    order, kept, stack = [], [], [(root, -1, 0)]
    at = 0
    while stack:
        node, above, side = stack.pop()
        pivot, radius, a, b, members = made.nodes[node]
        k = len(kept)
        kept.append([pivot, radius, at, at, -1, -1])
        if above >= 0:
            kept[above][4 + side] = k
        if members is not None:
            order.append(members)
            at += len(members)
            kept[k][3] = at
        else:
            stack += [(b, k, 1), (a, k, 0)]
    for k in range(len(kept) - 1, -1, -1):
        if kept[k][5] >= 0:
            kept[k][3] = kept[kept[k][5]][3]
    pivot, radius, *places = zip(*kept, strict=True)
    begin, end, left, right = (np.array(c, np.int32) for c in places)
    order = np.concatenate(order)
    upto = np.zeros((len(points) + 1, points.shape[1]), np.int64)
    np.cumsum(points[order], axis=0, out=upto[1:])
    return Balls(order, np.array(pivot, np.float64), np.array(radius, np.float64), upto[end] - upto[begin], begin, end, left, right)


def whole(points: np.ndarray) -> tuple[np.ndarray, float]:
    center = points.mean(0)
    return center, float(np.sqrt(((points - center) ** 2).sum(1).max())) * (1 + MARGIN) + MARGIN


def shares(balls: Balls, points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(ball or ~point, entry) pairs that cover the points: balls owned whole, and points of leaves one by one; and how many distances that took.

    Each ball takes over the entries that its parent could not rule out.  Entry b is ruled out by a if every point of the ball is nearer to
    a: the difference of the squared distances is linear in the point, so it is least on the side of b, |c-b|^2 - |c-a|^2 - 2 r |a-b|.
    """
    exact = entries.astype(np.float64)
    apart = np.sqrt(((exact[:, None] - exact[None]) ** 2).sum(2))
    at, allowed = np.zeros(1, np.int64), np.ones((1, len(entries)), bool)
    covered: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    leaves: list[np.ndarray] = []
    left_over: list[np.ndarray] = []
    looked = 0
    while len(at):
        away = ((balls.pivot[at][:, None] - exact[None]) ** 2).sum(2)
        looked += int(allowed.sum())
        away = np.where(allowed, away, np.inf)
        best = away.argmin(1)
        nearest = away[np.arange(len(at)), best]
        slack = 2 * balls.radius[at][:, None] * apart[best] + MARGIN * (away + nearest[:, None]) + MARGIN
        allowed &= ~(away - nearest[:, None] > slack)
        one = allowed.sum(1) == 1
        covered.append(at[one])
        owner.append(allowed[one].argmax(1))
        at, allowed = at[~one], allowed[~one]
        leaf = balls.left[at] < 0
        leaves.append(at[leaf])
        left_over.append(allowed[leaf])
        inner = ~leaf
        at, allowed = np.concatenate([balls.left[at[inner]], balls.right[at[inner]]]).astype(np.int64), np.concatenate([allowed[inner], allowed[inner]])
    ball, entry = np.concatenate(covered), np.concatenate(owner)
    leaf, options = np.concatenate(leaves), np.concatenate(left_over)
    if not len(leaf):
        return ball, entry, looked
    sizes = (balls.end - balls.begin)[leaf]
    row = np.repeat(np.arange(len(leaf)), sizes)
    point = balls.order[np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(balls.begin[leaf], sizes)]
    looked += int(options.sum(1) @ sizes)
    best = np.empty(len(point), np.int64)
    for a in range(0, len(point), 1 << 14):
        some = slice(a, a + (1 << 14))
        gap = ((points[point[some]][:, None] - entries[None]) ** 2).sum(2)
        best[some] = np.where(options[row[some]], gap, np.iinfo(np.int64).max).argmin(1)
    return np.concatenate([ball, ~point]), np.concatenate([entry, best]), looked
