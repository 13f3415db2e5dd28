"""Cover trees of integer points, and their assignment to a codebook by whole subtrees.

A tree is made level by level: the points of a node fall to children whose centres, points
themselves, are farther apart than half the node's radius, each point to the first centre within
that. Nodes of few points, or of equal ones, are leaves. The points stand in the order of the
tree, so a subtree is a stretch of them, and its count and sums are differences of cumulative sums.

Assigning goes down from the root. By the triangle inequality all of a subtree is nearest to the
entry nearest to its centre if the next entry is farther by more than twice the radius; only other
nodes go down to their children, and only points of leaves that stay open are compared one by one.
Distances are squared integers; where roots are compared, a margin covers their rounding, so what
is settled is settled exactly, and equal distances are always decided by integers.
"""

from dataclasses import dataclass

import numpy as np

LEAF = 8
MARGIN = 1e-9


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``, exact."""
    out = np.zeros((len(a), len(b)), np.int64)
    for x, y in zip(a.T, b.T):
        off = x[:, None] - y[None, :]
        out += off * off
    return out


@dataclass(frozen=True)
class Tree:
    order: np.ndarray  # of the points given
    points: np.ndarray  # in that order
    centre: np.ndarray
    radius: np.ndarray
    low: np.ndarray  # the stretch of a node
    high: np.ndarray
    first: np.ndarray  # its children
    last: np.ndarray


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of some stretches, one after another."""
    sizes = high - low
    return np.arange(sizes.sum()) + np.repeat(low - np.cumsum(sizes) + sizes, sizes)


def _radii(points: np.ndarray, centre: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    own = np.repeat(np.arange(len(low)), high - low)
    off = points[_ranges(low, high)] - centre[own]
    far = np.zeros(len(low), np.int64)
    np.maximum.at(far, own, (off * off).sum(axis=1))
    return np.sqrt(far)


def tree_of(points: np.ndarray) -> Tree:
    """The cover tree of one point and more."""
    order, n = np.arange(len(points)), len(points)
    low, high, centre = np.array([0]), np.array([n]), points[:1]
    levels, made = [], 0
    while len(low):
        radius = _radii(points[order], centre, low, high)
        splits = np.flatnonzero((high - low > LEAF) & (radius > 0))
        first = last = np.zeros(len(low), np.int64)
        nodes = [np.zeros(0, np.int64)] * 3
        if len(splits):
            at = _ranges(low[splits], high[splits])
            node = np.repeat(np.arange(len(splits)), high[splits] - low[splits])
            child, centres = np.full(len(at), -1), []
            still, heads = np.arange(len(at)), centre[splits]  # a node's centre is its first child's
            parents = np.arange(len(splits))
            while len(still):
                off = points[order[at[still]]] - heads[np.searchsorted(parents, node[still])]
                near = (off * off).sum(axis=1) * 4 <= radius[splits][node[still]] ** 2
                number = len(centres)
                centres.append((parents, heads))
                child[still[near]] = number
                still = still[~near]
                parents, begin = np.unique(node[still], return_index=True)
                heads = points[order[at[still[begin]]]]
            # children of a node side by side, their points as well
            mixed = np.lexsort((child, node))
            order[at] = order[at][mixed]
            pairs = np.stack([node, child])[:, mixed]
            new = np.flatnonzero(np.any(np.diff(pairs, axis=1, prepend=-1), axis=0))
            sizes = np.diff(np.append(new, len(at)))
            begins = at[new]
            which = pairs[:, new]
            heads = np.array(
                [centres[c][1][np.searchsorted(centres[c][0], p)] for p, c in which.T.tolist()]
            ).reshape(-1, points.shape[1])
            nodes = [begins, begins + sizes, heads]
            counts = np.bincount(which[0], minlength=len(splits))
            ends = made + len(low) + np.cumsum(counts)
            first, last = first.copy(), last.copy()
            first[splits], last[splits] = ends - counts, ends
        levels.append((centre, radius, low, high, first, last))
        made += len(low)
        low, high, centre = nodes
    columns = [np.concatenate(c) for c in zip(*levels)]
    return Tree(order, points[order], *columns)


def assigned(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest entry of each point given (the first of equals), counts and sums of each
    entry, and how many points were compared one by one."""
    k, width = book.shape
    to = np.zeros(len(tree.order), np.int64)
    counts, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
    running = np.zeros((len(tree.points) + 1, width), np.int64)
    np.cumsum(tree.points, axis=0, out=running[1:])
    front, compared = np.array([0]), 0
    while len(front):
        far = squared(tree.centre[front], book)
        best = far.argmin(axis=1)
        nearest = np.sqrt(far[np.arange(len(front)), best])
        far[np.arange(len(front)), best] = np.iinfo(np.int64).max
        gap = np.sqrt(far.min(axis=1)) * (1 - MARGIN) - nearest
        settled = (tree.radius[front] == 0) | (gap > 2 * tree.radius[front] * (1 + MARGIN))
        low, high = tree.low[front[settled]], tree.high[front[settled]]
        own = best[settled]
        to[_ranges(low, high)] = np.repeat(own, high - low)
        np.add.at(counts, own, high - low)
        np.add.at(sums, own, running[high] - running[low])
        open_ = front[~settled]
        leaf = tree.first[open_] == tree.last[open_]
        at = _ranges(tree.low[open_[leaf]], tree.high[open_[leaf]])
        if len(at):
            own = squared(tree.points[at], book).argmin(axis=1)
            to[at] = own
            np.add.at(counts, own, 1)
            np.add.at(sums, own, tree.points[at])
            compared += len(at)
        inner = open_[~leaf]
        front = _ranges(tree.first[inner], tree.last[inner])
    out = np.zeros_like(to)
    out[tree.order] = to
    return out, counts, sums, compared
