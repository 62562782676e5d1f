"""Cover trees over a block of vectors, and nearest-centre assignment of whole subtrees.

A node covers a run of points (in the tree's order) within ``radius`` of its centre, one of
them.  Sums of a subtree come from cumulative sums over that order.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Nodes of so few points are not split: their points are compared one by one.
LEAF = 8
_SLACK = 1e-9


@dataclass(frozen=True)
class CoverTree:
    order: np.ndarray  # point numbers, such that every node holds a run
    centre: np.ndarray  # point number
    start: np.ndarray
    end: np.ndarray
    first_child: np.ndarray
    children: np.ndarray
    radius: np.ndarray

    def to_bytes(self) -> bytes:
        whole = [self.order, self.centre, self.start, self.end, self.first_child, self.children]
        sizes = np.array([len(self.order), len(self.centre)], "<i4")
        return b"".join(a.astype("<i4").tobytes() for a in [sizes, *whole]) + self.radius.astype("<f8").tobytes()

    @staticmethod
    def from_bytes(data: bytes) -> CoverTree:
        n, nodes = np.frombuffer(data, "<i4", 2)
        ends = np.cumsum([2, n, *[nodes] * 5])
        whole = np.frombuffer(data, "<i4", ends[-1])
        return CoverTree(
            *(whole[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)), np.frombuffer(data, "<f8", nodes, 4 * ends[-1])
        )


def _distances(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(np.sum((points - centre) ** 2, axis=1))


def build(points: np.ndarray) -> CoverTree:
    """Tree over all ``points``; each level's balls have half the radius of the one above, and no
    centre of a level lies within another ball of its node."""
    points = points.astype(np.float64)
    order = np.arange(len(points))
    nodes: list[list] = []  # centre, start, end, first child, children, radius

    def add(start: int, members: np.ndarray, gaps: np.ndarray) -> None:
        """A node whose centre is its first member."""
        order[start : start + len(members)] = members
        nodes.append([members[0], start, start + len(members), 0, 0, gaps.max()])

    add(0, order.copy(), _distances(points, points[0]))
    at = 0
    while at < len(nodes):
        node = nodes[at]
        centre, start, end, _, _, radius = node
        if end - start > LEAF and radius > 0:
            node[3] = len(nodes)
            left = order[start:end].copy()
            while len(left):
                gaps = _distances(points[left], points[left[0]])
                near = gaps <= radius / 2
                add(start, left[near], gaps[near])
                start += nodes[-1][2] - nodes[-1][1]
                left = left[~near]
            node[4] = len(nodes) - node[3]
        at += 1
    columns = list(zip(*nodes, strict=True))
    return CoverTree(order, *(np.array(c, np.int64) for c in columns[:5]), np.array(columns[5], np.float64))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def _squares(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of points (rows) to centres (columns), exact for whole numbers."""
    largest = max(int(np.max(np.abs(a), initial=0)) for a in (points, centres))
    kind = np.float64 if points.shape[1] * (2 * largest) ** 2 < 2**53 else object
    return ((points.astype(kind)[:, None, :] - centres.astype(kind)[None]) ** 2).sum(axis=2)


def assign(tree: CoverTree, points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, ...]:
    """Nearest centre of every point, the lower index on ties.

    Returns runs of the tree's order that go to one centre as a whole (starts, ends, centres),
    then positions of single points and their centres.  A centre is out for a subtree if even the
    triangle inequality's bounds put it behind another one for all its points; what is left
    undecided goes to the children, at last to exact comparisons of points.
    """
    runs: list[tuple] = [(np.zeros(0, np.int64),) * 3]
    singles: list[tuple] = [(np.zeros(0, np.int64),) * 2]
    node, open_ = np.zeros(1, np.int64), np.ones((1, len(centres)), bool)
    while len(node):
        gaps = np.sqrt(_squares(points[tree.centre[node]], centres).astype(np.float64))
        gaps[~open_] = np.inf
        nearest, radius = gaps.min(axis=1), tree.radius[node]
        limit = nearest + 2 * radius
        open_ &= gaps <= (limit + _SLACK * (1 + limit))[:, None]
        one = open_.sum(axis=1) == 1
        runs.append((tree.start[node[one]], tree.end[node[one]], open_[one].argmax(axis=1)))
        node, open_ = node[~one], open_[~one]
        inner = tree.children[node] > 0
        leaf = node[~inner]
        sizes = tree.end[leaf] - tree.start[leaf]
        at = _ranges(tree.start[leaf], sizes)
        squares = _squares(points[tree.order[at]], centres)
        squares[~np.repeat(open_[~inner], sizes, axis=0)] = np.inf
        singles.append((at, squares.argmin(axis=1) if len(at) else at))
        node, open_ = node[inner], open_[inner]
        counts = tree.children[node]
        node, open_ = _ranges(tree.first_child[node], counts), np.repeat(open_, counts, axis=0)
    return tuple(np.concatenate(c) for c in zip(*runs, strict=True)) + tuple(
        np.concatenate(c) for c in zip(*singles, strict=True)
    )


def sums_by_centre(tree: CoverTree, points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum (rows) and number of the points nearest to each centre, in whole numbers."""
    starts, ends, whole, at, single = assign(tree, points, centres)
    fits = int(np.max(np.abs(points), initial=0)) * (len(points) + 1) < 2**62
    ordered = points[tree.order].astype(np.int64 if fits else object)
    before = np.zeros((len(points) + 1, points.shape[1]), ordered.dtype)
    before[1:] = np.cumsum(ordered, axis=0)
    sums, counts = np.zeros((len(centres), points.shape[1]), ordered.dtype), np.zeros(len(centres), np.int64)
    np.add.at(sums, whole, before[ends] - before[starts])
    np.add.at(counts, whole, ends - starts)
    np.add.at(sums, single, ordered[at])
    np.add.at(counts, single, 1)
    return sums, counts


def nearest_centres(tree: CoverTree, points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of each point's nearest centre."""
    starts, ends, whole, at, single = assign(tree, points, centres)
    found = np.zeros(len(points), np.int64)
    found[tree.order[_ranges(starts, ends - starts)]] = np.repeat(whole, ends - starts)
    found[tree.order[at]] = single
    return found
