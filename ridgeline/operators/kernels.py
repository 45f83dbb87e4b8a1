"""Array kernels that run on one tile or one contracted graph at a time."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def settle(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component, for edges (u, v) on nodes 0 .. n-1."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        differ = a != b
        if not differ.any():
            break
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


class Box:
    """Cells by position in their bounding box, for neighbour look-ups."""

    def __init__(self, at: np.ndarray) -> None:
        self.low = at.min(axis=0)
        self.shape = at.max(axis=0) - self.low + 1
        self.at = at - self.low
        self.row = np.full(int(np.prod(self.shape)), -1, np.int64)
        self.row[np.ravel_multi_index(self.at.T, self.shape)] = np.arange(len(at))

    def pairs(self, step: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the cells and of their neighbours one step on, where both are present."""
        to = self.at + np.asarray(step)
        inside = ((to >= 0) & (to < self.shape)).all(axis=1)
        rows = np.flatnonzero(inside)
        other = self.row[np.ravel_multi_index(to[rows].T, self.shape)]
        there = other >= 0
        return rows[there], other[there]


def half(steps: Sequence[Sequence[int]]) -> list[Sequence[int]]:
    """One of each step and its opposite."""
    return [s for s in steps if tuple(s) > tuple(-x for x in s)]


def label_equal(at: np.ndarray, key: np.ndarray, steps: Sequence[Sequence[int]]) -> np.ndarray:
    """Rows sorted by cell: the first row of each cell's component of neighbouring cells with equal keys."""
    box = Box(at)
    us, vs = [], []
    for s in steps:
        u, v = box.pairs(s)
        same = key[u] == key[v]
        us.append(u[same])
        vs.append(v[same])
    return settle(len(at), np.concatenate(us), np.concatenate(vs)) if us else np.arange(len(at))


def neighbour_edges(at: np.ndarray, steps: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    box = Box(at)
    parts = [box.pairs(s) for s in half(steps)]
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def basins(n: int, height: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The peak node to which steepest ascent leads; ties go to the smaller node.  Neighbours differ in height."""
    a, b = np.r_[u, v], np.r_[v, u]
    up = height[b] > height[a]
    a, b = a[up], b[up]
    order = np.lexsort((-b, height[b], a))
    a, b = a[order], b[order]
    last = np.r_[a[1:] != a[:-1], True] if len(a) else np.zeros(0, bool)
    to = np.arange(n)
    to[a[last]] = b[last]
    while True:
        up2 = to[to]
        if (up2 == to).all():
            return to
        to = up2


def merge_tree(tops: np.ndarray, height: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray, cell: np.ndarray) -> list[tuple]:
    """Kruskal's algorithm from the highest saddle down.

    ``tops`` are peaks with their ``height``; an edge joins the basins of peaks ``a`` and ``b`` (positions in
    ``tops``) at a saddle of some height and cell.  Gives for each peak
    ``(saddle height, saddle cell, parent, joining saddle height, joining cell, group, lead, lead height)``: the
    highest saddle towards strictly higher terrain and the peak beyond it (None for the highest), the saddle that joins
    the peak to an equal one before that, the smallest peak of its group of equals, and the smaller equal peak that
    first takes the lead over it, with the height at which it does.
    """
    n = len(tops)
    out: list[list] = [[None, None, None, None, None, int(tops[i]), None, None] for i in range(n)]
    root = list(range(n))
    best = height.tolist()
    open_tops: list[list[int]] = [[i] for i in range(n)]

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    order = np.lexsort((cell, -weight.astype(np.float64) if weight.dtype.kind == "f" else -weight))
    i = 0
    while i < len(order):
        j = i
        w = weight[order[i]]
        touched: dict[int, int] = {}
        links: list[tuple[int, int, int]] = []
        while j < len(order) and weight[order[j]] == w:
            e = order[j]
            x, y = find(int(a[e])), find(int(b[e]))
            if x != y:
                links.append((x, y, int(cell[e])))
            j += 1
        i = j
        if not links:
            continue
        # All components that this level joins, as one batch: the result does not depend on the order of equal saddles.
        group: dict[int, int] = {}

        def top(x: int, group=group) -> int:
            while group.setdefault(x, x) != x:
                x = group[x]
            return x

        for x, y, c in links:
            for z in (x, y):
                touched[z] = min(touched.get(z, c), c)
            p, q = top(x), top(y)
            if p != q:
                group[max(p, q)] = min(p, q)
        batches: dict[int, list[int]] = {}
        for x in touched:
            batches.setdefault(top(x), []).append(x)
        for parts in batches.values():
            high = max(best[x] for x in parts)
            equals = [x for x in parts if best[x] == high]
            heads = sorted(t for x in equals for t in open_tops[x])
            parent = int(tops[heads[0]])
            for x in parts:
                if best[x] < high:
                    for t in open_tops[x]:
                        out[t][0], out[t][1], out[t][2] = w, touched[x], parent
                    open_tops[x] = []
                elif len(equals) > 1:
                    for t in open_tops[x]:
                        if out[t][3] is None:
                            out[t][3], out[t][4] = w, touched[x]
            if len(equals) > 1:
                for t in heads:
                    out[t][5] = parent
                    if out[t][6] is None and t != heads[0]:
                        out[t][6], out[t][7] = parent, w
            home = min(parts)
            for x in parts:
                root[x] = home
            best[home] = high
            open_tops[home] = heads
    return [tuple(o) for o in out]
