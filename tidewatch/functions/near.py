"""Nearest places and links between places, in numpy, by trees of boxes.

A place is a point of the unit sphere with its group's number as a fourth coordinate, groups being farther
apart than any two points, so that one tree serves many groups. Boxes are compared by chords; what is
returned is measured as ``geo.haversine_m`` does.
"""

from __future__ import annotations

import numpy as np

from .geo import EARTH_RADIUS_M

_LEAF, _PAIRS, _APART = 24, 1024, 4.0


def metres(lon1, lat1, lon2, lat2):
    half_lat, half_lon = np.radians(lat2 - lat1) / 2, np.radians(lon2 - lon1) / 2
    a = np.sin(half_lat) * np.sin(half_lat) + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(half_lon) * np.sin(half_lon)
    return np.arcsin(np.sqrt(np.minimum(1.0, np.maximum(0.0, a)))) * (2 * EARTH_RADIUS_M)


def chords(reach_m: float) -> tuple[float, float]:
    """Squares of two chords: up to the first a distance is surely within the reach, beyond the second surely not."""
    c = 2 * np.sin(min(np.pi, reach_m / EARTH_RADIUS_M) / 2)
    return max(0.0, c - 1e-14) ** 2 * (1 - 1e-9), (c + 1e-14) ** 2 * (1 + 1e-9)


class Tree:
    """Places, halved along their longest side down to leaves of equal size; the last place fills what is left over."""

    def __init__(self, lon, lat, group, most: int = _LEAF):
        self.lon, self.lat = lon, lat
        p, q = np.radians(lon), np.radians(lat)
        at = np.stack([np.cos(q) * np.cos(p), np.cos(q) * np.sin(p), np.sin(q), _APART * group], 1)
        self.depth = max(0, int(np.ceil(np.log2(len(at) / most))))
        leaf = -(-len(at) // 2**self.depth)
        order = np.minimum(np.arange(leaf << self.depth), len(at) - 1)
        for level in range(self.depth):
            points = at[order].reshape(1 << level, -1, 4)
            longest = (points.max(1) - points.min(1)).argmax(1)
            side = np.take_along_axis(points, longest[:, None, None], 2)[:, :, 0]
            half = np.argpartition(side, side.shape[1] // 2, axis=1)
            order = np.take_along_axis(order.reshape(half.shape), half, 1).ravel()
        self.order, self.leaf = order, leaf
        self.points = at[order].reshape(-1, leaf, 4)
        boxes = [(self.points.min(1), self.points.max(1))]
        while len(boxes[-1][0]) > 1:
            low, high = boxes[-1]
            boxes.append((np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2])))
        self.boxes = boxes[::-1]


def _gaps(a, i, b, j):
    """Squares of the least and the most distance between boxes."""
    low, high, other_low, other_high = a[0][i], a[1][i], b[0][j], b[1][j]
    apart = np.maximum(np.maximum(other_low - high, low - other_high), 0)
    over = np.maximum(other_high - low, high - other_low)
    return np.einsum("ij,ij->i", apart, apart), np.einsum("ij,ij->i", over, over)


def _between(left: Tree, i, right: Tree, j):
    """Squared chords between all points of pairs of leaves."""
    a, b = left.points[i], right.points[j]
    out = np.square(a[:, :, None, 0] - b[:, None, :, 0])
    for k in (1, 2, 3):
        d = a[:, :, None, k] - b[:, None, :, k]
        d *= d
        out += d
    return out


def nearest(left: Tree, right: Tree, reach_m: float) -> np.ndarray:
    """For each place of ``left`` the index of the nearest of ``right`` in its group; -1 where surely none is within the reach."""
    i, j = np.zeros(1, int), np.zeros(1, int)
    bound, a, b = np.full(1, chords(reach_m)[1]), 0, 0
    while True:
        least, most = _gaps(left.boxes[a], i, right.boxes[b], j)
        np.minimum.at(bound, i, most)
        keep = least <= bound[i] * (1 + 1e-9)
        i, j, least = i[keep], j[keep], least[keep]
        if a == left.depth and b == right.depth:
            break
        if a < left.depth:
            i, j, bound, a = np.concatenate([2 * i, 2 * i + 1]), np.concatenate([j, j]), np.repeat(bound, 2), a + 1
        if b < right.depth:
            i, j, b = np.concatenate([i, i]), np.concatenate([2 * j, 2 * j + 1]), b + 1
    ordered = np.lexsort((least, i))
    i, j, least = i[ordered], j[ordered], least[ordered]
    best = np.full(left.points.shape[:2], chords(reach_m)[1])
    found = np.full(best.shape, -1)
    # the nearest leaf of each first: most of the others are then too far
    first = np.ones(len(i), bool)
    first[1:] = i[1:] != i[:-1]
    for turn in (first, ~first):
        u, v, w = i[turn], j[turn], least[turn]
        worth = w <= best[u].max(1)
        u, v = u[worth], v[worth]
        for k in range(0, len(u), _PAIRS):
            x, y = u[k : k + _PAIRS], v[k : k + _PAIRS]
            d = _between(left, x, right, y)
            at = d.argmin(2)
            d = np.take_along_axis(d, at[:, :, None], 2)[:, :, 0]
            starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            best[x[starts]] = np.minimum(best[x[starts]], np.minimum.reduceat(d, starts, axis=0))
            pair, point = np.nonzero(d == best[x])
            found[x[pair], point] = right.order[y[pair] * right.leaf + at[pair, point]]
    out = np.full(len(left.lon), -1)
    out[left.order] = found.ravel()
    return out


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of each a and b in place; ``parent`` names every set's least member."""
    while True:
        a, b = parent[a], parent[b]
        apart = a != b
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def linked(tree: Tree, label: np.ndarray, labels: int, reach_m: float) -> np.ndarray:
    """The sets that ``labels`` sets of places form when places of one group within the reach are linked, by their least label.

    Two boxes that lie within the reach as a whole are linked without their pairs; boxes that are of one set already aren't looked at.
    """
    sure, maybe = chords(reach_m)
    parent = np.arange(labels)
    of = label[tree.order]
    i, j = np.zeros(1, int), np.zeros(1, int)

    def open_pairs(i, j, level):
        now = parent[of].reshape(1 << level, -1)
        low, high = now.min(1), now.max(1)
        return ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))

    for level in range(tree.depth + 1):
        least, most = _gaps(tree.boxes[level], i, tree.boxes[level], j)
        whole = (most <= sure) & open_pairs(i, j, level)
        if whole.any():
            members = of.reshape(1 << level, -1)
            nodes = np.unique(np.concatenate([i[whole], j[whole]]))
            inner = members[nodes]
            unite(parent, inner.ravel(), np.repeat(inner[:, 0], inner.shape[1]))
            unite(parent, members[i[whole], 0], members[j[whole], 0])
        keep = (least <= maybe) & (most > sure) & open_pairs(i, j, level)
        i, j = i[keep], j[keep]
        if level < tree.depth:
            other = i < j
            i, j = np.concatenate([2 * i, 2 * i, 2 * i + 1, 2 * i[other] + 1]), np.concatenate([2 * j, 2 * j + 1, 2 * j + 1, 2 * j[other]])
    for k in range(0, len(i), _PAIRS):
        x, y = i[k : k + _PAIRS], j[k : k + _PAIRS]
        worth = open_pairs(x, y, tree.depth)
        x, y = x[worth], y[worth]
        if not len(x):
            continue
        now = parent[of].reshape(-1, tree.leaf)
        d = _between(tree, x, tree, y)
        pair, u, v = np.nonzero((d <= maybe) & (now[x][:, :, None] != now[y][:, None, :]))
        d, u, v = d[pair, u, v], x[pair] * tree.leaf + u, y[pair] * tree.leaf + v
        p, q = tree.order[u], tree.order[v]
        near = (d <= sure) | (metres(tree.lon[p], tree.lat[p], tree.lon[q], tree.lat[q]) <= reach_m)
        unite(parent, of[u[near]], of[v[near]])
    return parent
