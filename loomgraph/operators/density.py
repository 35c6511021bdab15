"""Density clusters of points: the exact spanning tree of mutual reachability from two passes over tiles of distances.

A first pass finds every point's nearest points. They give a spanning tree that is nearly the
least one, and the greatest link on its path between two points bounds every pair that a least tree
can hold. A second pass keeps the pairs within that bound, which are few, and the least trees of all
sizes are taken from these. Tiles are made in single precision and lowered by more than their error, so
that none is lost; what they keep is measured in double precision.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np

#: Points to the side of a tile, and the pairs held before they are cut down to the nearest.
TILE, HELD = 512, 1 << 21
#: Share of the squared lengths by which single (double) precision can be wrong over 64 products; slack for equal links.
ERROR, SLACK = {np.float32: 1e-5, np.float64: 1e-13}, 1 + 1e-9


class _Tiles:
    """Squared distances, none above the true one, between runs of points."""

    def __init__(self, x: np.ndarray, order: np.ndarray):
        x = x[order] - x.mean(0)
        square = (x * x).sum(1)
        # far greater lengths would leave nothing of the others in single precision
        kind = np.float32 if 1e-24 < np.median(square) and square.max() < min(1e24, 1e4 * np.median(square)) else np.float64
        low = square * (1 - ERROR[kind] * max(1, x.shape[1] / 64))
        self.left, self.right = np.ones((2, len(x), x.shape[1] + 2), dtype=kind)
        self.left[:, :-2], self.left[:, -2] = x, low
        self.right[:, :-2], self.right[:, -1] = x, low
        self.right[:, :-2] *= -2
        # whole tiles but for the last, which is from half a tile to one and a half
        self.ends = np.append(np.arange(max(1, (len(x) + TILE // 2) // TILE)) * TILE, len(x))
        self.count = len(self.ends) - 1
        self.x, self.tight = x, np.zeros(self.count, dtype=bool)
        if kind is np.float32:
            for k in range(self.count):  # runs of points that single precision hardly tells apart
                doubt = 8 * ERROR[kind] * np.median(square[self.run(k)])
                self.tight[k] = np.count_nonzero(self.left[self.run(k)] @ self.right[self.run(k)].T < doubt) * 16 > (self.ends[k + 1] - self.ends[k]) ** 2
        if not self.tight.any():
            del self.x

    def run(self, k: int) -> slice:
        return slice(self.ends[k], self.ends[k + 1])

    def between(self, a: int, b: int) -> np.ndarray:
        if self.tight[a] and self.tight[b]:
            p, q = self.x[self.run(a)], self.x[self.run(b)]
            p, q = p - p.mean(0), q - p.mean(0)
            s, t = ((1 - ERROR[np.float64]) * (y * y).sum(1) for y in (p, q))
            return s[:, None] + t[None, :] - 2 * p @ q.T
        return self.left[self.run(a)] @ self.right[self.run(b)].T


def _places(mask: np.ndarray) -> np.ndarray:
    """Flat places of what is set, eight looked at together."""
    flat = mask.ravel()
    if flat.size % 8:
        return np.flatnonzero(flat)
    word = np.flatnonzero(flat.view(np.uint64))
    w, k = np.nonzero(flat.reshape(-1, 8)[word])
    return word[w] * 8 + k


def _distances(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a))
    for s in range(0, len(a), 1 << 14):
        gap = x[a[s : s + (1 << 14)]] - x[b[s : s + (1 << 14)]]
        out[s : s + (1 << 14)] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def _near_order(x: np.ndarray) -> np.ndarray:
    """The points in an order in which near ones mostly share a tile: halves along lines through two points."""
    rng, open_, done = np.random.default_rng(7), [np.arange(len(x))], []
    while open_:
        at = open_.pop()
        if len(at) <= TILE:
            done.append(at)
            continue
        p, q = x[rng.choice(at, 2, replace=False)]
        half = np.argpartition(x[at] @ (p - q), len(at) // 2)
        open_ += [at[half[: len(at) // 2]], at[half[len(at) // 2 :]]]
    return np.concatenate(done)


def _nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``points, distances`` of each point's ``k`` nearest others, up to the error of the tiles."""
    n = len(x)
    order = _near_order(x)
    tiles = _Tiles(x, order)
    near, dist = np.zeros((n, k), dtype=np.int32), np.full((n, k), np.inf, dtype=np.float32)
    for t in range(tiles.count):
        run, d = tiles.run(t), tiles.between(t, t)
        np.fill_diagonal(d, np.inf)
        m = min(k, len(d) - 1)
        best = np.argpartition(d, m - 1, axis=1)[:, :m]
        near[run, :m], dist[run, :m] = best + run.start, np.take_along_axis(d, best, 1)
    np.maximum(dist, 0, out=dist)
    bound = dist.max(1)
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def cut() -> None:
        a, b, d = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        few = d < bound[a]
        a, b, d = a[few], b[few], d[few]
        some = np.unique(a)
        # the kept ones stand before the new ones of each point
        a = np.concatenate([np.repeat(some, k), a])
        b = np.concatenate([near[some].ravel(), b])
        d = np.concatenate([dist[some].ravel(), d])
        by = np.argsort((a.astype(np.uint64) << np.uint64(32)) | d.view(np.uint32))
        a, first = a[by], np.flatnonzero(np.diff(a[by], prepend=-1))
        take = by[(first[:, None] + np.arange(k)).ravel()]
        near[some], dist[some] = b[take].reshape(-1, k), d[take].reshape(-1, k)
        bound[some] = dist[some].max(1)

    total, (one, two) = 0, np.empty((2, TILE * TILE), dtype=bool)
    for gap in range(1, tiles.count):
        for s in range(tiles.count - gap):
            rows, cols = tiles.run(s), tiles.run(s + gap)
            d = tiles.between(s, s + gap)
            if d.size == len(one):
                mask, other = one.reshape(d.shape), two.reshape(d.shape)
                np.less(d, bound[rows, None], out=mask)
                np.logical_or(mask, np.less(d, bound[None, cols], out=other), out=mask)
            else:
                mask = (d < bound[rows, None]) | (d < bound[None, cols])
            at = _places(mask)
            if not len(at):
                continue
            a, b = np.divmod(at, d.shape[1])
            d = np.maximum(d.ravel()[at], 0).astype(np.float32)
            a, b = (a + rows.start).astype(np.int32), (b + cols.start).astype(np.int32)
            for p, q in ((a, b), (b, a)):
                few = d < bound[p]
                held.append((p[few], q[few], d[few]))
                total += len(held[-1][0])
            if total > HELD:
                cut()
                total = 0
    if held:
        cut()
    points = np.empty((n, k), dtype=np.int32)
    points[order] = order[near]
    exact = _distances(x, np.repeat(np.arange(n), k), points.ravel()).reshape(n, k)
    return points, exact


def _least_tree(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the edges of a least spanning forest, and each point's part: all parts join their least edge each round."""
    by = np.argsort(w, kind="stable")
    a, b = a[by], b[by]
    part, chosen, live = np.arange(n), [], np.arange(len(a))
    p, q = a, b
    while len(live):
        # edges are in order, so the first of a part is its least
        first = np.full(n, len(a))
        np.minimum.at(first, p, live)
        np.minimum.at(first, q, live)
        edge = np.unique(first[first < len(a)])
        chosen.append(edge)
        s, t = part[a[edge]], part[b[edge]]
        top = np.arange(n)
        while True:  # smallest part of what these edges join
            low = np.minimum(top[s], top[t])
            was = top.copy()
            np.minimum.at(top, s, low)
            np.minimum.at(top, t, low)
            top = top[top]
            if (top == was).all():
                break
        part = top[part]
        p, q = part[a[live]], part[b[live]]
        apart = p != q
        p, q, live = p[apart], q[apart], live[apart]
    return by[np.concatenate(chosen)] if chosen else np.empty(0, dtype=np.int64), part


class _Bounds:
    """The greatest link on the path between points of a tree, read off the order in which its parts join."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray):
        group, last, after, height = list(range(n)), list(range(n)), [-1] * n, [0.0] * n
        size = [1] * n
        by = np.argsort(w, kind="stable")
        for p, q, d in zip(a[by].tolist(), b[by].tolist(), w[by].tolist(), strict=True):
            while group[p] != p:
                group[p] = p = group[group[p]]
            while group[q] != q:
                group[q] = q = group[group[q]]
            # a part is named by any point, its first in the order is kept beside it
            if size[p] < size[q]:
                p, q = q, p
            after[last[p]], height[last[p]] = q, d
            last[p] = last[q]
            size[p] += size[q]
            group[q] = p
        self.order = np.empty(n, dtype=np.int64)
        at = 0
        while group[at] != at:
            at = group[at]
        for k in range(n):
            self.order[k] = at
            at = after[at]
        self.place = np.empty(n, dtype=np.int64)
        self.place[self.order] = np.arange(n)
        self.levels = [np.array(height)[self.order]]
        while 2 << len(self.levels) - 1 <= n:
            h, step = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.maximum(h[:-step], h[step:]))

    def places(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For places ``i < j`` in the order."""
        level = np.frexp((j - i).astype(np.float64))[1] - 1
        out = np.empty(len(i))
        for k in np.unique(level):
            on = np.flatnonzero(level == k)
            out[on] = np.maximum(self.levels[k][i[on]], self.levels[k][j[on] - (1 << k)])
        return out

    def points(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        p, q = self.place[a], self.place[b]
        return self.places(np.minimum(p, q), np.maximum(p, q))


def _join_parts(x: np.ndarray, core: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part but the largest an edge to its nearest point of another part."""
    names, part, sizes = np.unique(part, return_inverse=True, return_counts=True)
    square = (x * x).sum(1)
    best, ends = np.full(len(names), np.inf), np.zeros((len(names), 2), dtype=np.int64)
    rows = np.flatnonzero(part != np.argmax(sizes))
    for s in range(0, len(rows), 16):
        at = rows[s : s + 16]
        d = np.sqrt(np.maximum(0, square[at, None] + square[None, :] - 2 * x[at] @ x.T))
        d = np.maximum(np.maximum(d, core[None, :]), core[at, None])
        d[part[at][:, None] == part[None, :]] = np.inf
        to = d.argmin(1)
        for p, q, w in zip(at.tolist(), to.tolist(), d[np.arange(len(at)), to].tolist(), strict=True):
            if w < best[part[p]]:
                best[part[p]], ends[part[p]] = w, (p, q)
    found = ends[np.isfinite(best)]
    return found[:, 0], found[:, 1]


def near_pairs(x: np.ndarray, copies: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``a, b, distance`` of every pair that a least tree of mutual reachability can hold for sizes up to ``most``.

    A point counts as often as it has ``copies``. With smaller sizes links and what bounds them are smaller, so those
    of ``most`` are enough; the ``most - 1`` nearest of every point are among the pairs.
    """
    n = len(x)
    k = min(most, n - 1)
    if not k:
        return np.empty(0, dtype=np.int32), np.empty(0, dtype=np.int32), np.empty(0)
    points, dist = _nearest(x, k)
    by = np.argsort(dist, axis=1)
    within = copies[:, None] + np.cumsum(copies[np.take_along_axis(points, by, 1)], axis=1)
    at = np.minimum((within < most).sum(1), k - 1)
    core = np.where(copies >= most, 0.0, np.take_along_axis(dist, by, 1)[np.arange(n), at])
    a, b, d = np.repeat(np.arange(n), k), points.ravel().astype(np.int64), dist.ravel()
    while True:
        w = np.maximum(d, np.maximum(core[a], core[b]))
        tree, part = _least_tree(n, a, b, w)
        if len(tree) == n - 1:
            break
        p, q = _join_parts(x, core, part)
        a, b = np.concatenate([a[tree], p]), np.concatenate([b[tree], q])
        d = np.concatenate([d[tree], _distances(x, p, q)])
    bounds = _Bounds(n, a[tree], b[tree], w[tree] * SLACK)
    del points, dist, a, b, d, w
    tiles = _Tiles(x, bounds.order)
    kept = []
    for s in range(tiles.count):
        for t in range(s, tiles.count):
            rows, cols = tiles.run(s), tiles.run(t)
            reach = bounds.places(np.array([rows.start]), np.array([cols.stop - 1]))[0] if cols.stop - rows.start > 1 else 0.0
            d = tiles.between(s, t)
            at = _places(d <= d.dtype.type(reach * reach * (1 + 1e-6)))
            i, j = np.divmod(at, d.shape[1])
            i, j, d = i + rows.start, j + cols.start, d.ravel()[at]
            if s == t:
                on = i < j
                i, j, d = i[on], j[on], d[on]
            reach = bounds.places(i, j)
            on = d <= reach * reach * (1 + 1e-6)
            i, j, reach = i[on], j[on], reach[on]
            a, b = bounds.order[i], bounds.order[j]
            exact = _distances(x, a, b)
            on = exact <= reach
            kept.append((a[on].astype(np.int32), b[on].astype(np.int32), exact[on]))
    return tuple(np.concatenate(c) for c in zip(*kept, strict=True))


class Neighbourhood:
    """What the spanning trees of a set of points need, for all sizes up to ``most``."""

    def __init__(self, x: np.ndarray, most: int):
        x = np.ascontiguousarray(x) + 0.0
        self.n, self.most = len(x), most
        # equal points have equal core distances, so all but the first hang on it at theirs
        rows = x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
        same = np.unique(rows, return_inverse=True)[1].ravel()
        by = np.argsort(same, kind="stable")
        start = np.flatnonzero(np.diff(same[by], prepend=-1))
        count = np.diff(np.append(start, self.n))
        head = np.repeat(by[start], count)
        self.copies = by[head != by], head[head != by]
        kept = np.argsort(by[start])
        self.kept, self.count = by[start][kept], count[kept]
        self.pairs = a, b, d = near_pairs(x if len(self.kept) == self.n else x[self.kept], self.count, most)
        p, q, d = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([d, d])
        by = np.lexsort((d, p))
        self.first, self.ranked = np.searchsorted(p[by], np.arange(len(self.kept) + 1)), d[by]
        self.within = np.cumsum(self.count[q[by]])

    def core_distances(self, least: int) -> np.ndarray:
        """Every kept point's distance to its neighbour of rank ``least``, itself the first."""
        core, need = np.zeros(len(self.kept)), min(least, self.n) - self.count
        on = np.flatnonzero(need > 0)
        before = np.append(0, self.within)[self.first[on]]
        core[on] = self.ranked[np.searchsorted(self.within, before + need[on])]
        return core

    def spanning_links(self, least: int) -> list[tuple[float, int, int]]:
        """Minimum spanning tree of mutual reachability for a size, as ``distance, point, point``."""
        core, name = self.core_distances(least), self.kept.tolist()
        links = [(w, name[p], name[q]) for w, p, q in _grown_tree(len(name), *self.pairs, core)]
        copy, head = self.copies
        away = core[np.searchsorted(self.kept, head)]
        return links + list(zip(away.tolist(), head.tolist(), copy.tolist(), strict=True))


def _grown_tree(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray, core: np.ndarray) -> list[tuple[float, int, int]]:
    """Least tree grown from the first point; of equal links those of the first point go first."""
    w = np.maximum(d, np.maximum(core[a], core[b]))
    tree, _ = _least_tree(n, a, b, w)
    # what a least tree can hold, equal links included
    on = np.flatnonzero(w <= _Bounds(n, a[tree], b[tree], w[tree]).points(a, b))
    p, q, w = np.concatenate([a[on], b[on]]), np.concatenate([b[on], a[on]]), np.concatenate([w[on], w[on]])
    by = np.argsort(p, kind="stable")
    start = np.searchsorted(p[by], np.arange(n + 1)).tolist()
    to, away = q[by].tolist(), w[by].tolist()
    near, parent, links, open_, at = [np.inf] * n, [0] * n, [], [], 0
    for _ in range(n - 1):
        near[at] = -1.0  # joined
        for e in range(start[at], start[at + 1]):
            if away[e] < near[to[e]]:
                near[to[e]], parent[to[e]] = away[e], at
                heappush(open_, (away[e], to[e]))
        while True:
            reach, at = heappop(open_)
            if near[at] == reach:
                break
        links.append((reach, parent[at], at))
    return links
