"""Measures of many pairs of two lists of polygons at once.

A simple ring covers, above each abscissa, what its upper edges bound less what
its lower ones do; so the area that two rings share is a signed sum, over pairs
of their edges, of the area below both. Pairs that share area meet. Of the others
it is decided exactly whether edges meet, and if none do the distance is the least
from a vertex to an edge. Rings of more than MOST edges, with holes or that aren't
simple go to the row-wise kernels.
"""

from __future__ import annotations

import numpy as np

from plinth.functions import kernels as K

MOST = 32
#: Shared area, of the square of the pair's extent, above which it can't be rounding.
SURE = 1e-9


class Side:
    """Polygons (WKB) as padded arrays of edges; ``plain`` tells which the sums hold for."""

    def __init__(self, data: list):
        self.shapes = [K.from_wkb(x) for x in data]
        n = len(data)
        one = [k for k, g in enumerate(self.shapes) if g and len(g) == 1 and len(g[0]) == 1 and 4 <= len(g[0][0]) <= MOST + 1 and (g[0][0][0] == g[0][0][-1]).all()]
        width = max((len(self.shapes[k][0][0]) - 1 for k in one), default=1)
        self.edges, self.real = np.zeros((n, width, 4)), np.zeros((n, width), bool)
        self.plain = np.zeros(n, bool)
        self.plain[one] = True
        for k in one:
            r = self.shapes[k][0][0]
            self.edges[k, : len(r) - 1] = np.hstack([r[:-1], r[1:]])
            self.edges[k, len(r) - 1 :] = np.tile(r[-1], 2)
            self.real[k, : len(r) - 1] = True
        e = self.edges
        self.low, self.high = np.minimum(e[..., :2], e[..., 2:]).min(axis=1), np.maximum(e[..., :2], e[..., 2:]).max(axis=1)
        local = e - np.tile(self.low, 2)[:, None]
        area2 = (local[..., 0] * local[..., 3] - local[..., 2] * local[..., 1]).sum(axis=1)
        self.area = np.abs(area2) / 2
        self.plain &= self._simple() & (self.area > 0) & np.isfinite(self.area)
        # Edges that aren't vertical, from left to right: x1, y1, x2, y2 and whether the inside lies below (1) or above (-1).
        flip = e[..., 0] > e[..., 2]
        self.ltr = np.where(flip[..., None], e[..., [2, 3, 0, 1]], e)
        self.sign = np.where(e[..., 0] == e[..., 2], 0.0, np.where(flip, 1.0, -1.0)) * np.sign(area2)[:, None]
        order = np.argsort(self.sign == 0, axis=1, kind="stable")
        self.sign = np.take_along_axis(self.sign, order, axis=1)
        self.ltr = np.take_along_axis(self.ltr, order[..., None], axis=1)
        used = self.sign[self.plain]
        most = int((used != 0).sum(axis=1).max()) if len(used) else 0
        self.sign, self.ltr = self.sign[:, :most], self.ltr[:, :most]
        self.level = bool((self.ltr[self.plain][..., 1] == self.ltr[self.plain][..., 3])[used[:, :most] != 0].all())

    def _simple(self) -> np.ndarray:
        """Whether no edges of a ring meet but neighbours in their shared ends."""
        e, counts = self.edges, self.real.sum(axis=1)
        ok = ~((e[..., :2] == e[..., 2:]).all(axis=2) & self.real).any(axis=1)
        d = e[..., 2:] - e[..., :2]
        rows = np.arange(len(e))
        for i in range(e.shape[1]):
            at = rows[self.real[:, i]]
            after = (i + 1) % counts[at]
            ok[at[(d[at, i] * d[at, after]).sum(axis=1) < 0]] &= ~self._folds(at[(d[at, i] * d[at, after]).sum(axis=1) < 0], i, counts)
            for j in range(i + 2, e.shape[1]):
                at = rows[self.real[:, j] & ~((i == 0) & (j == counts - 1))]
                near = at[_boxes_meet(e[at, i], e[at, j])]
                ok[near[K._meet(e[near, i], e[near, j])]] = False
        return ok

    def _folds(self, at: np.ndarray, i: int, counts: np.ndarray) -> np.ndarray:
        e = self.edges
        return K._side(e[at, i, :2], e[at, i, 2:], e[at, (i + 1) % counts[at], 2:]) == 0


def _boxes_meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((np.minimum(a[:, :2], a[:, 2:]) <= np.maximum(b[:, :2], b[:, 2:])) & (np.minimum(b[:, :2], b[:, 2:]) <= np.maximum(a[:, :2], a[:, 2:]))).all(axis=1)


def _shared(a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    base = np.minimum(a.low[i, 1], b.low[j, 1])
    out = np.zeros(len(i))
    for e in range(a.sign.shape[1]):
        p, s = a.ltr[i, e], a.sign[i, e]
        for f in range(b.sign.shape[1]):
            q, sign = b.ltr[j, f], s * b.sign[j, f]
            lo, hi = np.maximum(p[:, 0], q[:, 0]), np.minimum(p[:, 2], q[:, 2])
            w = np.maximum(hi - lo, 0) * sign
            if a.level and b.level:
                out += w * (np.minimum(p[:, 1], q[:, 1]) - base)
                continue
            k = np.flatnonzero(w)
            ends = []
            for x in (lo[k], hi[k]):
                ends.append([m[k, 1] + (m[k, 3] - m[k, 1]) * ((x - m[k, 0]) / (m[k, 2] - m[k, 0])) - base[k] for m in (p, q)])
            (pl, ql), (ph, qh) = ends
            dl, dh = pl - ql, ph - qh
            below = (np.minimum(dl, 0) + np.minimum(dh, 0)) / 2
            cross = dl * dh < 0
            below[cross] = np.minimum(dl, dh)[cross] ** 2 / (np.abs(dl) + np.abs(dh))[cross] / -2
            out[k] += w[k] * ((ql + qh) / 2 + below)
    return out


def measures(a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distance, shared area) of the pairs a[i], b[j]; nan where one is missing or empty."""
    dist, inter = np.full(len(i), np.nan), np.full(len(i), np.nan)
    plain = a.plain[i] & b.plain[j]
    k = np.flatnonzero(plain)
    i1, j1 = i[k], j[k]
    found = np.maximum(_shared(a, b, i1, j1), 0)
    span = np.maximum(a.high[i1], b.high[j1]) - np.minimum(a.low[i1], b.low[j1])
    sure = SURE * (span * span).sum(axis=1)
    dist[k], inter[k] = 0.0, found
    open_ = found <= sure
    k, i1, j1, sure = k[open_], i1[open_], j1[open_], sure[open_]
    met, gap = np.zeros(len(k), bool), np.full(len(k), np.inf)
    for e in range(a.edges.shape[1]):
        p, here = a.edges[i1, e], a.real[i1, e]
        for f in range(b.edges.shape[1]):
            q = b.edges[j1, f]
            at = np.flatnonzero(here & b.real[j1, f] & ~met)
            near = at[_boxes_meet(p[at], q[at])]
            met[near] |= K._meet(p[near], q[near])
            for points, lines in ((p, q), (q, p)):
                x, y, d = points[at, :2], lines[at, :2], lines[at, 2:] - lines[at, :2]
                t = np.clip(((x - y) * d).sum(axis=1) / (d * d).sum(axis=1), 0, 1)
                to = y + t[:, None] * d - x
                gap[at] = np.minimum(gap[at], np.sqrt((to * to).sum(axis=1)))
    apart = ~met & (np.minimum(a.area[i1], b.area[j1]) > 10 * sure)
    dist[k[apart]], inter[k[apart]] = gap[apart], 0.0
    rest = np.concatenate([np.flatnonzero(~plain), k[~met & ~apart]])
    for n in rest.tolist():
        g, h = a.shapes[i[n]], b.shapes[j[n]]
        if g is not None and h is not None:
            dist[n] = K.distance(g, h)
            inter[n] = K.intersection_area(g, h) if dist[n] == 0 else 0.0
    return dist, inter
