"""WKT columns read a batch at a time: what cleaning asks of a geometry, from one pass.

The rings of all plain polygons of a batch (one ring, a size's bound of vertices, no
point twice in a row) lie in one array of coordinates with an offset a row. Their
text is turned into numbers at once, and areas, boxes and crossings are reductions
over the array. Rings that are invalid are repaired many in one arrangement, and
polygons of one hole are judged together, too. Other rows (more holes, parts, long
rings, malformed text) go through the kernels one by one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from plinth.functions import kernels as K
from plinth.functions.arrangement import unique_rows
from plinth.functions.geometry import RADIUS

#: Most vertices of a ring that is read with others.
VERTICES = 64
#: Rows, and pairs of edges, that are looked at together.
ROWS, PAIRS = 2048, 1 << 20

_PAIR = rf"\s*{K._NUMBER}\s+{K._NUMBER}\s*"
_PLAIN = re.compile(rf"\s*POLYGON\s*\(\s*\(({_PAIR}(?:,{_PAIR})*)\)\s*\)\s*", re.IGNORECASE)
_HOLED = re.compile(rf"\s*POLYGON\s*\(\s*\(({_PAIR}(?:,{_PAIR})*)\)\s*,\s*\(({_PAIR}(?:,{_PAIR})*)\)\s*\)\s*", re.IGNORECASE)
_HEAD = b"\x01\x03\x00\x00\x00\x01\x00\x00\x00"
FIELDS = "wkb binary, parsed boolean, was_valid boolean, repaired boolean, holes int, area double"


def mercator(points: np.ndarray) -> np.ndarray:
    """Longitude and latitude in degrees to Web Mercator."""
    rad = np.radians(points)
    return np.stack([rad[:, 0], np.log(np.tan(np.pi / 4 + rad[:, 1] / 2))], axis=1) * RADIUS


def ring_areas(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Areas of closed rings that lie one after another, without sign."""
    d = points - np.repeat(points[starts[:-1]], np.diff(starts), axis=0)
    cross = np.append(d[:-1, 0] * d[1:, 1] - d[1:, 0] * d[:-1, 1], 0.0)
    cross[starts[1:] - 1] = 0.0  # from a ring's end to the next ring
    return np.abs(np.add.reduceat(cross, starts[:-1])) / 2


def simple_rings(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which closed rings without double points neither cross nor overlap themselves."""
    lengths = np.diff(starts) - 1  # edges
    at = np.repeat(starts[:-1], lengths) + np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    e = np.hstack([points[at], points[at + 1]])
    ring, first = np.repeat(np.arange(len(lengths)), lengths), np.cumsum(lengths) - lengths
    place, n = np.arange(len(e)) - first[ring], lengths[ring]
    after = first[ring] + (place + 1) % n
    ok = np.ones(len(lengths), bool)
    back = ((e[:, 2:] - e[:, :2]) * (e[after, 2:] - e[after, :2])).sum(axis=1) < 0
    folded = np.flatnonzero(back)[K._side(e[back, :2], e[back, 2:], e[after[back], 2:]) == 0]
    ok[ring[folded]] = False
    # Each edge with those after the next one in its ring.
    rest = np.maximum(n - place - 2, 0)
    total = np.concatenate([[0], np.cumsum(rest)])
    low, high = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
    k = 0
    while k < len(e):
        to = max(k + 1, int(np.searchsorted(total, total[k] + PAIRS, "right")) - 1)
        i = np.repeat(np.arange(k, to), rest[k:to])
        j = i + 2 + np.arange(len(i)) - np.repeat(total[k:to] - total[k], rest[k:to])
        apart = (j - i) != (n[i] - 1)  # the last edge ends where the first begins
        meet = apart & (low[i] <= high[j]).all(axis=1) & (low[j] <= high[i]).all(axis=1)
        i, j = i[meet], j[meet]
        ok[ring[i[K._meet(e[i], e[j])]]] = False
        k = to
    return ok


def _one(text: str | None, degrees: bool) -> tuple:
    g = K.parse_wkt(text)
    if g is None:
        return None, False, False, False, 0, None
    valid = K.is_valid(g)
    fixed = g if valid else K.repair(g)
    if fixed is None:
        return None, True, False, False, 0, None
    flat = [[mercator(r) for r in p] for p in fixed] if degrees else fixed
    return K.to_wkb(fixed), True, valid, not valid, K.bad_holes(fixed), float(K.area(flat))


def _bare(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rings without the points that are repeated at once."""
    again = np.append((points[1:] == points[:-1]).all(axis=1), False)
    again[starts[1:] - 1] = False
    lengths = np.add.reduceat(~again, starts[:-1])
    return points[~again], np.concatenate([[0], np.cumsum(lengths)])


def valid_rings(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which closed rings of finite points bound a valid polygon."""
    bare, at = _bare(points, starts)
    lengths = np.diff(at)
    ok = (lengths >= 4) & (ring_areas(points, starts) > 0)
    rows = np.flatnonzero(ok)
    if len(rows):
        ok[rows] = simple_rings(bare[np.repeat(ok, lengths)], np.concatenate([[0], np.cumsum(lengths[rows])]))
    return ok


def _numbers(rings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Points of the texts of rings, and where each ring begins."""
    sizes = np.array([t.count(",") + 1 for t in rings], int)
    return np.fromstring(" ".join(rings).replace(",", " "), sep=" ").reshape(-1, 2), np.concatenate([[0], np.cumsum(sizes)])


def _closed(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which rings are closed and finite."""
    return (points[starts[:-1]] == points[starts[1:] - 1]).all(axis=1) & np.logical_and.reduceat(np.isfinite(points).all(axis=1), starts[:-1])


def _some(points: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.diff(starts)
    return points[np.repeat(which, lengths)], np.concatenate([[0], np.cumsum(lengths[which])])


def _rings(texts: list[str | None], pattern: re.Pattern, n: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(rows that are polygons of n short closed rings; points; where rings begin)."""
    found = [(k, m.groups()) for k, t in enumerate(texts) if t is not None and (m := pattern.fullmatch(t))]
    found = [(k, g) for k, g in found if all(4 <= x.count(",") + 1 <= VERTICES for x in g)]
    if not found:
        return [], np.empty((0, 2)), np.zeros(1, int)
    points, starts = _numbers([x for _, g in found for x in g])
    fine = _closed(points, starts).reshape(-1, n).all(axis=1)
    return [k for (k, _), ok in zip(found, fine.tolist(), strict=True) if ok], *_some(points, starts, np.repeat(fine, n))


def _fixed(geometries: list[K.Geometry], degrees: bool) -> list[tuple]:
    """What becomes of finite geometries that are invalid."""
    out = []
    for g in K.repaired_each(geometries):
        flat = g and [[mercator(r) for r in p] for p in g] if degrees else g
        out.append((None, True, False, False, 0, None) if g is None else (K.to_wkb(g), True, False, True, K.bad_holes(g), float(K.area(flat))))
    return out


def _holes(shells: np.ndarray, at: np.ndarray, holes: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of a shell and a hole, both simple rings without double points: whether the kernels find the polygon valid (1), not (0), or
    must be asked (-1); and whether the hole touches the shell."""
    n, m = np.diff(at) - 1, np.diff(to) - 1
    pair = np.repeat(np.arange(len(n)), n * m)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
    i, j = to[pair] + k // n[pair], at[pair] + k % n[pair]
    x, y = np.hstack([holes[i], holes[i + 1]]), np.hstack([shells[j], shells[j + 1]])
    lx, hx, ly, hy = np.minimum(x[:, :2], x[:, 2:]), np.maximum(x[:, :2], x[:, 2:]), np.minimum(y[:, :2], y[:, 2:]), np.maximum(y[:, :2], y[:, 2:])
    near = ((lx - 1e-9 <= hy + 1e-9) & (ly - 1e-9 <= hx + 1e-9)).all(axis=1)
    met = near & (lx <= hy).all(axis=1) & (ly <= hx).all(axis=1)
    touched = np.zeros(len(n), bool)
    touched[pair[met][K._meet(x[met], y[met])]] = True
    x, y, of = x[near], y[near], pair[near]
    # As kernels._meetings: points where they meet, and edges that run along each other.
    t, u, cross, off = K._crossings(x, y)
    hit = (cross != 0) & (t >= -1e-12) & (t <= 1 + 1e-12) & (u >= -1e-12) & (u <= 1 + 1e-12)
    points = np.round(x[hit, :2] + t[hit, None] * (x[hit, 2:] - x[hit, :2]), 9)
    count = np.bincount(unique_rows(np.column_stack([of[hit], points]))[0][:, 0].astype(int), minlength=len(n))
    along = (cross == 0) & (off == 0)
    for d in (0, 1):
        lo, hi, low, high = lx[near, d], hx[near, d], ly[near, d], hy[near, d]
        along &= np.where((lo == hi) & (low == high), lo == low, np.minimum(hi, high) > np.maximum(lo, low))
    cut = count > 1
    cut[of[along]] = True
    # How many of a hole's vertices its shell holds, by parity.
    p, a, b = holes[i], shells[j], shells[j + 1]
    over = np.flatnonzero((a[:, 1] > p[:, 1]) != (b[:, 1] > p[:, 1]))
    right = over[K._side(a[over], b[over], p[over]) * np.where(a[over, 1] < b[over, 1], 1, -1) > 0]
    parity = np.bincount((np.cumsum(m) - m)[pair[right]] + k[right] // n[pair[right]], minlength=int(m.sum())) % 2
    held = np.add.reduceat(parity, np.cumsum(m) - m)
    inside = held >= m - (count > 0)
    return np.where(cut, 0, np.where(inside, 1, -1)), touched


def _batch(texts: list[str | None], degrees: bool) -> list[tuple]:
    out: list[tuple | None] = [None] * len(texts)
    rows, points, starts = _rings(texts, _PLAIN, 1)
    if rows:
        valid = valid_rings(points, starts)
        areas = ring_areas(mercator(points) if degrees else points, starts)
        data = np.ascontiguousarray(points, "<f8").tobytes()
        ends = (starts * 16).tolist()
        for k in np.flatnonzero(valid).tolist():
            wkb = _HEAD + int(starts[k + 1] - starts[k]).to_bytes(4, "little") + data[ends[k] : ends[k + 1]]
            out[rows[k]] = (wkb, True, True, False, 0, float(areas[k]))
        bad = np.flatnonzero(~valid).tolist()
        for k, told in zip(bad, _fixed([[[points[starts[k] : starts[k + 1]]]] for k in bad], degrees), strict=True):
            out[rows[k]] = told
    rows, points, starts = _rings([t if x is None else None for x, t in zip(out, texts, strict=True)], _HOLED, 2)
    if rows:
        plain = (np.diff(_bare(points, starts)[1]) == np.diff(starts)) & valid_rings(points, starts)
        plain = np.repeat(plain.reshape(-1, 2).all(axis=1), 2)
        rows = [k for k, ok in zip(rows, plain[::2].tolist(), strict=True) if ok]
        points, starts = _some(points, starts, plain)
    if rows:
        shell = np.arange(len(starts) - 1) % 2 == 0
        judged, touched = _holes(*_some(points, starts, shell), *_some(points, starts, ~shell))
        areas = ring_areas(mercator(points) if degrees else points, starts)
        polygons = [[[points[starts[2 * k] : starts[2 * k + 1]], points[starts[2 * k + 1] : starts[2 * k + 2]]]] for k in range(len(rows))]
        for k in np.flatnonzero(judged == 1).tolist():
            out[rows[k]] = (K.to_wkb(polygons[k]), True, True, False, int(touched[k]), float(areas[2 * k] - areas[2 * k + 1]))
        bad = np.flatnonzero(judged == 0).tolist()
        for k, told in zip(bad, _fixed([polygons[k] for k in bad], degrees), strict=True):
            out[rows[k]] = told
    return [_one(t, degrees) if x is None else x for x, t in zip(out, texts, strict=True)]


def valid_each(geometries: list[K.Geometry | None]) -> list[bool]:
    """Validity of each geometry (false for a missing one), polygons of one short ring together."""
    out = [False] * len(geometries)
    one = [k for k, g in enumerate(geometries) if g and len(g) == 1 and len(g[0]) == 1 and 4 <= len(g[0][0]) <= VERTICES and np.isfinite(g[0][0]).all() and (g[0][0][0] == g[0][0][-1]).all()]
    if one:
        rings = [geometries[k][0][0] for k in one]
        valid = valid_rings(np.concatenate(rings), np.concatenate([[0], np.cumsum([len(r) for r in rings])]))
        for k, ok in zip(one, valid.tolist(), strict=True):
            out[k] = ok
    for k in set(range(len(geometries))).difference(one):
        out[k] = K.is_valid(geometries[k])
    return out


def parsed_each(texts: list[str | None]) -> list[bytes | None]:
    """WKB of each WKT text, polygons of one short ring together; None where it can't be parsed."""
    rows, points, starts = _rings(texts, _PLAIN, 1)
    data, ends, held = np.ascontiguousarray(points, "<f8").tobytes(), (starts * 16).tolist(), np.diff(starts).tolist()
    found = {k: _HEAD + held[i].to_bytes(4, "little") + data[ends[i] : ends[i + 1]] for i, k in enumerate(rows)}
    return [found[k] if k in found else K.to_wkb(K.parse_wkt(t)) for k, t in enumerate(texts)]


#: Measures of a WKB: its box, area, perimeter and centroid.
MEASURES = ("minx", "miny", "maxx", "maxy", "area", "perimeter", "cx", "cy")


def _measured(data: list[bytes | None]) -> np.ndarray:
    """MEASURES of each WKB, nan where there is none."""
    rings, of, sign, missing = [], [], [], []
    for k, x in enumerate(data):
        if x is not None and x[:9] == _HEAD and len(x) == 13 + 16 * int.from_bytes(x[9:13], "little") > 13:
            rings.append(x[13:])
            of.append(k)
            sign.append(1.0)
            continue
        g = K.from_wkb(x)
        if g is None:
            missing.append(k)
        for p in g or []:
            for at, r in enumerate(p):
                rings.append(np.ascontiguousarray(r, "<f8").tobytes())
                of.append(k)
                sign.append(-1.0 if at else 1.0)
    out = np.full((len(data), 8), np.nan)
    out[:, 4:6] = 0.0
    if rings:
        p, owner, sign = np.frombuffer(b"".join(rings), "<f8").reshape(-1, 2), np.array(of), np.array(sign)
        ends = np.cumsum([len(r) // 16 for r in rings])
        first = np.concatenate([[0], ends[:-1]])
        base = p[first]
        d = p - np.repeat(base, ends - first, axis=0)
        step = np.diff(p, axis=0, append=p[-1:])
        cross = np.append(d[:-1, 0] * d[1:, 1] - d[1:, 0] * d[:-1, 1], 0.0)
        length = np.sqrt((step * step).sum(axis=1))
        middle = np.vstack([d[:-1] + d[1:], np.zeros((1, 2))])
        cross[ends - 1] = length[ends - 1] = 0.0  # from a ring's end to the next ring
        twice = np.add.reduceat(cross, first)
        area = np.abs(twice) / 2 * sign
        moment = np.add.reduceat(middle * cross[:, None], first) / 6 * (np.where(twice < 0, -1, 1) * sign)[:, None] + base * area[:, None]
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        rows = owner[starts]
        out[rows, :2] = np.minimum.reduceat(np.minimum.reduceat(p, first), starts)
        out[rows, 2:4] = np.maximum.reduceat(np.maximum.reduceat(p, first), starts)
        out[rows, 4], out[rows, 5] = np.add.reduceat(area, starts), np.add.reduceat(np.add.reduceat(length, first), starts)
        whole = out[rows, 4] > 0
        out[rows[whole], 6:] = np.add.reduceat(moment, starts)[whole] / out[rows[whole], 4:5]
    out[missing, 4:6] = np.nan
    return out


def measures(column):
    """Struct of MEASURES of a WKB column; nulls where there is none, and of an empty geometry but for its area and perimeter of 0."""

    def run(data: pa.Array) -> pa.Array:
        found = _measured(data.to_pylist())
        return pa.StructArray.from_arrays([pa.array(c, pa.float64(), mask=np.isnan(c)) for c in found.T], list(MEASURES))

    return F.arrow_udf(run, ", ".join(f"{m} double" for m in MEASURES))(column)


def read_polygons(column, degrees: bool):
    """Struct of FIELDS of a WKT column: WKB (repaired where that was needed), whether the text could be parsed, whether it was
    valid, whether it was repaired, bad holes, and the area (of Web Mercator where the text is in degrees)."""

    def run(texts: pa.Array) -> pa.Array:
        rows = [r for at in range(0, len(texts), ROWS) for r in _batch(texts.slice(at, ROWS).to_pylist(), degrees)]
        kinds = (pa.binary(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int32(), pa.float64())
        columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
        return pa.StructArray.from_arrays(columns, [f.split(" ")[0] for f in FIELDS.split(", ")])

    return F.arrow_udf(run, FIELDS)(column)
