"""Polygon kernels in NumPy, and UDFs over batches of WKB that call them row by row.

A geometry is a list of polygons, a polygon a list of rings (shell first), a ring
an n x 2 array that ends where it starts. Areas of intersections and unions come
from a sweep over vertical slabs: between two neighbouring abscissas of vertices
and crossings no edges cross, so each slab is a stack of trapezoids, and a
trapezoid belongs to a polygon by even-odd parity.
"""

from __future__ import annotations

import math
import re
import struct
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from plinth.functions.arrangement import FINE, REACH, SPAN, Arrangement, near_pairs

Geometry = list[list[np.ndarray]]

#: Segments that distances look at together.
STRETCH = 64
#: Edges and arrangements that are made together.
TOGETHER, MANY = 1 << 14, 512

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_TOKEN = re.compile(rf"\(|\)|,|{_NUMBER}|[A-Za-z]+")


def parse_wkt(text: str | None) -> Geometry | None:
    """POLYGON or MULTIPOLYGON text; None for null, other types and malformed text."""
    if text is None:
        return None
    tokens = _TOKEN.findall(text)
    if re.sub(r"\s", "", text) != "".join(tokens):
        return None
    kind, rest = (tokens[0].upper(), tokens[1:]) if tokens else ("", [])
    if kind not in ("POLYGON", "MULTIPOLYGON"):
        return None
    if [t.upper() for t in rest] == ["EMPTY"]:
        return []
    at = 0

    def nested(depth: int):
        nonlocal at
        if rest[at] != "(":
            raise ValueError
        at += 1
        out = []
        while True:
            if depth:
                out.append(nested(depth - 1))
            else:
                x, y = float(rest[at]), float(rest[at + 1])
                at += 2
                out.append((x, y))
            at += 1
            if rest[at - 1] == ")":
                return out if depth else np.array(out)
            if rest[at - 1] != ",":
                raise ValueError

    try:
        found = nested(1 if kind == "POLYGON" else 2)
    except (ValueError, IndexError):
        return None
    polygons = [found] if kind == "POLYGON" else found
    closed = all(len(r) >= 4 and (r[0] == r[-1]).all() for p in polygons for r in p)
    return polygons if at == len(rest) and closed else None


def to_wkt(g: Geometry | None) -> str | None:
    if g is None:
        return None
    polygons = ["(" + ", ".join("(" + ", ".join(f"{x!r} {y!r}" for x, y in r.tolist()) + ")" for r in p) + ")" for p in g]
    return "POLYGON EMPTY" if not g else f"POLYGON {polygons[0]}" if len(g) == 1 else f"MULTIPOLYGON ({', '.join(polygons)})"


def to_wkb(g: Geometry | None) -> bytes | None:
    """Little-endian WKB; one polygon as Polygon, more as MultiPolygon."""
    if g is None:
        return None

    def polygon(rings) -> bytes:
        return struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + np.ascontiguousarray(r, "<f8").tobytes() for r in rings)

    return polygon(g[0]) if len(g) == 1 else polygon([]) if not g else struct.pack("<BII", 1, 6, len(g)) + b"".join(map(polygon, g))


def from_wkb(data: bytes | bytearray | memoryview | None) -> Geometry | None:
    """Polygon or MultiPolygon; None for null, other types and damaged bytes."""
    if data is None:
        return None
    data, at = bytes(data), 0

    def head() -> tuple[str, int, int]:
        nonlocal at
        order = "<" if data[at] == 1 else ">"
        kind, n = struct.unpack_from(f"{order}II", data, at + 1)
        at += 9
        return order, kind, n

    def rings(order: str, n: int) -> list[np.ndarray]:
        nonlocal at
        out = []
        for _ in range(n):
            (m,) = struct.unpack_from(f"{order}I", data, at)
            out.append(np.frombuffer(data, f"{order}f8", 2 * m, at + 4).reshape(m, 2).astype(np.float64))
            at += 4 + 16 * m
        return out

    try:
        order, kind, n = head()
        if kind == 3:
            found = rings(order, n)
            out = [found] if found else []
        elif kind == 6:
            out = []
            for _ in range(n):
                order, inner, m = head()
                if inner != 3:
                    return None
                out.append(rings(order, m))
        else:
            return None
    except (struct.error, ValueError, IndexError):
        return None
    return out if at == len(data) else None


def segments(g: Geometry) -> np.ndarray:
    """All edges: n x 4 (x1, y1, x2, y2)."""
    rings = [r for p in g for r in p]
    return np.concatenate([np.hstack([r[:-1], r[1:]]) for r in rings]) if rings else np.empty((0, 4))


def _ring_area(r: np.ndarray) -> float:
    d = r - r[0]
    return abs(float((d[:-1, 0] * d[1:, 1] - d[1:, 0] * d[:-1, 1]).sum())) / 2


def area(g: Geometry) -> float:
    return sum(_ring_area(p[0]) - sum(map(_ring_area, p[1:])) for p in g)


def _crossings(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For segments of a and b side by side: parameters t on a and u on b of the lines' crossing, the lines' cross product, and the offset product of parallel ones."""
    r, s, w = a[:, 2:] - a[:, :2], b[:, 2:] - b[:, :2], b[:, :2] - a[:, :2]
    cross = r[:, 0] * s[:, 1] - r[:, 1] * s[:, 0]
    off = w[:, 0] * r[:, 1] - w[:, 1] * r[:, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        return (w[:, 0] * s[:, 1] - w[:, 1] * s[:, 0]) / cross, off / cross, cross, off


def _side(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """On which side of a to b each c lies: 1 left, -1 right, 0 on the line. Exact: what rounding leaves open is decided in fractions."""
    left, right = (a[:, 0] - c[:, 0]) * (b[:, 1] - c[:, 1]), (a[:, 1] - c[:, 1]) * (b[:, 0] - c[:, 0])
    det = left - right
    out = np.sign(det)
    none = ((a[:, 0] == c[:, 0]) | (b[:, 1] == c[:, 1])) & ((a[:, 1] == c[:, 1]) | (b[:, 0] == c[:, 0]))  # both products are 0
    for k in np.flatnonzero((np.abs(det) <= 4e-16 * (np.abs(left) + np.abs(right))) & ~none).tolist():
        (ax, ay), (bx, by), (cx, cy) = (map(Fraction, x[k].tolist()) for x in (a, b, c))
        exact = (ax - cx) * (by - cy) - (ay - cy) * (bx - cx)
        out[k] = (exact > 0) - (exact < 0)
    return out


def _meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether segments of a and b side by side, whose boxes meet, share a point."""
    out = np.zeros(len(a), bool)
    far = _side(a[:, :2], a[:, 2:], b[:, :2]) * _side(a[:, :2], a[:, 2:], b[:, 2:]) <= 0
    a, b = a[far], b[far]
    out[far] = _side(b[:, :2], b[:, 2:], a[:, :2]) * _side(b[:, :2], b[:, 2:], a[:, 2:]) <= 0
    return out


def overlay_areas(geometries: list[Geometry]) -> tuple[float, float]:
    """(area common to all, area covered by any)."""
    edges = [segments(g) for g in geometries]
    owner = np.concatenate([np.full(len(e), k) for k, e in enumerate(edges)]) if edges else np.empty(0, int)
    e = np.concatenate(edges) if edges else np.empty((0, 4))
    if not len(e):
        return 0.0, 0.0
    origin = e[0, :2].copy()
    e = e - np.tile(origin, 2)
    xs = [e[:, 0], e[:, 2]]
    # Where a vertical edge crosses another is among the abscissas, and level edges cross vertical ones only.
    slanted = e[(e[:, 0] != e[:, 2])]
    slanted = slanted if (slanted[:, 1] != slanted[:, 3]).any() else slanted[:0]
    for i, j in near_pairs(slanted) if len(slanted) else ():
        t, u, cross, _ = _crossings(slanted[i], slanted[j])
        hit = (cross != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        xs.append(slanted[i[hit], 0] + t[hit] * (slanted[i[hit], 2] - slanted[i[hit], 0]))
    xs = np.unique(np.concatenate(xs))
    left, right = np.minimum(e[:, 0], e[:, 2]), np.maximum(e[:, 0], e[:, 2])
    slope = np.divide(e[:, 3] - e[:, 1], e[:, 2] - e[:, 0], out=np.zeros(len(e)), where=e[:, 2] != e[:, 0])
    common = union = 0.0
    for x1, x2 in zip(xs[:-1], xs[1:], strict=True):
        on = (left <= x1) & (right >= x2) & (left < right)
        if not on.any():
            continue
        y1 = e[on, 1] + slope[on] * (x1 - e[on, 0])
        y2 = e[on, 1] + slope[on] * (x2 - e[on, 0])
        order = np.argsort(y1 + y2, kind="stable")
        # Of each geometry's edges from below, every other one is left upwards: how many geometries lie above an edge.
        mine = owner[on][order]
        nth = np.argsort(mine, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(mine[nth]) != 0])
        rank = np.empty(len(mine), int)
        rank[nth] = np.arange(len(mine)) - np.repeat(starts, np.diff(np.r_[starts, len(mine)]))
        inside = np.cumsum(1 - 2 * (rank % 2))[:-1]
        mid = (y1 + y2)[order] / 2
        sizes = np.diff(mid) * (x2 - x1)
        common += float(sizes[inside == len(geometries)].sum())
        union += float(sizes[inside > 0].sum())
    return common, union


def intersection_area(a: Geometry, b: Geometry) -> float:
    return overlay_areas([a, b])[0] if a and b else 0.0


def union_area(geometries: list[Geometry]) -> float:
    """Area covered by any; one geometry's own area is taken as it is."""
    some = [g for g in geometries if g]
    return area(some[0]) if len(some) == 1 else overlay_areas(some)[1] if some else 0.0


def contains_point(g: Geometry, x: float, y: float) -> bool:
    """Even-odd, decided exactly; points on the boundary by the half-open rule."""
    e = segments(g)
    at = e[(e[:, 1] > y) != (e[:, 3] > y)]
    up = np.where(at[:, 1] < at[:, 3], 1, -1)
    return bool((_side(at[:, :2], at[:, 2:], np.broadcast_to([x, y], (len(at), 2))) * up > 0).sum() % 2)


def _touch(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether any segment of a meets any of b."""
    return any(_meet(a[i], b[j]).any() for i, j in near_pairs(a, b))


def intersects(a: Geometry, b: Geometry) -> bool:
    """Whether the two share a point, boundaries included."""
    if not a or not b:
        return False
    if _touch(segments(a), segments(b)):
        return True
    return any(contains_point(b, *p[0][0]) for p in a) or any(contains_point(a, *p[0][0]) for p in b)


def _to_segments(points: np.ndarray, e: np.ndarray) -> float:
    """The least distance of points to segments."""
    p, q, d = points[:, None, :], e[None, :, :2], e[None, :, 2:] - e[None, :, :2]
    length = (d * d).sum(axis=2)
    t = np.clip(np.divide(((p - q) * d).sum(axis=2), length, out=np.zeros((len(points), len(e))), where=length > 0), 0, 1)
    gap = q + t[..., None] * d - p
    return float(np.sqrt((gap * gap).sum(axis=2)).min())


def _gap(a: np.ndarray, b: np.ndarray) -> float:
    """The least distance of segments that don't meet: stretches of STRETCH of them, the nearest boxes first, until no box is near enough."""

    def stretches(e: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        parts = [e[k : k + STRETCH] for k in range(0, len(e), STRETCH)]
        return parts, np.array([[*np.minimum(x[:, :2], x[:, 2:]).min(axis=0), *np.maximum(x[:, :2], x[:, 2:]).max(axis=0)] for x in parts])

    (pa, ba), (pb, bb) = stretches(a), stretches(b)
    best = np.inf
    for k in range(0, len(pa), STRETCH):
        box = ba[k : k + STRETCH, None]
        apart = np.maximum(0, np.maximum(box[..., :2] - bb[None, :, 2:], bb[None, :, :2] - box[..., 2:]))
        low = np.sqrt((apart * apart).sum(axis=2))
        for at in np.argsort(low, axis=None):
            i, j = divmod(int(at), len(pb))
            if low[i, j] >= best:
                break
            x, y = pa[k + i], pb[j]
            best = min(best, _to_segments(x[:, :2], y), _to_segments(x[:, 2:], y), _to_segments(y[:, :2], x), _to_segments(y[:, 2:], x))
    return best


def distance(a: Geometry, b: Geometry) -> float:
    """0 if they meet, else the least distance of their edges; nan if one is empty."""
    if not a or not b:
        return float("nan")
    if intersects(a, b):
        return 0.0
    return _gap(segments(a), segments(b))


def _self_crossing(e: np.ndarray, n: int) -> bool:
    """Whether edges of one ring of n edges cross or overlap other than at neighbours' shared points."""
    after = np.roll(e, -1, axis=0)
    back = ((e[:, 2:] - e[:, :2]) * (after[:, 2:] - after[:, :2])).sum(axis=1) < 0
    if back.any() and (_side(e[back, :2], e[back, 2:], after[back, 2:]) == 0).any():
        return True
    for i, j in near_pairs(e):
        step = (j - i) % n
        apart = (step > 1) & (step < n - 1)
        if _meet(e[i[apart]], e[j[apart]]).any():
            return True
    return False


def _meetings(a: np.ndarray, b: np.ndarray) -> tuple[set[tuple[float, float]], bool]:
    """(points where segments of a meet segments of b; whether any two run along each other)."""
    found: set[tuple[float, float]] = set()
    for i, j in near_pairs(a, b, margin=1e-9):
        x, y = a[i], b[j]
        t, u, cross, off = _crossings(x, y)
        hit = (cross != 0) & (t >= -1e-12) & (t <= 1 + 1e-12) & (u >= -1e-12) & (u <= 1 + 1e-12)
        found.update(map(tuple, np.round(x[hit, :2] + t[hit, None] * (x[hit, 2:] - x[hit, :2]), 9).tolist()))
        along = (cross == 0) & (off == 0)
        for d in (0, 1):
            lo, hi = np.minimum(x[:, d], x[:, d + 2]), np.maximum(x[:, d], x[:, d + 2])
            low, high = np.minimum(y[:, d], y[:, d + 2]), np.maximum(y[:, d], y[:, d + 2])
            flat = (lo == hi) & (low == high)
            along &= np.where(flat, lo == low, np.minimum(hi, high) > np.maximum(lo, low))
        if along.any():
            return found, True
    return found, False


def _edges(r: np.ndarray) -> np.ndarray:
    e = np.hstack([r[:-1], r[1:]])
    return e[(e[:, :2] != e[:, 2:]).any(axis=1)]


def _ring_ok(r: np.ndarray) -> bool:
    e = _edges(r)
    return bool(len(r) >= 4 and (r[0] == r[-1]).all() and np.isfinite(r).all() and len(e) >= 3 and not _self_crossing(e, len(e)) and _ring_area(r) > 0)


def _connected_inside(rings: list[np.ndarray]) -> bool:
    """Whether no two rings run along each other, and the points where rings meet form no cycle that cuts the inside in two."""
    root = list(range(len(rings)))

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    at: dict[tuple[float, float], set[int]] = {}
    for i in range(len(rings)):
        for j in range(i):
            points, along = _meetings(_edges(rings[i]), _edges(rings[j]))
            if along or len(points) > 1:
                return False
            for x in points:
                at.setdefault(x, set()).update((i, j))
    for together in at.values():
        first, *others = sorted(together)
        for k in others:
            if find(first) == find(k):
                return False
            root[find(k)] = find(first)
    return True


def is_valid(g: Geometry | None) -> bool:
    """Rings closed, of four points or more and simple; holes within their shell, apart, and leaving its inside connected; polygons that don't overlap."""
    if g is None:
        return False
    for p in g:
        if not all(map(_ring_ok, p)) or not _connected_inside(p):
            return False
        shell = [[p[0]]]
        for k, hole in enumerate(p[1:], start=1):
            inner = [[hole]]
            if abs(intersection_area(shell, inner) - _ring_area(hole)) > 1e-9 * max(1.0, _ring_area(hole)):
                return False
            if any(intersection_area(inner, [[h]]) > 1e-9 for h in p[k + 1 :]):
                return False
    for i in range(len(g)):
        for j in range(i):
            if intersection_area([g[i]], [g[j]]) > 1e-9 or _meetings(segments([g[i]]), segments([g[j]]))[1]:
                return False
    return True


def bad_holes(g: Geometry | None, polygons_only: bool = True) -> int:
    """Holes that aren't rings or that touch or cross their shell. ``polygons_only``: MultiPolygons count none."""
    if not g or (polygons_only and len(g) > 1):
        return 0
    count = 0
    for p in g:
        shell = np.hstack([p[0][:-1], p[0][1:]])
        for hole in p[1:]:
            e = np.hstack([hole[:-1], hole[1:]])
            ring = len(hole) >= 4 and (hole[0] == hole[-1]).all() and not _self_crossing(e, len(e))
            count += not ring or _touch(e, shell)
    return count


def _edges_of(g: Geometry) -> np.ndarray:
    e = segments(g)
    return e[(e[:, :2] != e[:, 2:]).any(axis=1)]


def _dissolved(geometries: list[Geometry]) -> Geometry | None:
    return _dissolved_each([geometries])[0]


def _dissolved_each(lists: list[list[Geometry]]) -> list[Geometry | None]:
    """What the geometries of each list cover (points of odd parity of each), many lists in one arrangement; None where nothing is."""
    out: list[Geometry | None] = [None] * len(lists)
    held: list[tuple[int, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        if not held:
            return
        edges, owner = (np.concatenate([x[k] for x in held]) for k in (1, 2))
        group = np.repeat(np.arange(len(held)), [len(x[1]) for x in held])
        try:
            found = Arrangement(edges, owner, group).polygons()
        except ArithmeticError:
            if len(held) == 1:
                raise
            found = [Arrangement(e, o).polygons()[0] for _, e, o in held]
        for (k, _, _), g in zip(held, found, strict=True):
            out[k] = g or None
        held.clear()

    n, widest = 0, 0.0
    for k, geometries in enumerate(lists):
        edges = [_edges_of(g) for g in geometries]
        sizes = [len(e) for e in edges]
        if not sum(sizes):
            continue
        e = np.concatenate(edges)
        # Pixels that the group is wide; a pixel is at least 2 ** -SPAN of it.
        extent, largest = float(np.ptp(e[:, ::2])), float(np.abs(e).max())
        width = min(2.0 ** (SPAN + 1), extent / 2.0 ** max(math.frexp(largest)[1] - FINE, -1000) if largest else 1.0)
        if held and (n + len(e) > TOGETHER or len(held) >= MANY or (len(held) + 1) * 2 * (max(widest, width) + 2) > REACH):
            flush()
            n, widest = 0, 0.0
        held.append((k, e, np.repeat(np.arange(len(edges)), sizes)))
        n, widest = n + len(e), max(widest, width)
    flush()
    return out


def repair(g: Geometry | None) -> Geometry | None:
    """A valid geometry that covers the points of odd parity; None if nothing is left or a coordinate isn't finite. Points within rounding of each other become one."""
    if g is None or is_valid(g):
        return g
    return _dissolved([g]) if all(np.isfinite(r).all() for p in g for r in p) else None


def repaired_each(geometries: list[Geometry]) -> list[Geometry | None]:
    """``repair`` of geometries that are known to be invalid and finite."""
    return _dissolved_each([[g] for g in geometries])


def unions(lists: list[list[Geometry]]) -> list[Geometry | None]:
    """``union`` of each list."""
    some = [[g for g in gs if g] for gs in lists]
    out = [gs[0] if len(gs) == 1 else None for gs in some]
    more = [k for k, gs in enumerate(some) if len(gs) > 1]
    for k, g in zip(more, _dissolved_each([some[k] for k in more]), strict=True):
        out[k] = g
    return out


def union(geometries: list[Geometry]) -> Geometry | None:
    """One geometry that covers what any of them covers; None if nothing is covered. One geometry is taken as it is."""
    some = [g for g in geometries if g]
    return some[0] if len(some) == 1 else _dissolved(some) if some else None


def clip(g: Geometry, minx: float, miny: float, maxx: float, maxy: float) -> Geometry:
    """The part of a geometry within a box, for measuring areas: rings may run back and forth along the box."""

    def cut(r: np.ndarray, axis: int, edge: float, sign: int) -> np.ndarray:
        side = sign * (r[:, axis] - edge)
        out = []
        for k in range(len(r) - 1):
            if side[k] >= 0:
                out.append(r[k])
            if side[k] * side[k + 1] < 0:
                at = r[k] + side[k] / (side[k] - side[k + 1]) * (r[k + 1] - r[k])
                at[axis] = edge
                out.append(at)
        return np.array([*out, out[0]]) if len(out) >= 3 else np.empty((0, 2))

    polygons = []
    for p in g:
        rings = []
        for r in p:
            for axis, edge, sign in ((0, minx, 1), (0, maxx, -1), (1, miny, 1), (1, maxy, -1)):
                r = cut(r, axis, edge, sign) if len(r) else r
            rings.append(r)
        if len(rings[0]):
            polygons.append([r for r in rings if len(r)])
    return polygons


def _udf(kind: str, f, *, nulls=None):
    """A UDF over batches of WKB columns, a row at a time; ``nulls`` where a geometry is missing."""

    def one(*values):
        found = [from_wkb(v) for v in values]
        return nulls if any(x is None for x in found) else f(*found)

    # The number of arguments tells pandas_udf what it gets.
    if f.__code__.co_argcount == 1:

        def run1(a: pd.Series) -> pd.Series:
            return a.map(one)

        return F.pandas_udf(run1, kind)

    def run2(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

    return F.pandas_udf(run2, kind)


def _nested(g: Geometry):
    return [[[{"x": x, "y": y} for x, y in r.tolist()] for r in p] for p in g]


def wkt_to_wkb(column):
    """Parse WKT; null where it can't be."""

    def run(s: pd.Series) -> pd.Series:
        from plinth.functions.ragged import parsed_each

        return pd.Series(parsed_each(s.tolist()), dtype=object)

    return F.pandas_udf(run, "binary")(column)


def wkb_to_wkt(column):
    return _udf("string", to_wkt)(column)


def wkb_to_geometry(column):
    """WKB to the nested arrays that ``plinth.functions.geometry`` measures."""

    def run(batches):
        for s in batches:
            yield pd.Series([None if (g := from_wkb(x)) is None else _nested(g) for x in s])

    from collections.abc import Iterator

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<array<array<struct<x:double,y:double>>>>")(column)


def st_is_valid(column):
    """Validity; false for null."""

    def run(s: pd.Series) -> pd.Series:
        from plinth.functions.ragged import valid_each

        return pd.Series(valid_each([from_wkb(x) for x in s]), dtype=bool)

    return F.pandas_udf(run, "boolean")(column)


def st_repair(column):
    def repaired(g):
        return to_wkb(repair(g))

    return _udf("binary", repaired)(column)


def st_bad_holes(column, polygons_only: bool = True):
    def holes(g):
        return bad_holes(g, polygons_only)

    return F.coalesce(_udf("int", holes)(column), F.lit(0))


def st_intersects(a, b):
    return _udf("boolean", intersects)(a, b)


def st_intersection_area(a, b):
    return _udf("double", intersection_area)(a, b)


def st_union_area(column):
    """Of an array of WKB: the area covered by any; null if none is left."""

    def run(s: pd.Series) -> pd.Series:
        found = ([g for x in (xs if xs is not None else []) if (g := from_wkb(x))] for xs in s)
        return pd.Series([union_area(gs) if gs else None for gs in found], dtype="float64")

    return F.pandas_udf(run, "double")(column)


def st_union(column):
    """Of an array of WKB: one WKB that covers what any covers; null if none is left."""

    def run(s: pd.Series) -> pd.Series:
        found = [[g for x in (xs if xs is not None else []) if (g := from_wkb(x))] for xs in s]
        return pd.Series([to_wkb(g) for g in unions(found)], dtype=object)

    return F.pandas_udf(run, "binary")(column)


def st_clip(column, cx, cy, size):
    """The part of a WKB in the grid cell (cx, cy) of cells of a size (a column); null if nothing of it is there."""

    def run(a: pd.Series, x: pd.Series, y: pd.Series, w: pd.Series) -> pd.Series:
        out = []
        for data, i, j, d in zip(a, x, y, w, strict=True):
            g = from_wkb(data)
            part = clip(g, i * d, j * d, (i + 1) * d, (j + 1) * d) if g else None
            out.append(to_wkb(part) if part else None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "binary")(column, cx, cy, size)


def st_pair_measures(a, b):
    """Struct (dist, inter) of two WKB: their distance and the area they share, from one parse."""

    def run(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(left, right, strict=True):
            g, h = from_wkb(x), from_wkb(y)
            d = distance(g, h) if g is not None and h is not None else None
            out.append((d, None if d is None else intersection_area(g, h) if d == 0 else 0.0))
        return pd.DataFrame(out, columns=["dist", "inter"], dtype="float64")

    return F.pandas_udf(run, "dist double, inter double")(a, b)


def geometry_to_wkb(column):
    """The nested arrays that ``plinth.functions.geometry`` measures, as WKB."""

    def run(a: pa.Array) -> pa.Array:
        found = a.to_pylist()
        return pa.array([None if g is None else to_wkb([[np.array([(p["x"], p["y"]) for p in r]) for r in polygon] for polygon in g]) for g in found], pa.binary())

    return F.arrow_udf(run, "binary")(column)
