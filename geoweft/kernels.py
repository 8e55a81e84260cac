"""Planar geometry in numpy.

A geometry is a list of parts, a part a list of (n, 2) arrays: rings of a polygon (closed, shell
first) or one path.  Polygon set operations cut the plane into vertical slabs between all vertices
and crossings, decide inside and outside slab by slab, and put the boundary together again; slabs
have no degenerate cases, so touching and overlapping edges need no special care.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd

Geometry = list[list[np.ndarray]]
EPS = 1e-9


def to_numpy(geom) -> Geometry:
    """Nested rows, dicts or pairs as arrays."""
    out = []
    for part in [] if geom is None else geom:
        rings = []
        for ring in part:
            pts = [(p["x"], p["y"]) if isinstance(p, dict) or hasattr(p, "asDict") else (p[0], p[1]) for p in ring]
            rings.append(np.array(pts, float).reshape(-1, 2))
        out.append(rings)
    return out


def from_numpy(geom: Geometry):
    return [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in part] for part in geom]


def geometry_bounds(geom: Geometry):
    p = np.concatenate([r for part in geom for r in part])
    return p.min(axis=0), p.max(axis=0)


def ring_area(ring: np.ndarray) -> float:
    """Signed; counter-clockwise is positive."""
    if len(ring) < 3:
        return 0.0
    q = ring - ring[0]
    return float((q[:-1, 0] * q[1:, 1] - q[1:, 0] * q[:-1, 1]).sum() / 2 + (q[-1, 0] * q[0, 1] - q[0, 0] * q[-1, 1]) / 2)


def area(geom: Geometry) -> float:
    return sum(abs(ring_area(p[0])) - sum(abs(ring_area(h)) for h in p[1:]) for p in geom if p)


def path_length(path: np.ndarray) -> float:
    return float(np.hypot(*np.diff(path, axis=0).T).sum()) if len(path) > 1 else 0.0


def is_polygon(geom: Geometry) -> bool:
    return bool(geom) and all(len(p) and len(p[0]) > 3 and np.allclose(p[0][0], p[0][-1]) for p in geom)


def close(ring) -> np.ndarray:
    ring = np.asarray(ring, float)
    return ring if len(ring) and np.array_equal(ring[0], ring[-1]) else np.concatenate([ring, ring[:1]])


def contains(geom: Geometry, pts: np.ndarray, boundary: bool = True) -> np.ndarray:
    """Even-odd test of points."""
    inside, on = np.zeros(len(pts), bool), np.zeros(len(pts), bool)
    x, y = pts[:, 0], pts[:, 1]
    for part in geom:
        for ring in part:
            for (x0, y0), (x1, y1) in zip(ring[:-1], ring[1:]):
                if y0 != y1:
                    inside ^= ((y0 <= y) != (y1 <= y)) & (x < x0 + (y - y0) * (x1 - x0) / (y1 - y0))
                cross = (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
                on |= (np.abs(cross) <= EPS * max(1.0, abs(x1 - x0) + abs(y1 - y0))) & (x >= min(x0, x1) - EPS) & (x <= max(x0, x1) + EPS) & (y >= min(y0, y1) - EPS) & (y <= max(y0, y1) + EPS)
    return inside | on if boundary else inside & ~on


def trapezoids(geom: Geometry) -> np.ndarray:
    """Rows y0, y1 and the left and right x at both: the polygon cut at the heights of its vertices."""
    edges = np.concatenate([np.column_stack([r[:-1], r[1:]]) for part in geom for r in part if len(r) > 1] or [np.empty((0, 4))])
    edges = edges[edges[:, 1] != edges[:, 3]]
    flip = edges[:, 1] > edges[:, 3]
    edges[flip] = edges[flip][:, [2, 3, 0, 1]]
    heights, out = np.unique(edges[:, [1, 3]]), []
    for low, high in zip(heights[:-1], heights[1:]):
        e = edges[(edges[:, 1] <= low) & (edges[:, 3] >= high)]
        slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
        at = np.column_stack([e[:, 0] + slope * (low - e[:, 1]), e[:, 0] + slope * (high - e[:, 1])])
        at = at[np.argsort(at.sum(axis=1), kind="stable")]
        out += [(low, high, l[0], l[1], r[0], r[1]) for l, r in zip(at[::2], at[1::2])]
    return np.array(out, float).reshape(-1, 6)


def random_points(geom: Geometry, rng: np.random.Generator, n: int) -> np.ndarray:
    """``n`` uniform points of a polygon; none where it has no area."""
    t = trapezoids(geom)
    bottom, top = t[:, 4] - t[:, 2], t[:, 5] - t[:, 3]
    size = np.maximum((bottom + top) * (t[:, 1] - t[:, 0]), 0)
    if not size.sum():
        return np.empty((0, 2))
    k = rng.choice(len(t), n, p=size / size.sum())
    t, bottom, top, u, v = t[k], bottom[k], top[k], rng.random(n), rng.random(n)
    # height: the share of the area below it is u
    h = u * (bottom + top) / (bottom + np.sqrt(bottom**2 + u * (top**2 - bottom**2)))
    left, right = t[:, 2] + h * (t[:, 3] - t[:, 2]), t[:, 4] + h * (t[:, 5] - t[:, 4])
    return np.column_stack([left + v * (right - left), t[:, 0] + h * (t[:, 1] - t[:, 0])])


def contains_column(region):
    """A function of two columns: whether the place lies in ``region``."""
    from pyspark.sql import functions as F

    geom = to_numpy(region)

    @F.pandas_udf("boolean")
    def inside(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(contains(geom, np.stack([x.to_numpy(float), y.to_numpy(float)], axis=1)))

    return inside


# ---- hulls and bounding shapes


def convex_hull(pts: np.ndarray) -> np.ndarray:
    """Closed counter-clockwise ring, by monotone chains."""
    p = np.unique(np.asarray(pts, float), axis=0)
    if len(p) < 3:
        return close(p) if len(p) else p

    def chain(points):
        out = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    lower, upper = chain(p.tolist()), chain(p[::-1].tolist())
    return close(np.array(lower[:-1] + upper[:-1]))


def hull_candidates(df, x="x", y="y") -> np.ndarray:
    """Points of the hulls of all partitions: a superset of the hull's vertices, whatever the table's size."""
    from pyspark.sql import functions as F

    def run(batches):
        got = np.empty((0, 2))
        for pdf in batches:
            got = convex_hull(np.concatenate([got, pdf[[x, y]].dropna().to_numpy(float)]))
        yield pd.DataFrame(got, columns=["x", "y"])

    return df.select(F.col(x).cast("double").alias(x), F.col(y).cast("double").alias(y)).mapInPandas(run, "x double, y double").toPandas().to_numpy(float)


def bounding_circle(pts: np.ndarray) -> tuple[float, float, float]:
    """Welzl's smallest circle over the hull, in a fixed random order."""
    p = convex_hull(pts)[:-1] if len(pts) > 2 else np.unique(pts, axis=0)
    p = p[np.random.default_rng(0).permutation(len(p))]

    def two(a, b):
        return (a[0] + b[0]) / 2, (a[1] + b[1]) / 2, math.hypot(a[0] - b[0], a[1] - b[1]) / 2

    def three(a, b, c):
        d = 2 * (a[0] * (b[1] - c[1]) + b[0] * (c[1] - a[1]) + c[0] * (a[1] - b[1]))
        if abs(d) < 1e-14:
            return max((two(a, b), two(a, c), two(b, c)), key=lambda t: t[2])
        q = [v[0] ** 2 + v[1] ** 2 for v in (a, b, c)]
        ux = (q[0] * (b[1] - c[1]) + q[1] * (c[1] - a[1]) + q[2] * (a[1] - b[1])) / d
        uy = (q[0] * (c[0] - b[0]) + q[1] * (a[0] - c[0]) + q[2] * (b[0] - a[0])) / d
        return ux, uy, math.hypot(a[0] - ux, a[1] - uy)

    out = lambda c, q: math.hypot(q[0] - c[0], q[1] - c[1]) > c[2] * (1 + 1e-12) + 1e-12
    c = (float(p[0][0]), float(p[0][1]), 0.0)
    for i in range(1, len(p)):
        if out(c, p[i]):
            c = (float(p[i][0]), float(p[i][1]), 0.0)
            for j in range(i):
                if out(c, p[j]):
                    c = two(p[i], p[j])
                    for k in range(j):
                        if out(c, p[k]):
                            c = three(p[i], p[j], p[k])
    return c


def circle_ring(x: float, y: float, r: float, segments: int = 96) -> np.ndarray:
    t = np.arange(segments + 1) % segments * (2 * math.pi / segments)
    return np.stack([x + r * np.cos(t), y + r * np.sin(t)], axis=1)


def minimum_rectangle(pts: np.ndarray) -> np.ndarray:
    """Smallest-area rotated rectangle: one of its sides lies on the hull."""
    h = convex_hull(pts)
    if len(h) < 4:
        return h
    best = None
    for e in np.diff(h, axis=0):
        u = e / np.hypot(*e)
        v = np.array([-u[1], u[0]])
        a, b = h @ u, h @ v
        s = (a.max() - a.min()) * (b.max() - b.min())
        if best is None or s < best[0] - 1e-12:
            best = (s, [u * i + v * j for i, j in ((a.min(), b.min()), (a.max(), b.min()), (a.max(), b.max()), (a.min(), b.max()))])
    return close(np.array(best[1]))


def octagon(pts: np.ndarray) -> np.ndarray:
    """Hull of the box cut by the diagonal extremes."""
    x, y, s, d = pts[:, 0], pts[:, 1], pts.sum(axis=1), pts[:, 0] - pts[:, 1]
    x0, x1, y0, y1, s0, s1, d0, d1 = x.min(), x.max(), y.min(), y.max(), s.min(), s.max(), d.min(), d.max()
    return convex_hull(np.array([(x0, s0 - x0), (s0 - y0, y0), (d1 + y0, y0), (x1, x1 - d1), (x1, s1 - x1), (s1 - y1, y1), (d0 + y1, y1), (x0, x0 - d0)]))


def distance_to_boundary(geom: Geometry, p: np.ndarray) -> np.ndarray:
    best = np.full(len(p), np.inf)
    for part in geom:
        for ring in part:
            for a, b in zip(ring[:-1], ring[1:]):
                best = np.minimum(best, segment_distance(p, a, b))
            if len(ring) == 1:
                best = np.minimum(best, np.hypot(*(p - ring[0]).T))
    return best


def segment_distance(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = b - a
    n = d @ d
    t = np.clip((p - a) @ d / n, 0, 1) if n else np.zeros(len(p))
    return np.hypot(*(p - (a + t[:, None] * d)).T)


def _segments(geom: Geometry) -> np.ndarray:
    return np.concatenate([np.column_stack([r[:-1], r[1:]]) for part in geom for r in part if len(r) > 1] or [np.empty((0, 4))])


def contact(a: Geometry, b: Geometry) -> tuple[bool, float]:
    """Whether two boundaries meet, and the length they have in common."""
    p, q = _segments(a), _segments(b)
    if not len(p) or not len(q):
        return False, 0.0
    near = 1e-9 * max(1.0, float(np.abs(p).max()), float(np.abs(q).max()))
    low, high = np.minimum(q[:, :2], q[:, 2:]).min(axis=0) - near, np.maximum(q[:, :2], q[:, 2:]).max(axis=0) + near
    p = p[(np.maximum(p[:, :2], p[:, 2:]) >= low).all(axis=1) & (np.minimum(p[:, :2], p[:, 2:]) <= high).all(axis=1)]
    met, common = False, 0.0
    for x0, y0, x1, y1 in p.tolist():
        dx, dy = x1 - x0, y1 - y0
        size = math.hypot(dx, dy)
        if not size:
            continue
        # b's ends along and beside the segment of a
        along = ((q[:, 0::2] - x0) * dx + (q[:, 1::2] - y0) * dy) / size
        beside = ((q[:, 1::2] - y0) * dx - (q[:, 0::2] - x0) * dy) / size
        inside = np.minimum(along.max(axis=1), size) - np.maximum(along.min(axis=1), 0)
        flat = (np.abs(beside) <= near).all(axis=1)
        common += float(np.maximum(inside[flat], 0).sum())
        met = met or bool((flat & (inside >= -near)).any())
        other = ~flat & (beside.min(axis=1) <= near) & (beside.max(axis=1) >= -near)
        if not met and other.any():
            t = beside[other, 0] / (beside[other, 0] - beside[other, 1])
            cut = along[other, 0] + np.clip(t, 0, 1) * (along[other, 1] - along[other, 0])
            met = bool(((cut >= -near) & (cut <= size + near)).any())
    return met or common > near, common if common > near else 0.0


def inscribed_circle(geom: Geometry, tolerance: float = 1.0) -> tuple[float, float, float]:
    """Pole of inaccessibility by halving cells."""
    lo, hi = geometry_bounds(geom)
    size = float(min(hi - lo)) or 1.0
    tolerance = min(tolerance, size / 100)
    g = [np.arange(lo[i] + size / 2, hi[i] + size / 2, size) for i in (0, 1)]
    cells, h = np.array([(a, b) for a in g[0] for b in g[1]]), size / 2
    best = (float(cells[0][0]), float(cells[0][1]), -1.0)
    while len(cells):
        d = distance_to_boundary(geom, cells) * np.where(contains(geom, cells), 1, -1)
        i = int(d.argmax())
        if d[i] > best[2]:
            best = (float(cells[i][0]), float(cells[i][1]), float(d[i]))
        cells = cells[d + h * math.sqrt(2) > best[2] + tolerance]
        h /= 2
        cells = np.concatenate([cells + (sx * h, sy * h) for sx in (-1, 1) for sy in (-1, 1)]) if len(cells) else cells
    return best


def inscribed_rectangle(geom: Geometry, rotate: bool = False, n: int = 40) -> np.ndarray:
    """Largest rectangle of cells on an n x n mask, optionally in the frame of the minimum rectangle."""
    frame = np.eye(2)
    if rotate:
        r = minimum_rectangle(np.concatenate([q for p in geom for q in p]))
        u = (r[1] - r[0]) / max(1e-300, np.hypot(*(r[1] - r[0])))
        frame = np.array([u, [-u[1], u[0]]]).T
    g = [[q @ frame for q in p] for p in geom]
    lo, hi = geometry_bounds(g)
    step = (hi - lo) / n
    c = np.array([(lo[0] + (i + 0.5) * step[0], lo[1] + (j + 0.5) * step[1]) for j in range(n) for i in range(n)])
    mask = contains(g, c).reshape(n, n)
    best, height = (0, 0, 0, 0, 0), np.zeros(n, int)
    for j in range(n):
        height = np.where(mask[j], height + 1, 0)
        for i in range(n):
            low = n + 1
            for k in range(i, n):
                low = min(low, int(height[k]))
                if not low:
                    break
                if low * (k - i + 1) > best[0]:
                    best = (low * (k - i + 1), i, k + 1, j + 1 - low, j + 1)
    x0, x1, y0, y1 = lo[0] + best[1] * step[0], lo[0] + best[2] * step[0], lo[1] + best[3] * step[1], lo[1] + best[4] * step[1]
    return np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]) @ frame.T


def interior_point(geom: Geometry) -> tuple[float, float]:
    """Middle of the widest inside run of the horizontal line through the box's middle."""
    lo, hi = geometry_bounds(geom)
    best = None
    for f in (0.5, 0.37, 0.63, 0.21, 0.79):
        y, xs = lo[1] + f * (hi[1] - lo[1]), []
        for part in geom:
            for ring in part:
                for (x0, y0), (x1, y1) in zip(ring[:-1], ring[1:]):
                    if (y0 <= y) != (y1 <= y):
                        xs.append(x0 + (y - y0) * (x1 - x0) / (y1 - y0))
        xs.sort()
        for a, b in zip(xs[::2], xs[1::2]):
            if best is None or b - a > best[0] + EPS:
                best = (b - a, (a + b) / 2, y)
        if best:
            return float(best[1]), float(best[2])
    return tuple(map(float, geom[0][0].mean(axis=0)))


# ---- lines


def simplify(path: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker; a closed ring keeps at least four points."""
    n = len(path)
    if n < 3:
        return path
    keep = np.zeros(n, bool)
    keep[[0, -1]] = True
    closed = np.array_equal(path[0], path[-1])
    todo = [(0, n - 1)]
    if closed:
        far = int(np.hypot(*(path - path[0]).T).argmax())
        keep[far] = True
        todo = [(0, far), (far, n - 1)]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        d = segment_distance(path[a + 1 : b], path[a], path[b])
        i = int(d.argmax())
        if d[i] > tolerance:
            keep[a + 1 + i] = True
            todo += [(a, a + 1 + i), (a + 1 + i, b)]
    out = path[keep]
    return path if closed and len(out) < 4 else out


def densify(path: np.ndarray, step: float) -> np.ndarray:
    out = [path[:1]]
    for a, b in zip(path[:-1], path[1:]):
        n = max(1, math.ceil(math.hypot(*(b - a)) / step - 1e-12))
        out.append(a + (b - a) * (np.arange(1, n + 1) / n)[:, None])
    return np.concatenate(out)


def smooth(path: np.ndarray, fit: float = 0.3, steps: int = 8) -> np.ndarray:
    """Cubic Bezier through the vertices with handles of ``fit`` times the segment."""
    n = len(path)
    if n < 3:
        return path
    closed = np.array_equal(path[0], path[-1])
    q = path[:-1] if closed else path
    prev, nxt = np.roll(q, 1, axis=0), np.roll(q, -1, axis=0)
    if not closed:
        prev[0], nxt[-1] = q[0], q[-1]
    tangent = nxt - prev
    tangent = tangent / np.maximum(np.hypot(*tangent.T), 1e-300)[:, None]
    t = (np.arange(1, steps + 1) / steps)[:, None]
    out = [q[:1]]
    for i in range(len(q) if closed else len(q) - 1):
        a, b = q[i], q[(i + 1) % len(q)]
        d = math.hypot(*(b - a)) * fit
        c1, c2 = a + tangent[i] * d, b - tangent[(i + 1) % len(q)] * d
        out.append((1 - t) ** 3 * a + 3 * (1 - t) ** 2 * t * c1 + 3 * (1 - t) * t**2 * c2 + t**3 * b)
    return np.concatenate(out)


def cumulative(path: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.hypot(*np.diff(path, axis=0).T))]) if len(path) > 1 else np.zeros(1)


def along(path: np.ndarray, d: np.ndarray) -> np.ndarray:
    c = cumulative(path)
    return np.stack([np.interp(d, c, path[:, k]) for k in (0, 1)], axis=1)


def substring(path: np.ndarray, a: float, b: float) -> np.ndarray:
    c = cumulative(path)
    mid = path[(c > a + EPS) & (c < b - EPS)]
    return np.concatenate([along(path, np.array([a])), mid, along(path, np.array([b]))])


def locate(path: np.ndarray, p: np.ndarray) -> tuple[float, float]:
    """(distance along, distance off) of the nearest place."""
    c, best = cumulative(path), (0.0, math.inf)
    for i, (a, b) in enumerate(zip(path[:-1], path[1:])):
        d = b - a
        n = d @ d
        t = min(1.0, max(0.0, float((p - a) @ d / n))) if n else 0.0
        off = math.hypot(*(p - (a + t * d)))
        if off < best[1] - 1e-15:
            best = (float(c[i] + t * math.sqrt(n)), off)
    return best


def crossings(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Points shared by two paths; for overlaps, the ends of the common piece."""
    out = []
    for p0, p1 in zip(a[:-1], a[1:]):
        u = p1 - p0
        for q0, q1 in zip(b[:-1], b[1:]):
            v, w = q1 - q0, q0 - p0
            den = u[0] * v[1] - u[1] * v[0]
            if abs(den) > 1e-14 * (np.abs(u).sum() * np.abs(v).sum() + 1e-300):
                t, s = (w[0] * v[1] - w[1] * v[0]) / den, (w[0] * u[1] - w[1] * u[0]) / den
                if -1e-12 <= t <= 1 + 1e-12 and -1e-12 <= s <= 1 + 1e-12:
                    out.append(p0 + t * u)
            elif abs(w[0] * u[1] - w[1] * u[0]) <= EPS * (np.abs(u).sum() + 1):
                n = u @ u
                if n:
                    s0, s1 = sorted(((q0 - p0) @ u / n, (q1 - p0) @ u / n))
                    if max(s0, 0) <= min(s1, 1):
                        out += [p0 + max(s0, 0) * u, p0 + min(s1, 1) * u]
    return np.unique(np.round(np.array(out).reshape(-1, 2), 9), axis=0)


def clip_path(path: np.ndarray, geom: Geometry, inside: bool = True) -> list[np.ndarray]:
    """Pieces of the path inside (or outside) a polygon."""
    cuts = [0.0, path_length(path)]
    for part in geom:
        for ring in part:
            cuts += [locate(path, p)[0] for p in crossings(path, ring)]
    cuts, out = sorted(cuts), []
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a > EPS and contains(geom, along(path, np.array([(a + b) / 2])))[0] == inside:
            piece = substring(path, a, b)
            if out and np.allclose(out[-1][-1], piece[0]):
                out[-1] = np.concatenate([out[-1], piece[1:]])
            else:
                out.append(piece)
    return out


# ---- polygon set operations


def _edges(geom: Geometry, owner: int) -> list[tuple[float, float, float, float, int]]:
    out = []
    for part in geom:
        for ring in part:
            for (x0, y0), (x1, y1) in zip(ring[:-1].tolist(), ring[1:].tolist()):
                if x0 != x1:
                    out.append((x0, y0, x1, y1, owner) if x0 < x1 else (x1, y1, x0, y0, owner))
    return out


def boolean(first: list[Geometry], second: list[Geometry], keep) -> Geometry:
    """Area where keep(in any of first, in any of second)."""
    edges = [e for k, g in enumerate([*first, *second]) for e in _edges(g, k)]
    if not edges:
        return []
    split, E = len(first), np.array([e[:4] for e in edges])
    owner = np.array([e[4] for e in edges])
    xs = set(E[:, 0].tolist()) | set(E[:, 2].tolist())
    slope = (E[:, 3] - E[:, 1]) / (E[:, 2] - E[:, 0])
    for i in range(len(E)):  # crossings of edges that overlap in x
        j = np.arange(i + 1, len(E))
        j = j[(E[j, 0] < E[i, 2]) & (E[j, 2] > E[i, 0]) & (slope[j] != slope[i])]
        if len(j):
            x = (E[j, 1] - slope[j] * E[j, 0] - E[i, 1] + slope[i] * E[i, 0]) / (slope[i] - slope[j])
            ok = (x > np.maximum(E[j, 0], E[i, 0])) & (x < np.minimum(E[j, 2], E[i, 2]))
            xs.update(x[ok].tolist())
    width = max(xs) - min(xs)
    grid = [min(xs)]
    for x in sorted(xs)[1:]:
        if x - grid[-1] > 1e-11 * max(1.0, width):
            grid.append(x)
    segments: dict[tuple, int] = defaultdict(int)  # directed boundary pieces, opposite ones cancel
    rnd = lambda v: round(v, 9) + 0.0

    def add(p, q):
        if p != q:
            if segments.get((q, p)):
                segments[q, p] -= 1
            else:
                segments[p, q] += 1

    sides: dict[float, list[tuple[float, float, int]]] = defaultdict(list)
    for a, b in zip(grid[:-1], grid[1:]):
        m = (a + b) / 2
        live = np.flatnonzero((E[:, 0] < m) & (E[:, 2] > m))
        y = E[live, 1] + slope[live] * (m - E[live, 0])
        order = np.argsort(y, kind="stable")
        state = np.zeros(len(first) + len(second), bool)
        was, start = keep(False, False), None
        for k in order:
            i = live[k]
            state[owner[i]] ^= True
            now = keep(bool(state[:split].any()), bool(state[split:].any()))
            if now and not was:
                start = (i, y[k])
            elif was and not now and start is not None:
                lo = start[0]
                if y[k] - start[1] > 1e-11:
                    ya = [rnd(E[t, 1] + slope[t] * (a - E[t, 0])) for t in (lo, i)]
                    yb = [rnd(E[t, 1] + slope[t] * (b - E[t, 0])) for t in (lo, i)]
                    add((rnd(a), ya[0]), (rnd(b), yb[0]))
                    add((rnd(b), yb[1]), (rnd(a), ya[1]))
                    sides[rnd(b)].append((yb[0], yb[1], 1))
                    sides[rnd(a)].append((ya[0], ya[1], -1))
            was = now
    for x, runs in sides.items():  # vertical pieces cancel where both sides are filled
        ys = sorted({v for r in runs for v in r[:2]})
        for y0, y1 in zip(ys[:-1], ys[1:]):
            n = sum(s for u, v, s in runs if u <= y0 and v >= y1)
            if n > 0:
                add((x, y0), (x, y1))
            elif n < 0:
                add((x, y1), (x, y0))
    return _assemble([p for p, n in segments.items() for _ in range(n)])


def _assemble(pieces: list[tuple]) -> Geometry:
    """Rings from directed pieces with the inside on the left; at a branch the sharpest left turn is taken."""
    nxt: dict[tuple, list[tuple]] = defaultdict(list)
    for p, q in pieces:
        nxt[p].append(q)
    rings = []
    for start in sorted(nxt):
        while nxt[start]:
            ring, here = [start], nxt[start].pop()
            while here != start:
                ring.append(here)
                options = nxt[here]
                if not options:
                    break
                if len(options) == 1:
                    here2 = options.pop()
                else:
                    back = math.atan2(ring[-2][1] - here[1], ring[-2][0] - here[0])
                    turn = lambda q: (back - math.atan2(q[1] - here[1], q[0] - here[0])) % (2 * math.pi) or 2 * math.pi  # noqa: E731, B023
                    here2 = min(options, key=turn)
                    options.remove(here2)
                here = here2
            ring = drop_collinear(close(np.array(ring)))
            if len(ring) > 3 and abs(ring_area(ring)) > 1e-12:
                rings.append(ring)
    return nest(rings)


def drop_collinear(ring: np.ndarray) -> np.ndarray:
    q = ring[:-1]
    while len(q) > 2:
        a, b = q - np.roll(q, 1, axis=0), np.roll(q, -1, axis=0) - q
        cross = np.abs(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0])
        flat = cross <= 1e-9 * (np.hypot(*a.T) * np.hypot(*b.T)) + 1e-15
        if not flat.any():
            break
        i = np.flatnonzero(flat)
        drop = i[np.concatenate([[True], np.diff(i) > 1])]
        if len(drop) > 1 and drop[0] == 0 and drop[-1] == len(q) - 1:
            drop = drop[:-1]
        q = np.delete(q, drop, axis=0)
    return close(q)


def nest(rings: list[np.ndarray]) -> Geometry:
    """Shells are counter-clockwise; a hole goes to the smallest shell around it."""
    shells = sorted((r for r in rings if ring_area(r) > 0), key=ring_area)
    parts = [[s] for s in shells]
    for h in (r for r in rings if ring_area(r) < 0):
        probe = np.array([interior_point([[h]])])
        for p in parts:
            if contains([[p[0]]], probe)[0]:
                p.append(h)
                break
    return sorted(parts, key=lambda p: (p[0][:, 0].min(), p[0][:, 1].min()))


def union(geoms: list[Geometry]) -> Geometry:
    """Cascaded: neighbours in order are united in pairs."""
    geoms = [g for g in geoms if g]
    while len(geoms) > 1:
        geoms = [boolean(geoms[i : i + 4], [], lambda a, b: a) for i in range(0, len(geoms), 4)]
    return boolean(geoms, [], lambda a, b: a) if geoms else []


def intersection(a: Geometry, b: Geometry) -> Geometry:
    return boolean([a], [b], lambda p, q: p and q)


def difference(a: Geometry, others: list[Geometry]) -> Geometry:
    return boolean([a], others, lambda p, q: p and not q)


def parts_alone(geom: Geometry) -> list[Geometry]:
    return [[p] for p in geom]


# ---- buffers


def _capsule(a, b, r: float, segments: int, cap: str = "Round") -> np.ndarray:
    d = math.atan2(b[1] - a[1], b[0] - a[0])
    if cap == "Round":
        t = np.linspace(d - math.pi / 2, d + math.pi / 2, 2 * segments + 1)
        return close(np.concatenate([np.stack([b[0] + r * np.cos(t), b[1] + r * np.sin(t)], axis=1), np.stack([a[0] + r * np.cos(t + math.pi), a[1] + r * np.sin(t + math.pi)], axis=1)]))
    u, n = np.array([math.cos(d), math.sin(d)]), np.array([-math.sin(d), math.cos(d)])
    e = u * r if cap == "Square" else 0
    return close(np.array([a - e - n * r, b + e - n * r, b + e + n * r, a - e + n * r]))


def buffer(geom: Geometry, distance: float, segments: int = 8, cap: str = "Round") -> Geometry:
    """Union of the geometry and capsules round its edges; negative distances take them away."""
    r, shapes, polygon = abs(distance), [], is_polygon(geom)
    if not r:
        return geom if polygon else []
    for part in geom:
        for ring in part:
            if len(ring) == 1:
                shapes.append([[circle_ring(*ring[0], r, 4 * segments)]])
            last = len(ring) - 2
            for i, (a, b) in enumerate(zip(ring[:-1], ring[1:])):
                if np.array_equal(a, b):
                    continue
                if polygon or cap == "Round":
                    shapes.append([[_capsule(a, b, r, segments)]])
                else:
                    shapes.append([[_capsule(a, b, r, segments, "Flat")]])
                    if i:
                        shapes.append([[circle_ring(*a, r, 4 * segments)]])
                    if cap == "Square" and i in (0, last):
                        shapes.append([[_capsule(a, b, r, segments, "Square")]])
    if distance < 0:
        return difference(geom, shapes) if polygon else []
    return union([*([geom] if polygon else []), *shapes])


def one_sided(path: np.ndarray, distance: float, segments: int = 8) -> Geometry:
    """Left of the path for positive distances, right for negative ones."""
    shapes, sign, r = [], math.copysign(1, distance), abs(distance)
    for a, b in zip(path[:-1], path[1:]):
        n = np.array([-(b - a)[1], (b - a)[0]]) / max(1e-300, math.hypot(*(b - a))) * r * sign
        shapes.append([[close(np.array([a, b, b + n, a + n]))]])
    for p, q, s in zip(path[:-2], path[1:-1], path[2:]):
        turn = (q - p)[0] * (s - q)[1] - (q - p)[1] * (s - q)[0]
        if turn * sign < 0:
            t0, t1 = (math.atan2(*(v[::-1])) + sign * math.pi / 2 for v in (q - p, s - q))
            t1 = t0 + ((t1 - t0 + math.pi) % (2 * math.pi) - math.pi)
            t = np.linspace(t0, t1, segments + 1)
            shapes.append([[close(np.concatenate([[q], np.stack([q[0] + r * np.cos(t), q[1] + r * np.sin(t)], axis=1)]))]])
    return union(shapes)


def variable_buffer(path: np.ndarray, start: float, end: float, segments: int = 8) -> Geometry:
    """Hulls of circles whose radius goes from start to end along the path."""
    c = cumulative(path)
    radii = start + (end - start) * c / max(c[-1], 1e-300)
    return union([[[convex_hull(np.concatenate([circle_ring(*p, r, 4 * segments), circle_ring(*q, s, 4 * segments)]))]] for p, q, r, s in zip(path[:-1], path[1:], radii[:-1], radii[1:]) if max(r, s) > 0])


# ---- triangulation


def delaunay(pts: np.ndarray) -> np.ndarray:
    """Triangles of point numbers by incremental insertion (Bowyer-Watson) along x.

    A fixed jitter of 1e-9 of the extent decides ties (points on one circle or line); triangles that
    only the jitter made are dropped.
    """
    n = len(pts)
    if n < 3:
        return np.empty((0, 3), int)
    lo, hi = pts.min(axis=0), pts.max(axis=0)
    scale = max(float((hi - lo).max()), 1e-12)
    p = (pts - (lo + hi) / 2) / scale
    q = (p + np.random.default_rng(7).uniform(-1e-9, 1e-9, p.shape)).tolist() + [(-4e5, -3e5), (4e5, -3e5), (0.0, 5e5)]
    order = sorted(range(n), key=lambda i: q[i])

    def made(a: int, b: int, c: int):
        (ax, ay), (bx, by), (cx, cy) = q[a], q[b], q[c]
        bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
        d = 2 * (bx * cy - by * cx)
        if d < 0:
            b, c, bx, by, cx, cy, d = c, b, cx, cy, bx, by, -d
        r, s = bx * bx + by * by, cx * cx + cy * cy
        ux, uy = (r * cy - s * by) / (d or 1e-300), (s * bx - r * cx) / (d or 1e-300)
        return (a, b, c), ax + ux + math.hypot(ux, uy) * (1 + 1e-9) + 1e-9  # the circle's right end

    def inside(t, x: float, y: float) -> bool:
        (ax, ay), (bx, by), (cx, cy) = q[t[0]], q[t[1]], q[t[2]]
        ax, ay, bx, by, cx, cy = ax - x, ay - y, bx - x, by - y, cx - x, cy - y
        return (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay) > 0

    open_, done = dict([made(n, n + 1, n + 2)]), []
    for i in order:
        x, y = q[i]
        edges: dict[tuple, int] = {}
        for t, right in list(open_.items()):
            if x > right:
                done.append(t)
                del open_[t]
            elif inside(t, x, y):
                del open_[t]
                for e in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
                    k = (min(e), max(e))
                    edges[k] = edges.get(k, 0) + 1
        for (a, b), c in edges.items():
            if c == 1:
                t, right = made(a, b, i)
                open_[t] = right
    out = [t for t in [*done, *open_] if max(t) < n]
    out = [t for t in out if abs((p[t[1]] - p[t[0]])[0] * (p[t[2]] - p[t[0]])[1] - (p[t[1]] - p[t[0]])[1] * (p[t[2]] - p[t[0]])[0]) > 1e-8]
    return np.array(sorted(tuple(sorted(t)) for t in out), int).reshape(-1, 3)


def voronoi(pts: np.ndarray, clip: np.ndarray) -> list[np.ndarray]:
    """Cell of each point in a convex ring, by half-planes of its Delaunay neighbours."""
    near = defaultdict(set)
    for t in delaunay(pts):
        for a in t:
            near[a].update(b for b in t if b != a)
    out = []
    for i, p in enumerate(pts):
        ring = clip[:-1]
        for j in near[i] or (set(range(len(pts))) - {i}):
            q = pts[j]
            if len(ring):
                ring = _half_plane(ring, (p + q) / 2, q - p)
        out.append(close(ring) if len(ring) > 2 else np.empty((0, 2)))
    return out


def _half_plane(ring: np.ndarray, o: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The open ring's part with (v - o) . n <= 0."""
    s, out = (ring - o) @ n, []
    for k in range(len(ring)):
        a, b, u, v = ring[k], ring[(k + 1) % len(ring)], s[k], s[(k + 1) % len(ring)]
        if u <= 0:
            out.append(a)
        if (u < 0 < v) or (v < 0 < u):
            out.append(a + (b - a) * (u / (u - v)))
    return np.array(out).reshape(-1, 2)


def clip_convex(ring: np.ndarray, convex: np.ndarray) -> np.ndarray:
    """Sutherland-Hodgman against a counter-clockwise convex ring."""
    out = ring[:-1]
    for a, b in zip(convex[:-1], convex[1:]):
        if not len(out):
            break
        out = _half_plane(out, a, np.array([(b - a)[1], -(b - a)[0]]))
    return close(out) if len(out) > 2 else np.empty((0, 2))


# ---- rasters


def scan(geom: Geometry, meta):
    """(row, first col, last col) of the cells whose centres lie in a polygon, or that a path or point touches."""
    if not geom or not sum(len(r) for p in geom for r in p):
        return
    if not is_polygon(geom):
        seen = set()
        for part in geom:
            for path in part:
                q = densify(path, min(meta.dx, meta.dy) / 2) if len(path) > 1 else path
                c = np.floor((q[:, 0] - meta.minx) / meta.dx).astype(int)
                r = np.floor((meta.maxy - q[:, 1]) / meta.dy).astype(int)
                seen.update(zip(r.tolist(), c.tolist()))
        for r, c in sorted(seen):
            if 0 <= r < meta.nrows and 0 <= c < meta.ncols:
                yield r, c, c
        return
    lo, hi = geometry_bounds(geom)
    r0, r1 = max(0, math.floor((meta.maxy - hi[1]) / meta.dy - 0.5)), min(meta.nrows - 1, math.ceil((meta.maxy - lo[1]) / meta.dy))
    E = np.array([(*a, *b) for part in geom for ring in part for a, b in zip(ring[:-1], ring[1:])])
    for r in range(r0, r1 + 1):
        y = meta.maxy - (r + 0.5) * meta.dy
        e = E[(E[:, 1] <= y) != (E[:, 3] <= y)]
        xs = np.sort(e[:, 0] + (y - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1]))
        for a, b in zip(xs[::2], xs[1::2]):
            c0, c1 = max(0, math.ceil((a - meta.minx) / meta.dx - 0.5)), min(meta.ncols - 1, math.ceil((b - meta.minx) / meta.dx - 0.5) - 1)
            if c0 <= c1:
                yield r, c0, c1


def cells_to_polygon(rows: np.ndarray, cols: np.ndarray) -> Geometry:
    """Outline of cells in (col, row) units; row 0 is at the top, so y grows downwards."""
    have, pieces = set(zip(rows.tolist(), cols.tolist())), []
    for r, c in have:
        if (r + 1, c) not in have:
            pieces.append(((c + 1.0, r + 1.0), (c + 0.0, r + 1.0)))
        if (r - 1, c) not in have:
            pieces.append(((c + 0.0, r + 0.0), (c + 1.0, r + 0.0)))
        if (r, c - 1) not in have:
            pieces.append(((c + 0.0, r + 1.0), (c + 0.0, r + 0.0)))
        if (r, c + 1) not in have:
            pieces.append(((c + 1.0, r + 0.0), (c + 1.0, r + 1.0)))
    return _assemble(pieces)
