"""Geometry editing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import kernels as K
from ..functions import expr as E
from ..plans.rows import binary_udf, exploded, geometries_udf, geometry_udf
from .overlay import candidates


def _vertices(fn) -> Column:
    return F.transform("geom", lambda p: F.transform(p, lambda r: F.transform(r, fn)))


def offset(df: DataFrame, dx: str = "0", dy: str = "0") -> DataFrame:
    """Translation; null counts as 0."""
    x, y = F.coalesce(F.expr(dx).cast("double"), F.lit(0.0)), F.coalesce(F.expr(dy).cast("double"), F.lit(0.0))
    if "geom" not in df.columns:
        return df.withColumn("x", F.col("x") + x).withColumn("y", F.col("y") + y)
    return df.withColumn("geom", _vertices(lambda v: F.struct((v.x + x).alias("x"), (v.y + y).alias("y"))))


def _about(df: DataFrame, anchor) -> tuple[DataFrame, Column, Column]:
    if anchor:
        return df, F.lit(float(anchor[0])), F.lit(float(anchor[1]))
    return df.withColumn("_c", E.centroid(F.col("geom"))), F.col("_c.x"), F.col("_c.y")


def rotate(df: DataFrame, angle: str, anchor=None) -> DataFrame:
    """Clockwise degrees about the anchor or the centroid."""
    d, cx, cy = _about(df, anchor)
    a = F.radians(F.coalesce(F.expr(angle).cast("double"), F.lit(0.0)))
    return d.withColumn("geom", _vertices(lambda v: F.struct((cx + (v.x - cx) * F.cos(a) + (v.y - cy) * F.sin(a)).alias("x"), (cy - (v.x - cx) * F.sin(a) + (v.y - cy) * F.cos(a)).alias("y")))).drop("_c")


def scale(df: DataFrame, sx: str, sy: str, anchor=None) -> DataFrame:
    """Scaling about the anchor or the centroid; null counts as 1."""
    d, cx, cy = _about(df, anchor)
    x, y = F.coalesce(F.expr(sx).cast("double"), F.lit(1.0)), F.coalesce(F.expr(sy).cast("double"), F.lit(1.0))
    return d.withColumn("geom", _vertices(lambda v: F.struct((cx + (v.x - cx) * x).alias("x"), (cy + (v.y - cy) * y).alias("y")))).drop("_c")


def flip_line(df: DataFrame) -> DataFrame:
    return df.withColumn("geom", F.transform("geom", lambda p: F.transform(p, lambda r: F.reverse(r))))


def densify(df: DataFrame, tolerance: str) -> DataFrame:
    """Vertices so that no segment is longer than the tolerance.

    In numpy: an expression with a captured lambda variable cannot feed a later Python function.
    """
    d = df.withColumn("_t", F.expr(tolerance).cast("double")).where("_t > 0")
    return d.withColumn("geom", geometry_udf(lambda g, t: [[K.densify(r, float(t)) for r in p] for p in g], F.col("_t"))).drop("_t")


def _simple(g: K.Geometry, t: float, topology: bool) -> K.Geometry | None:
    out = []
    for part in g:
        rings = [K.simplify(r, t) for r in part]
        if len(part[0]) > 3 and np.allclose(part[0][0], part[0][-1]):
            if topology:
                rings = [s if abs(K.ring_area(s)) > 0 else r for r, s in zip(part, rings)]
            elif abs(K.ring_area(rings[0])) == 0:
                continue
        out.append(rings)
    return out or None


def simplify(df: DataFrame, tolerance: str, preserve_topology: bool = True) -> DataFrame:
    d = df.withColumn("_t", F.expr(tolerance).cast("double"))
    return d.withColumn("geom", geometry_udf(lambda g, t: _simple(g, float(t), preserve_topology), F.col("_t"))).drop("_t").where("geom is not null")


def simplify_polygon(df: DataFrame, tolerance: float = 0.0, preserve_topology: bool = True, minimum_area: float = 0.0) -> DataFrame:
    """Rings are cut at the vertices where neighbours begin or end to share them, so shared borders simplify alike."""
    near = candidates(df, df).where("_a <> _b").groupBy("_a").agg(F.collect_list("_gb").alias("_others"))
    d = df.join(near, df["fid"] == near["_a"], "left")

    @F.pandas_udf(E.GEOMETRY)
    def run(g: pd.Series, others: pd.Series) -> pd.Series:
        out = []
        for x, o in zip(g, others):
            owners: dict[tuple, set] = {}
            for k, v in enumerate([] if o is None else o):
                for p in K.to_numpy(v):
                    for r in p:
                        for q in map(tuple, np.round(r, 9).tolist()):
                            owners.setdefault(q, set()).add(k)
            parts = []
            for part in K.to_numpy(x):
                rings = []
                for r in part:
                    own = [frozenset(owners.get(tuple(q), ())) for q in np.round(r[:-1], 9).tolist()]
                    n = len(own)
                    nodes = [i for i in range(n) if own[i] != own[i - 1] or own[i] != own[(i + 1) % n]]
                    if not nodes:
                        rings.append(K.simplify(r, tolerance))
                        continue
                    q, pieces = np.roll(r[:-1], -nodes[0], axis=0), []
                    at = [i - nodes[0] for i in nodes] + [n]
                    q = K.close(q)
                    for a, b in zip(at[:-1], at[1:]):
                        piece = q[a : b + 1]
                        rev = tuple(piece[0]) > tuple(piece[-1])
                        s = K.simplify(piece[::-1] if rev else piece, tolerance)
                        pieces.append((s[::-1] if rev else s)[:-1])
                    ring = K.close(np.concatenate(pieces))
                    rings.append(ring if len(ring) > 3 else r)
                if rings and abs(K.ring_area(rings[0])) >= minimum_area:
                    parts.append(rings)
            out.append(K.from_numpy(parts) if parts else None)
        return pd.Series(out, dtype=object)

    return d.withColumn("geom", run("geom", "_others")).where("geom is not null").select(*df.columns)


def smooth(df: DataFrame, fit: float = 0.3) -> DataFrame:
    return df.withColumn("geom", geometry_udf(lambda g: [[K.smooth(r, fit) for r in p] for p in g]))


def remove_holes(df: DataFrame, minimum_area: str = "0") -> DataFrame:
    """All holes, or those smaller than the area."""
    t = F.coalesce(F.expr(minimum_area).cast("double"), F.lit(0.0))
    return df.withColumn("geom", F.transform("geom", lambda p: F.filter(p, lambda r, i: (i == 0) | ((t > 0) & (F.abs(E.ring_area(r)) >= t)))))


def remove_parts(df: DataFrame, minimum_area: str = "0") -> DataFrame:
    """The largest part, and parts of at least the area where one is given."""
    t = F.coalesce(F.expr(minimum_area).cast("double"), F.lit(0.0))
    d = df.withColumn("_top", F.array_max(F.transform("geom", E.part_area))).withColumn("_first", F.array_position(F.transform("geom", E.part_area), F.col("_top")))
    return d.withColumn("geom", F.filter("geom", lambda p, i: (i == F.col("_first") - 1) | ((t > 0) & (E.part_area(p) >= t)))).drop("_top", "_first")


def split_line_at_vertices(df: DataFrame) -> DataFrame:
    edges = F.flatten(F.transform(F.flatten("geom"), lambda r: F.transform(E.pairs(r), lambda e: F.array(F.array(F.array(e.a, e.b))))))
    return exploded(df, edges, position="se_order")


def split_line_by_distance(df: DataFrame, distance: str) -> DataFrame:
    def run(g, d):
        out = []
        for p in g:
            for r in p:
                n = K.path_length(r)
                cuts = [*np.arange(0, n - K.EPS, d), n]
                out += [[[K.substring(r, a, b)]] for a, b in zip(cuts[:-1], cuts[1:])]
        return out

    d = df.withColumn("_d", F.expr(distance).cast("double")).where("_d > 0")
    return exploded(d, geometries_udf(run, F.col("_d")), position="se_order").drop("_d")


def split_line_at_point(lines: DataFrame, points: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Cuts at the points on a line, or within the tolerance of it."""
    from .joins import points_near_segments

    near = points_near_segments(points, lines, tolerance or 1e-8)
    at = near.groupBy("lid").agg(F.collect_list(F.struct("px", "py")).alias("_at"))
    d = lines.join(at, lines["fid"] == at["lid"], "left")

    @F.pandas_udf(f"array<{E.GEOMETRY}>")
    def cut(g: pd.Series, pts: pd.Series) -> pd.Series:
        out = []
        for x, ps in zip(g, pts):
            got = []
            for part in K.to_numpy(x):
                for path in part:
                    n = K.path_length(path)
                    places = [] if ps is None else [K.locate(path, np.array([p["px"], p["py"]])) for p in ps]
                    at = sorted({0.0, n, *[round(a, 9) for a, off in places if off <= max(tolerance, 1e-8)]})
                    got += [K.from_numpy([[K.substring(path, a, b)]]) for a, b in zip(at[:-1], at[1:]) if b - a > K.EPS]
            out.append(got)
        return pd.Series(out, dtype=object)

    return exploded(d.withColumn("_g", cut("geom", "_at")).drop("_at", "lid"), F.col("_g"), position="se_order").drop("_g")


def _with_neighbours(lines: DataFrame, reach: float) -> DataFrame:
    """Rows with the geometries of other rows whose boxes come within ``reach``."""
    grown = lines.withColumn("geom", F.concat("geom", F.array(E.rectangle(E.bounds(F.col("geom"))["xmin"] - reach, E.bounds(F.col("geom"))["ymin"] - reach, E.bounds(F.col("geom"))["xmax"] + reach, E.bounds(F.col("geom"))["ymax"] + reach)[0])))
    near = candidates(grown, lines).where("_a <> _b").groupBy("_a").agg(F.collect_list("_gb").alias("_others"))
    return lines.join(near, lines["fid"] == near["_a"], "left").drop("_a")


def trim_line(lines: DataFrame, dangle: float, delete_short: bool = True) -> DataFrame:
    """Ends that reach past the last crossing by at most the dangle length go; lines that short and uncrossed may go."""

    @F.pandas_udf(E.GEOMETRY)
    def run(g: pd.Series, others: pd.Series) -> pd.Series:
        out = []
        for x, o in zip(g, others):
            near = [r for v in ([] if o is None else o) for p in K.to_numpy(v) for r in p]
            parts = []
            for part in K.to_numpy(x):
                for path in part:
                    n = K.path_length(path)
                    at = sorted(K.locate(path, q)[0] for s in near for q in K.crossings(path, s))
                    a, b = 0.0, n
                    if at:
                        a = at[0] if K.EPS < at[0] <= dangle else 0.0
                        b = at[-1] if K.EPS < n - at[-1] <= dangle else n
                    if b - a > K.EPS and not (delete_short and not at and n <= dangle):
                        parts.append([K.substring(path, a, b)])
            out.append(K.from_numpy(parts) if parts else None)
        return pd.Series(out, dtype=object)

    return _with_neighbours(lines, 0.0).withColumn("geom", run("geom", "_others")).drop("_others").where("geom is not null")


def extend_line(lines: DataFrame, length: float, extend_to: bool = True) -> DataFrame:
    """Ends grow to the first line within the length; without one they stay, or grow by the length unless extend_to."""

    def grow(end, before, near):
        u = (end - before) / max(1e-300, math.hypot(*(end - before)))
        ray = np.stack([end + u * 1e-9, end + u * length])
        hits = [q for s in near if len(s) > 1 for q in K.crossings(ray, s)]
        if hits:
            return min(hits, key=lambda q: math.hypot(*(q - end)))
        return None if extend_to else end + u * length

    @F.pandas_udf(E.GEOMETRY)
    def run(g: pd.Series, others: pd.Series) -> pd.Series:
        out = []
        for x, o in zip(g, others):
            near = [r for v in ([] if o is None else o) for p in K.to_numpy(v) for r in p]
            parts = []
            for part in K.to_numpy(x):
                for path in part:
                    a, b = grow(path[0], path[1], near), grow(path[-1], path[-2], near)
                    parts.append([np.concatenate([*([[a]] if a is not None else []), path, *([[b]] if b is not None else [])])])
            out.append(K.from_numpy(parts))
        return pd.Series(out, dtype=object)

    return _with_neighbours(lines, length).withColumn("geom", run("geom", "_others")).drop("_others")


def intersection_points(a: DataFrame, b: DataFrame, id_field: str | None = None) -> DataFrame:
    """Distinct places where lines or boundaries of the two tables cross."""

    @F.pandas_udf("array<struct<x:double,y:double>>")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([[{"x": float(q[0]), "y": float(q[1])} for p in K.to_numpy(u) for r in p for s in K.to_numpy(v) for t in s for q in K.crossings(r, t)] for u, v in zip(x, y)], dtype=object)

    d = candidates(a, b).select("_a", "_b", F.explode(run("_ga", "_gb")).alias("p")).select(F.col("_a").alias("fid"), F.col("_b").alias("other_fid"), "p.x", "p.y")
    if id_field:
        d = d.join(b.select(F.col("fid").alias("other_fid"), F.col(id_field)), "other_fid")
    return d.dropDuplicates(["x", "y"] + ([id_field] if id_field else []))


def eliminate(df: DataFrame, option: str = "Length", exception: str | None = None) -> DataFrame:
    """Slivers enclosed between neighbours (holes of the union) go to the neighbour of longest border, or of larger or smaller area.

    ``exception`` rows are neither filled nor given slivers.
    """
    from .aggregate import unite

    active = df.where(f"not coalesce({exception}, false)") if exception else df
    united = unite(active, [])
    holes = united.select(F.explode(F.flatten(F.transform("geom", lambda p: F.slice(p, 2, F.size(p))))).alias("ring")).select(F.array(F.array("ring")).alias("geom")).withColumn("fid", F.xxhash64(F.to_json("geom")))
    border = binary_udf(lambda s, g: float(sum(K.path_length(q) for p in g for r in p for q in _shared(s[0][0], r))))
    m = candidates(holes, active).withColumn("_len", border("_ga", "_gb")).where("_len > 0").withColumn("_area", E.area(F.col("_gb")))
    key = {"Length": F.col("_len"), "LargerArea": F.col("_area"), "SmallerArea": -F.col("_area")}[option]
    best = m.groupBy("_a").agg(F.max(F.struct(key.alias("k"), (-F.col("_b")).alias("b"))).alias("m"), F.first("_ga").alias("sliver")).select((-F.col("m.b")).alias("_f"), "sliver")
    given = best.groupBy("_f").agg(F.collect_list("sliver").alias("_slivers"))

    @F.pandas_udf(E.GEOMETRY)
    def fill(g: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([x if v is None else K.from_numpy(K.union([K.to_numpy(x), *[[[r[::-1] if K.ring_area(r) < 0 else r for r in p] for p in K.to_numpy(h)] for h in v]])) for x, v in zip(g, s)], dtype=object)

    return df.join(given, df["fid"] == given["_f"], "left").withColumn("geom", fill("geom", "_slivers")).drop("_f", "_slivers")


def _shared(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Collinear overlaps of the segments of two paths."""
    out = []
    for p0, p1 in zip(a[:-1], a[1:]):
        u = p1 - p0
        n = u @ u
        for q0, q1 in zip(b[:-1], b[1:]):
            if n and abs(u[0] * (q0 - p0)[1] - u[1] * (q0 - p0)[0]) <= 1e-9 * n and abs(u[0] * (q1 - p0)[1] - u[1] * (q1 - p0)[0]) <= 1e-9 * n:
                s, t = sorted(((q0 - p0) @ u / n, (q1 - p0) @ u / n))
                s, t = max(s, 0), min(t, 1)
                if t - s > 1e-9:
                    out.append(np.stack([p0 + s * u, p0 + t * u]))
    return out


def repair(df: DataFrame) -> DataFrame:
    """Repeated vertices go, rings are closed, crossing rings are cut by the even-odd rule; nothing left drops the row."""

    def run(g):
        out = []
        for part in g:
            rings = []
            for r in part:
                r = r[np.isfinite(r).all(axis=1)]
                r = r[np.concatenate([[True], (np.diff(r, axis=0) != 0).any(axis=1)])] if len(r) else r
                if len(r) > 1 or len(part) == 1 and len(r):
                    rings.append(r)
            if rings:
                out.append(rings)
        if out and all(len(p[0]) > 3 and np.allclose(p[0][0], p[0][-1]) for p in out):
            fixed = []
            for p in out:
                fixed.append([K.close(r) for r in p if len(r) > 3])
            # a part is repaired by itself: its rings under the even-odd rule, united with the other parts
            return K.union([K.boolean([p_ring_set], [], lambda a, b: a) for p_ring_set in ([p] for p in fixed)]) or None
        return out or None

    return df.withColumn("geom", geometry_udf(run)).where("geom is not null")


def split_polygon_by_count(df: DataFrame, count: str, seed: int = 1) -> DataFrame:
    """Parts of about equal size: seeded points, k-means centres, Voronoi cells clipped to the polygon."""

    def run(g, n):
        n = int(n)
        if n < 2:
            return [g]
        rng = np.random.default_rng(seed)
        lo, hi = K.geometry_bounds(g)
        pts = np.empty((0, 2))
        while len(pts) < 2000:
            p = rng.uniform(lo, hi, (4000, 2))
            pts = np.concatenate([pts, p[K.contains(g, p)]])
        pts = pts[:2000]
        c = pts[rng.choice(len(pts), n, replace=False)]
        for _ in range(50):
            own = ((pts[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
            new = np.array([pts[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(n)])
            if np.allclose(new, c):
                break
            c = new
        pad = (hi - lo) + 1
        (x0, y0), (x1, y1) = lo - pad, hi + pad
        cells = K.voronoi(c, K.close(np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)])))
        return [r for r in (K.intersection(g, [[v]]) for v in cells if len(v)) if r]

    d = df.withColumn("_n", F.expr(count).cast("int")).where("_n > 0")
    return exploded(d, geometries_udf(run, F.col("_n")), position="part").drop("_n")
