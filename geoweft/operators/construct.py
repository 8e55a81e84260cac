"""Geometry construction and conversion."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import kernels as K
from ..functions import expr as E
from ..plans import cells as C
from ..plans.rows import exploded, geometries_udf, geometry_udf
from .joins import segments
from .vector import inner_point

#: Points triangulated in one task; larger tables are refused rather than cut.
MAX_TRIANGULATED = 200_000


def _vertices(g: K.Geometry) -> np.ndarray:
    return np.concatenate([r for p in g for r in p])


def _each(df: DataFrame, single_part: bool) -> DataFrame:
    return exploded(df, F.transform("geom", lambda p: F.array(p)), position="part") if single_part else df


def feature_to_point(df: DataFrame, inside: bool = True, single_part: bool = False) -> DataFrame:
    d = _each(df, single_part)
    c = geometry_udf(inner_point)[0][0][0] if inside else E.centroid(F.col("geom"))
    return d.withColumn("_c", c).withColumn("x", F.col("_c.x")).withColumn("y", F.col("_c.y")).drop("_c", "geom")


def envelope_to_polygon(df: DataFrame, single_envelope: bool = True) -> DataFrame:
    d = _each(df, not single_envelope)
    b = E.bounds(F.col("geom"))
    return d.withColumn("geom", E.rectangle(b["xmin"], b["ymin"], b["xmax"], b["ymax"]))


def convex_hull(df: DataFrame, single_part: bool = True) -> DataFrame:
    return _each(df, single_part).withColumn("geom", geometry_udf(lambda g: [[K.convex_hull(_vertices(g))]]))


def bounding_circle(df: DataFrame, single_part: bool = True) -> DataFrame:
    return _each(df, single_part).withColumn("geom", geometry_udf(lambda g: [[K.circle_ring(*K.bounding_circle(_vertices(g)))]]))


def minimum_rectangle(df: DataFrame, single_part: bool = True) -> DataFrame:
    return _each(df, single_part).withColumn("geom", geometry_udf(lambda g: [[K.minimum_rectangle(_vertices(g))]]))


def octagonal_envelope(df: DataFrame, single_part: bool = True) -> DataFrame:
    return _each(df, single_part).withColumn("geom", geometry_udf(lambda g: [[K.octagon(_vertices(g))]]))


def inscribed_circle(df: DataFrame, single_part: bool = True, tolerance: float = 1.0) -> DataFrame:
    def circle(g):
        if not K.area(g):
            return None
        x, y, r = K.inscribed_circle(g, tolerance)
        return [[K.circle_ring(x, y, r)]] if r > 0 else None

    return _each(df, single_part).withColumn("geom", geometry_udf(circle)).where("geom is not null")


def inscribed_rectangle(df: DataFrame, rotate: bool = False, single_part: bool = True) -> DataFrame:
    return _each(df, single_part).withColumn("geom", geometry_udf(lambda g: [[K.inscribed_rectangle(g, rotate)]] if K.area(g) else None)).where("geom is not null")


def multipart_to_singlepart(df: DataFrame) -> DataFrame:
    return exploded(df, F.transform("geom", lambda p: F.array(p)), position="part")


def points_to_line(df: DataFrame, line: str | None = None, sort: str | None = None, close: bool = False, bezier: bool = False, fid: str = "fid") -> DataFrame:
    """Points of a line in sort order (then fid), consecutive duplicates removed, fewer than two dropped."""
    d = df.select((F.col(line) if line else F.lit("ALL")).alias("line"), F.struct((F.col(sort) if sort else F.col(fid)).alias("s"), F.col(fid).alias("f"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).alias("p"))
    g = d.groupBy("line").agg(F.array_sort(F.collect_list("p")).alias("p"))
    path = F.transform("p", lambda v: F.struct(v.x.alias("x"), v.y.alias("y")))
    g = g.withColumn("path", path)
    g = g.withColumn("path", F.filter("path", lambda v, i: (i == 0) | (v != F.col("path")[F.greatest(i - 1, F.lit(0))]))).where("size(path) > 1")
    if close:
        g = g.withColumn("path", F.when(F.col("path")[0] != F.element_at("path", -1), F.concat("path", F.slice("path", 1, 1))).otherwise(F.col("path")))
    g = g.select("line", F.array(F.array("path")).alias("geom"))
    if bezier:
        g = g.withColumn("geom", geometry_udf(lambda x: [[K.smooth(r) for r in p] for p in x]))
    return g.withColumn("geom_len", E.length(F.col("geom")))


def vertices_to_points(df: DataFrame, location: str = "All") -> DataFrame:
    paths = F.flatten("geom")
    pick = {
        "All": F.flatten(paths),
        "Start": F.transform(paths, lambda p: p[0]),
        "End": F.transform(paths, lambda p: F.element_at(p, -1)),
        "BothEnds": F.flatten(F.transform(paths, lambda p: F.array(p[0], F.element_at(p, -1)))),
    }
    if location == "Mid":
        mid = geometry_udf(lambda g: [[K.along(r, np.array([K.path_length(r) / 2]))] for p in g for r in p])
        return exploded(df, F.flatten(F.flatten(mid)), "_v", "vertex").withColumn("x", F.col("_v.x")).withColumn("y", F.col("_v.y")).drop("_v", "geom")
    return exploded(df, pick[location], "_v", "vertex").withColumn("x", F.col("_v.x")).withColumn("y", F.col("_v.y")).drop("_v", "geom")


def points_along_lines(df: DataFrame, distance: str) -> DataFrame:
    """Start point and then ceil(length / interval) points; the last is the end."""

    def run(g, d):
        out = []
        for p in g:
            for r in p:
                n = K.path_length(r)
                out.append(K.along(r, np.minimum(np.arange(math.ceil(n / d) + 1) * d, n)))
        return [[np.concatenate(out)]]

    d = df.withColumn("_d", F.expr(distance).cast("double")).where("_d > 0").withColumn("_p", geometry_udf(run, F.col("_d"))[0][0]).drop("_d")
    return exploded(d.drop("geom"), F.col("_p"), "_v", "se_order").withColumn("x", F.col("_v.x")).withColumn("y", F.col("_v.y")).drop("_v", "_p")


def _strip(path: np.ndarray, width: float, segments: int) -> K.Geometry:
    return K.buffer([[path]], width / 2, max(2, segments or 8), "Flat")


def polygons_along_lines(df: DataFrame, distance: str, width: str, segments: int = 0) -> DataFrame:
    """Flat-capped strips of an interval; a short last piece joins its neighbour."""

    def run(g, d, w):
        out = []
        for p in g:
            for r in p:
                n = K.path_length(r)
                cuts = [*np.arange(0, n - d / 2, d), n] if n > d else [0.0, n]
                out += [_strip(K.substring(r, a, b), w, segments) for a, b in zip(cuts[:-1], cuts[1:])]
        return out

    d = df.withColumn("_d", F.expr(distance).cast("double")).withColumn("_w", F.expr(width).cast("double")).where("_d > 0 and _w > 0")
    return exploded(d, geometries_udf(run, F.col("_d"), F.col("_w")), position="se_order").drop("_d", "_w")


def flow_map(df: DataFrame, od: str, do: str | None = None, max_size: float | None = None) -> DataFrame:
    """Arrow polygons whose width follows the min-max scaled value; with ``do`` a reversed second arrow."""
    d = df.withColumn("_v", F.expr(od).cast("double")).withColumn("direction", F.lit(1))
    if do:
        d = d.unionByName(df.withColumn("_v", F.expr(do).cast("double")).withColumn("direction", F.lit(-1)).withColumn("geom", F.transform("geom", lambda p: F.transform(p, lambda r: F.reverse(r)))))
    d = d.where("_v is not null")
    t = d.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.avg(E.length(F.col("geom"))).alias("_len"))
    d = d.crossJoin(F.broadcast(t)).withColumn("size", (F.lit(float(max_size)) if max_size else F.col("_len") / 20) * (0.1 + 0.9 * F.coalesce(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(1.0))))
    a, b = F.col("geom")[0][0][0], F.element_at(F.col("geom")[0][0], -1)
    n = F.hypot(b.x - a.x, b.y - a.y)
    ux, uy, s = (b.x - a.x) / n, (b.y - a.y) / n, F.col("size")
    head = F.least(2 * s, n / 2)
    at = lambda along, off: F.struct((a.x + ux * along - uy * off).alias("x"), (a.y + uy * along + ux * off).alias("y"))
    gap = s * 0.1
    ring = [at(F.lit(0.0), gap), at(n, gap), at(n - head, gap + s), at(n - head, gap + s / 2), at(F.lit(0.0), gap + s / 2), at(F.lit(0.0), gap)]
    return d.where(n > 0).withColumn("geom", F.array(F.array(F.array(*ring)))).withColumnRenamed("_v", "value").drop("_lo", "_hi", "_len")


def _one_task(df: DataFrame, what: str) -> DataFrame:
    n = df.count()
    if n > MAX_TRIANGULATED:
        raise ValueError(f"{what} of {n} points in one task; group or bin them first")
    return df.groupBy(F.lit(0).alias("_all"))


def delaunay(df: DataFrame, clip=None, fid: str = "fid") -> DataFrame:
    """Triangles with their three node ids; a table is one triangulation, so its size is checked."""
    mask = K.to_numpy(clip) if clip is not None else None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.drop_duplicates(["x", "y"]).sort_values("fid").reset_index(drop=True)
        xy, rows = p[["x", "y"]].to_numpy(float), []
        for t in K.delaunay(xy):
            ring = K.close(xy[t] if K.ring_area(xy[t]) > 0 else xy[t][::-1])
            g = [[ring]] if mask is None else K.intersection([[ring]], mask)
            if g:
                rows.append((*[p.fid[i] for i in t], K.from_numpy(g)))
        return pd.DataFrame(rows, columns=["node0", "node1", "node2", "geom"])

    d = df.select(F.col(fid).cast("long").alias("fid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return _one_task(d, "a triangulation").applyInPandas(run, f"node0 long, node1 long, node2 long, geom {E.GEOMETRY}")


def thiessen(df: DataFrame, attributes: str = "OnlyFID", clip=None, fid: str = "fid") -> DataFrame:
    """Voronoi cells clipped to the area, or to the extent grown by a fifth."""
    mask = K.to_numpy(clip) if clip is not None else None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("fid").drop_duplicates(["x", "y"]).reset_index(drop=True)
        xy = p[["x", "y"]].to_numpy(float)
        lo, hi = xy.min(axis=0), xy.max(axis=0)
        if mask is not None:
            a, b = K.geometry_bounds(mask)
            lo, hi = np.minimum(lo, a), np.maximum(hi, b)
        pad = np.maximum((hi - lo) * 0.2, 1e-9)
        (x0, y0), (x1, y1) = lo - pad, hi + pad
        box = K.close(np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)]))
        rows = []
        for f, cell in zip(p.fid, K.voronoi(xy, box)):
            g = [[cell]] if len(cell) else []
            if g and mask is not None:
                g = K.intersection(g, mask)
            if g:
                rows.append((f, K.from_numpy(g)))
        return pd.DataFrame(rows, columns=["fid", "geom"])

    d = df.select(F.col(fid).cast("long").alias("fid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    cells = _one_task(d, "a Voronoi diagram").applyInPandas(run, f"fid long, geom {E.GEOMETRY}")
    return cells if attributes == "OnlyFID" else df.drop("geom").join(cells.withColumnRenamed("fid", "_f"), F.col(fid) == F.col("_f")).drop("_f")


def concave_hull(df: DataFrame, group: str | None = None, alpha: float = 0.3, remove_holes: bool = False, split: bool = False) -> DataFrame:
    """Union of the Delaunay triangles whose longest edge is at most alpha times the longest of all, a group."""
    alpha = min(1.0, max(0.0, alpha))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = pdf[["x", "y"]].drop_duplicates().to_numpy(float)
        t = K.delaunay(xy)
        e = np.stack([np.hypot(*(xy[t[:, i]] - xy[t[:, (i + 1) % 3]]).T) for i in range(3)], axis=1).max(axis=1) if len(t) else np.empty(0)
        keep = t[e <= alpha * e.max()] if len(t) else t
        g = K.union([[[K.close(xy[k] if K.ring_area(xy[k]) > 0 else xy[k][::-1])]] for k in keep]) if len(keep) else []
        if remove_holes:
            g = [p[:1] for p in g]
        return pd.DataFrame({"case": [pdf.case.iloc[0]], "geom": [K.from_numpy(g)]}) if g else pd.DataFrame({"case": [], "geom": []})

    d = df.select((F.expr(group).cast("string") if group else F.lit("ALL")).alias("case"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    out = d.groupBy("case").applyInPandas(run, f"case string, geom {E.GEOMETRY}")
    return exploded(out, F.transform("geom", lambda p: F.array(p))) if split else out


def noded(lines: DataFrame, fid: str = "fid") -> DataFrame:
    """fid, geom: every path (or ring) cut where it meets another feature."""
    from .overlay import candidates

    pairs = candidates(lines, lines, fid, fid).where("_a <> _b").groupBy("_a").agg(F.collect_list("_gb").alias("_others"))
    d = lines.select(F.col(fid).alias("fid"), "geom").join(pairs, F.col("fid") == F.col("_a"), "left")

    @F.pandas_udf(f"array<{E.GEOMETRY}>")
    def cut(g: pd.Series, others: pd.Series) -> pd.Series:
        out = []
        for x, o in zip(g, others):
            pieces = []
            near = [r for v in ([] if o is None else o) for p in K.to_numpy(v) for r in p]
            for part in K.to_numpy(x):
                for path in part:
                    n = K.path_length(path)
                    at = sorted({0.0, n, *[round(K.locate(path, q)[0], 9) for s in near if len(s) > 1 for q in K.crossings(path, s)]})
                    at = [v for i, v in enumerate(at) if not i or v - at[i - 1] > K.EPS]
                    got = [K.substring(path, a, b) for a, b in zip(at[:-1], at[1:])]
                    if len(got) > 1 and np.allclose(path[0], path[-1]) and not any(np.allclose(path[0], q) for s in near for q in s):
                        got = [np.concatenate([got[-1], got[0][1:]]), *got[1:-1]]
                    pieces += [K.from_numpy([[p]]) for p in got]
            out.append(pieces)
        return pd.Series(out, dtype=object)

    return d.select("fid", F.explode(cut("geom", "_others")).alias("geom"))


def feature_to_line(df: DataFrame, preserve_attributes: bool = True) -> DataFrame:
    """Lines and boundaries split where they meet their neighbours; the ends of a ring are one piece."""
    n = noded(df)
    return n.join(df.drop("geom"), "fid") if preserve_attributes else n


def polygonize(paths: list[np.ndarray], tolerance: float = 1e-3) -> list[K.Geometry]:
    """Bounded faces of noded paths, by walking each directed edge with its next to the left."""
    from collections import defaultdict

    snap = lambda p: (round(p[0] / tolerance) * tolerance, round(p[1] / tolerance) * tolerance)
    near: dict[tuple, set] = defaultdict(set)
    for path in paths:
        q = [snap(p) for p in path]
        for a, b in zip(q[:-1], q[1:]):
            if a != b:
                near[a].add(b)
                near[b].add(a)
    loose = [v for v in near if len(near[v]) == 1]
    while loose:  # dangling ends bound nothing
        v = loose.pop()
        for w in list(near.pop(v, ())):
            near[w].discard(v)
            if len(near[w]) == 1:
                loose.append(w)
    order = {v: sorted(ws, key=lambda w: math.atan2(w[1] - v[1], w[0] - v[0])) for v, ws in near.items() if ws}
    used, out = set(), []
    for v in sorted(order):
        for w in order[v]:
            if (v, w) in used:
                continue
            ring, a, b = [v], v, w
            while (a, b) not in used:
                used.add((a, b))
                ring.append(b)
                ws = order[b]
                a, b = b, ws[ws.index(a) - 1]
            r = np.array(ring)
            if len(r) > 3 and K.ring_area(r) > 0:
                out.append([[r]])
    return out


def feature_to_polygon(lines: DataFrame, tolerance: float = 1e-3, labels: DataFrame | None = None) -> DataFrame:
    """Faces of the noded lines, one task a connected network; label points give their attributes."""
    from ..plans.components import components

    pieces = noded(lines).withColumn("pid", F.monotonically_increasing_id())
    from ..plans.store import materialize

    pieces = materialize(pieces, "noded")
    end = lambda v: F.xxhash64(F.round(v.x / tolerance), F.round(v.y / tolerance))
    path = F.col("geom")[0][0]
    links = pieces.select(end(path[0]).alias("u"), end(F.element_at(path, -1)).alias("v"))
    parts = components(links)
    d = pieces.withColumn("node", end(path[0])).join(parts, "node", "left").withColumn("net", F.coalesce("component", "node"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        faces = polygonize([K.to_numpy(g)[0][0] for g in pdf.geom], tolerance)
        return pd.DataFrame({"net": [int(pdf.net.iloc[0])] * len(faces), "face": range(len(faces)), "geom": [K.from_numpy(f) for f in faces]})

    out = d.select("net", "geom").groupBy("net").applyInPandas(run, f"net long, face int, geom {E.GEOMETRY}").withColumn("fid", F.xxhash64("net", "face")).select("fid", "geom")
    if labels is None:
        return out
    from .joins import polygon_points

    first = polygon_points(out, labels.withColumnRenamed("fid", "label_fid")).withColumn("_rn", F.row_number().over(Window.partitionBy("poly_fid").orderBy("label_fid"))).where("_rn = 1").drop("_rn", "x", "y")
    return out.join(first, out["fid"] == first["poly_fid"], "left").drop("poly_fid")
