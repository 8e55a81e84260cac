"""Attribute, nearest-neighbour and containment joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import kernels as K
from ..functions import expr as E
from ..plans import cells as C
from ..plans.rows import binary_udf, geometry_udf
from .overlay import _renamed, candidates
from .summary import parse


def attribute_join(left: DataFrame, key: str, right: DataFrame, foreign: str, how: str = "INNER") -> DataFrame:
    """One-to-one: the first right row of a key in the order of its columns; clashing names get _1, _2, ..."""
    order = Window.partitionBy(foreign).orderBy(*[F.col(c) for c, t in right.dtypes if not t.startswith(("array", "map", "struct"))])
    first = right.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
    names = _renamed(first, left.columns)
    r = first.select(*[F.col(c).alias(n) for c, n in names.items()])
    return left.join(r, left[key] == r[names[foreign]], "inner" if how.upper() == "INNER" else "left")


def _left(df: DataFrame, fid: str) -> DataFrame:
    return E.with_xy(df).select(F.col(fid).alias("id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))


def _right(df: DataFrame, fid: str) -> DataFrame:
    return E.with_xy(df).select(F.col(fid).alias("id2"), F.col("x").cast("double").alias("x2"), F.col("y").cast("double").alias("y2"))


def spatial_join(left: DataFrame, right: DataFrame, keep_all: bool = True, radius: float = 0.0, fid: str = "fid") -> DataFrame:
    """Attributes of the nearest right point; beyond a radius they are null, or the row goes."""
    near = C.nearest(_left(left, fid), _right(right, fid), 1, within=radius or None).select("id", "id2", F.col("d").alias("_d"))
    names = _renamed(right, left.columns)
    r = right.select(*[F.col(c).alias(n) for c, n in names.items()])
    return left.join(near, left[fid] == near["id"], "left" if keep_all else "inner").join(r, F.col("id2") == r[names[fid]], "left").drop("id", "id2", "_d")


def near(left: DataFrame, right: DataFrame, id_field: str | None = None, maximum: float = 0.0, fid: str = "fid") -> DataFrame:
    """Nearest id and near_dist; beyond the maximum the distance is null but the id stays."""
    rid = id_field or fid
    n = C.nearest(_left(left, fid), _right(right, rid), 1).select(F.col("id").alias("_id"), F.col("id2").alias("near_id"), (F.when(F.col("d") <= maximum, F.col("d")) if maximum else F.col("d")).alias("near_dist"))
    return left.join(n, left[fid] == n["_id"], "left").drop("_id")


def nearest_neighbor_count(left: DataFrame, right: DataFrame, count: str = "count", radius: float = 0.0, fid: str = "fid", right_id: str = "fid") -> DataFrame:
    """Each near feature counts for its nearest input feature."""
    n = C.nearest(_left(right, right_id), _right(left, fid), 1, within=radius or None).groupBy(F.col("id2").alias("_id")).agg(F.count("*").alias(count))
    return left.join(n, left[fid] == n["_id"], "left").drop("_id").na.fill(0, [count])


def _line(ax, ay, bx, by):
    return F.array(F.array(F.array(F.struct(F.col(ax).alias("x"), F.col(ay).alias("y")), F.struct(F.col(bx).alias("x"), F.col(by).alias("y")))))


def knn_map(df: DataFrame, k: int = 1, convex_hull: bool = False, fid: str = "fid") -> DataFrame:
    """Lines from each point to its k nearest others; coincident ones are dropped."""
    n = C.nearest(_left(df, fid), _right(df, fid), k, exclude_self=True).where("d > 0")
    e = n.join(_left(df, fid), "id").join(_right(df, fid), "id2")
    out = e.select(F.col("id").alias("from_id"), F.col("id2").alias("to_id"), F.col("d").alias("distance"), "rank", _line("x", "y", "x2", "y2").alias("geom"))
    if convex_hull:
        h = K.convex_hull(K.hull_candidates(df))
        row = [(None, None, K.path_length(h), 0, K.from_numpy([[h]]))]
        out = out.unionByName(df.sparkSession.createDataFrame(row, out.schema))
    return out


def knn_circle(left: DataFrame, right: DataFrame, k: int = 1, maximum: float = 0.0, fid: str = "fid", right_id: str = "fid") -> DataFrame:
    """Circle to the farthest of the k nearest features within the maximum; radius 0 is skipped."""
    n = C.nearest(_left(left, fid), _right(right, right_id), k, within=maximum or None).groupBy(F.col("id").alias("_id")).agg(F.max("d").alias("radius"), F.count("*").alias("neighbors")).where("radius > 0")
    return left.join(n, left[fid] == n["_id"]).drop("_id").withColumn("geom", E.circle(F.col("x"), F.col("y"), F.col("radius")))


def _bezier(geom: K.Geometry) -> K.Geometry:
    a, b = geom[0][0][0], geom[0][0][-1]
    m = (a + b) / 2 + (b - a)[::-1] * (-0.2, 0.2)
    t = (K.np.arange(21) / 20)[:, None]
    return [[(1 - t) ** 2 * a + 2 * (1 - t) * t * m + t**2 * b]]


def hub_lines_by_distance(hubs: DataFrame, spokes: DataFrame, maximum: float = 0.0, bezier: bool = False, fid: str = "fid", hub_id: str = "fid") -> DataFrame:
    n = C.nearest(_left(spokes, fid), _right(hubs, hub_id), 1, within=maximum or None).where("d > 0")
    e = n.join(_left(spokes, fid), "id").join(_right(hubs, hub_id), "id2")
    out = e.select(F.col("id").alias("spoke_id"), F.col("id2").alias("hub_id"), F.col("d").alias("hub_dist"), _line("x2", "y2", "x", "y").alias("geom"))
    return out.withColumn("geom", geometry_udf(_bezier)) if bezier else out


def hub_lines_by_id(hubs: DataFrame, hub_field: str, spokes: DataFrame, spoke_field: str, maximum: float = 0.0, bezier: bool = False) -> DataFrame:
    """Equal ids, null matching null; 0 length and lines beyond the maximum are dropped."""
    h = hubs.select(F.col(hub_field).alias("hub_id"), F.col("x").alias("_hx"), F.col("y").alias("_hy"))
    e = spokes.join(h, F.col(spoke_field).eqNullSafe(F.col("hub_id"))).withColumn("hub_dist", F.hypot(F.col("x") - F.col("_hx"), F.col("y") - F.col("_hy"))).where("hub_dist > 0")
    e = e.where(F.col("hub_dist") <= maximum) if maximum else e
    out = e.withColumn("geom", _line("_hx", "_hy", "x", "y")).drop("_hx", "_hy")
    return out.withColumn("geom", geometry_udf(_bezier)) if bezier else out


def segments(lines: DataFrame, fid: str = "fid") -> DataFrame:
    """lid, seg, ax, ay, bx, by."""
    d = lines.select(F.col(fid).alias("lid"), F.posexplode(F.flatten("geom")).alias("part", "path"))
    d = d.select("lid", "part", F.posexplode(E.pairs(F.col("path"))).alias("seg", "e"))
    return d.select("lid", "part", "seg", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def points_near_segments(points: DataFrame, lines: DataFrame, reach: float, fid: str = "fid", lid: str = "fid") -> DataFrame:
    """pid, lid, d, px, py: the nearest place of each segment within ``reach`` of a point."""
    s = segments(lines, lid)
    size = max(reach, s.agg(F.avg(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))).first()[0] or 1.0)
    boxes = s.withColumn("xmin", F.least("ax", "bx") - reach).withColumn("xmax", F.greatest("ax", "bx") + reach).withColumn("ymin", F.least("ay", "by") - reach).withColumn("ymax", F.greatest("ay", "by") + reach)
    m = C.box_points(boxes, points.select(F.col(fid).alias("pid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), size)
    return _on_segments(m).where(F.col("d") <= reach)


def _on_segments(m: DataFrame) -> DataFrame:
    """The place (px, py) of each segment that is nearest to the point x, y beside it, and its distance d."""
    ux, uy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = F.coalesce(F.try_divide((F.col("x") - F.col("ax")) * ux + (F.col("y") - F.col("ay")) * uy, ux * ux + uy * uy), F.lit(0.0))
    m = m.withColumn("_t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))).withColumn("px", F.col("ax") + F.col("_t") * ux).withColumn("py", F.col("ay") + F.col("_t") * uy)
    return m.withColumn("d", F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))).select("pid", "lid", "part", "seg", "d", "px", "py")


def points_nearest_segments(points: DataFrame, lines: DataFrame, fid: str = "fid", lid: str = "fid") -> DataFrame:
    """pid, lid, part, seg, d, px, py of segments among which is the nearest of each point, whatever its distance.

    Segments are cut into pieces of one length, at most about nine times as many.  A quadtree of their middles tells the
    leaves that hold the nearest middle; the nearest segment has a middle farther than that by half a piece at most.
    """
    ends = [F.col(c).cast("double").alias(c) for c in ("ax", "ay", "bx", "by")]
    s = segments(lines, lid).select("lid", "part", "seg", *ends).dropna(subset=["ax", "ay", "bx", "by"])
    long = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    step = (s.agg(F.avg(long)).first()[0] or 0.0) / 8
    n = F.greatest(F.lit(1), F.ceil(long / step)).cast("int") if step else F.lit(1)
    at = (F.col("_i") + 0.5) / F.col("_n")
    pieces = s.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn("x2", F.col("ax") + at * (F.col("bx") - F.col("ax"))).withColumn("y2", F.col("ay") + at * (F.col("by") - F.col("ay"))).drop("_n", "_i")
    p = points.select(F.col(fid).alias("pid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    m = C.near_leaves(p, pieces, "pid", step / 2)
    return _on_segments(m) if m is not None else None


def snap_points_to_lines(points: DataFrame, lines: DataFrame, tolerance: float = 0.0, fid: str = "fid") -> DataFrame:
    """Points move to the nearest place of the nearest line; unmatched points stay."""
    near = points_near_segments(points, lines, tolerance, fid) if tolerance else points_nearest_segments(points, lines, fid)
    if near is None:
        return points.withColumn("snap_dist", F.lit(None).cast("double"))
    best = near.groupBy(F.col("pid").alias("_pid")).agg(F.min(F.struct("d", "lid", "part", "seg", "px", "py")).alias("_m"))
    d = points.join(best, points[fid] == best["_pid"], "left")
    return d.withColumn("x", F.coalesce("_m.px", "x")).withColumn("y", F.coalesce("_m.py", "y")).withColumn("snap_dist", F.col("_m.d")).drop("_m", "_pid")


def polygon_points(polygons: DataFrame, points: DataFrame) -> DataFrame:
    """fid of the polygon with each point's columns, for points in or on it."""
    from .overlay import boxed, cell_size

    p = boxed(polygons.select(F.col("fid").alias("_fid"), "geom"))
    for n in ("xmin", "ymin", "xmax", "ymax"):
        p = p.withColumnRenamed(f"_{n}", n)
    m = C.box_points(p, points, cell_size(polygons))

    @F.pandas_udf("boolean")
    def inside(f: pd.Series, g: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        found = K.np.zeros(len(g), bool)
        for rows in f.groupby(f, sort=False).indices.values():  # the points of one polygon together
            found[rows] = K.contains(K.to_numpy(g.iloc[rows[0]]), K.np.column_stack([x.iloc[rows], y.iloc[rows]]))
        return pd.Series(found)

    v = F.col("geom")[0][0]
    box = (F.size("geom") == 1) & (F.size(F.col("geom")[0]) == 1) & (F.size(v) == 5) & (v[0].x == v[3].x) & (v[1].x == v[2].x) & (v[0].y == v[1].y) & (v[2].y == v[3].y)
    exact = m.where(box).unionByName(m.where(~box).where(inside(F.hash("geom"), "geom", F.col("x").cast("double"), F.col("y").cast("double"))))
    return exact.drop("geom", "xmin", "ymin", "xmax", "ymax").withColumnRenamed("_fid", "poly_fid")


def point_statistics(polygons: DataFrame, points: DataFrame, statistics: str | None = None, count: str = "count") -> DataFrame:
    """Count and STAT.field summaries of the points in each polygon; null statistics where there are none."""
    s = polygon_points(polygons, points).groupBy("poly_fid").agg(F.count("*").alias(count), *parse(statistics))
    return polygons.join(s, polygons["fid"] == s["poly_fid"], "left").drop("poly_fid").na.fill(0, [count])


def buffer_point_statistics(df: DataFrame, distance: float, points: DataFrame, statistics: str | None = None, count: str = "count") -> DataFrame:
    """Statistics of the points within a distance of each point feature; other features are buffered first."""
    if "x" in df.columns:
        right = points.withColumn("x2", F.col("x").cast("double")).withColumn("y2", F.col("y").cast("double")).drop("x", "y")
        m = C.point_pairs(df.select(F.col("fid").alias("_fid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), right, distance)
        s = m.groupBy("_fid").agg(F.count("*").alias(count), *parse(statistics))
        return df.join(s, df["fid"] == s["_fid"], "left").drop("_fid").na.fill(0, [count])
    from .buffers import buffer_features

    return point_statistics(buffer_features(df, str(distance), 12), points, statistics, count)


def sum_line_length(polygons: DataFrame, lines: DataFrame, length: str = "sum_len", count: str = "line_cnt") -> DataFrame:
    inside = lambda g, l: float(sum(K.path_length(p) for part in l for path in part for p in K.clip_path(path, g)))
    m = candidates(polygons, lines).withColumn("_len", binary_udf(inside)("_ga", "_gb")).where("_len > 0")
    s = m.groupBy("_a").agg(F.sum("_len").alias(length), F.count("*").alias(count))
    return polygons.join(s, polygons["fid"] == s["_a"], "left").drop("_a").na.fill(0, [length, count])
