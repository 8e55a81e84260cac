"""Bucketed spatial joins: equality on grid cells, then the exact predicate.

Points fall into cells, boxes into the cells they touch, and Catalyst plans an ordinary equi-join that
adaptive execution can split where a cell is hot.  Nearest neighbours are joined on the leaves of a tree.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import quadtree


def cell(value: Column, size) -> Column:
    return F.floor(value / size).cast("long")


def point_pairs(left: DataFrame, right: DataFrame, radius: float, lx="x", ly="y", rx="x2", ry="y2") -> DataFrame:
    """Pairs of points within ``radius``, with their distance ``d``; column names must be distinct."""
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    a = left.withColumn("_cx", cell(F.col(lx), radius)).withColumn("_cy", cell(F.col(ly), radius))
    b = right.withColumn("_dx", F.explode(near)).withColumn("_dy", F.explode(near))
    b = b.withColumn("_cx", cell(F.col(rx), radius) + F.col("_dx")).withColumn("_cy", cell(F.col(ry), radius) + F.col("_dy")).drop("_dx", "_dy")
    d = F.hypot(F.col(lx) - F.col(rx), F.col(ly) - F.col(ry))
    return a.join(b, ["_cx", "_cy"]).withColumn("d", d).where(F.col("d") <= radius).drop("_cx", "_cy")


def box_points(boxes: DataFrame, points: DataFrame, size: float, x="x", y="y") -> DataFrame:
    """Points in the closed boxes xmin, ymin, xmax, ymax."""
    b = boxes.withColumn("_cx", F.explode(F.sequence(cell(F.col("xmin"), size), cell(F.col("xmax"), size)))).withColumn("_cy", F.explode(F.sequence(cell(F.col("ymin"), size), cell(F.col("ymax"), size))))
    p = points.withColumn("_cx", cell(F.col(x), size)).withColumn("_cy", cell(F.col(y), size))
    inside = F.col(x).between(F.col("xmin"), F.col("xmax")) & F.col(y).between(F.col("ymin"), F.col("ymax"))
    return p.join(b, ["_cx", "_cy"]).where(inside).drop("_cx", "_cy")


def box_pairs(left: DataFrame, right: DataFrame, size: float, l=("xmin", "ymin", "xmax", "ymax"), r=("xmin2", "ymin2", "xmax2", "ymax2")) -> DataFrame:
    """Pairs of closed boxes that meet; each pair once, in the cell of its lower left common corner.

    Grids of sizes ``size * 2^level``: a box has the level at which it touches at most four cells, and a
    pair meets in the grid of the larger of the two, so that a large box among small ones is not cut
    into many cells: a row has at most four copies a grid that it enters.
    """
    def own(n):
        return F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col(n[2]) - F.col(n[0]), F.col(n[3]) - F.col(n[1])) / size)).cast("int"))

    kinds = left.select(F.lit(0).alias("side"), own(l).alias("level")).union(right.select(F.lit(1), own(r))).distinct().collect()  # grids, some tens
    mine, others = (sorted({k.level for k in kinds if k.side == side}) for side in (0, 1))

    def levels(found):
        return F.array(*map(F.lit, found)).cast("array<int>")

    def spread(df, n, grids):
        """One row a grid (level, whose own it is) and cell."""
        d = df.withColumn("_g", F.explode(grids)).withColumn("_w", F.lit(size) * F.pow(F.lit(2.0), F.col("_g.level")))
        d = d.withColumn("_cx", F.explode(F.sequence(cell(F.col(n[0]), F.col("_w")), cell(F.col(n[2]), F.col("_w")))))
        return d.withColumn("_cy", F.explode(F.sequence(cell(F.col(n[1]), F.col("_w")), cell(F.col(n[3]), F.col("_w"))))).select(*df.columns, "_w", "_cx", "_cy", F.col("_g.level").alias("_level"), F.col("_g.of").alias("_of"))

    def grids(n, of, found, strictly):
        level = own(n)
        at = lambda v, k: F.struct(v.cast("int").alias("level"), F.lit(k).alias("of"))
        above = F.filter(levels(found), lambda v: v > level if strictly else v >= level)
        return F.concat(F.array(at(level, of)), F.transform(above, lambda v: at(v, 1 - of)))

    # in a grid of the left (0) the right box is no larger; in a grid of the right (1) the left box is smaller
    a, b = spread(left, l, grids(l, 0, others, True)), spread(right, r, grids(r, 1, mine, False)).drop("_w")
    j = a.join(b, ["_level", "_of", "_cx", "_cy"])
    meets = (F.col(l[0]) <= F.col(r[2])) & (F.col(r[0]) <= F.col(l[2])) & (F.col(l[1]) <= F.col(r[3])) & (F.col(r[1]) <= F.col(l[3]))
    w = F.col("_w")
    first = (F.col("_cx") == cell(F.greatest(F.col(l[0]), F.col(r[0])), w)) & (F.col("_cy") == cell(F.greatest(F.col(l[1]), F.col(r[1])), w))
    return j.where(meets & first).drop("_level", "_of", "_w", "_cx", "_cy")


def extent(points: DataFrame, x="x", y="y"):
    """Row of n, xmin, ymin, xmax, ymax."""
    return points.agg(F.count(x).alias("n"), F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax")).first()


def _fewer(right: DataFrame, rid: str, k: int) -> DataFrame:
    """At most k points of least id at each place; a place is ranked in parts first."""
    for by in (["x2", "y2", F.pmod(F.xxhash64(rid), F.lit(256))], ["x2", "y2"]):
        right = right.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(rid))).where(F.col("_place") <= k)
    return right.drop("_place")


def nearest(left: DataFrame, right: DataFrame, k: int = 1, lid="id", rid="id2", exclude_self: bool = False, within: float | None = None) -> DataFrame:
    """The k nearest right points (rid, x2, y2) of each left point (lid, x, y): lid, rid, d, rank.

    A quadtree of the right points, of bounded size, tells each left point the leaves that may hold its
    neighbours and how far they can be; one equi-join on the leaf and one ranking follow.  Ties go to the
    smaller rid; points without a place have no neighbours.
    """
    right = right.select(rid, F.col("x2").cast("double").alias("x2"), F.col("y2").cast("double").alias("y2")).where("x2 is not null and y2 is not null and not isnan(x2) and not isnan(y2)")
    e, kind = extent(right, "x2", "y2"), left.schema[lid].dataType.simpleString()
    if not e.n:
        return left.select(lid).where("false").select(lid, F.lit(None).cast("long").alias(rid), F.lit(0.0).alias("d"), F.lit(0).alias("rank"))
    wide = max(e.xmax - e.xmin, e.ymax - e.ymin, 1e-9) * (1 + 1e-9)
    tree, wanted = quadtree.build(right, e.n, (e.xmin, e.ymin), wide), k + int(exclude_self)
    if ((tree.level == quadtree.DEPTH) & (tree.n > quadtree.LEAF)).any():
        right = _fewer(right, rid, wanted)
    sent, limit = left.sparkSession.sparkContext.broadcast(tree), float("inf") if within is None else float(within)

    def probe(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at : at + 2000]
                who, leaf, radius = sent.value.needed(part.x.to_numpy(float), part.y.to_numpy(float), wanted, limit)
                yield part.iloc[who].assign(leaf=leaf, reach=radius)

    @F.pandas_udf("long")
    def leaf_of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(sent.value.leaf(x.to_numpy(), y.to_numpy()))

    places = left.select(lid, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    asked = places.mapInPandas(probe, f"`{lid}` {kind}, x double, y double, leaf long, reach double")
    pairs = asked.join(right.withColumn("leaf", leaf_of("x2", "y2")), "leaf").withColumn("d", F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")))
    pairs = pairs.where((F.col("d") <= F.col("reach")) & (F.col("d") <= F.lit(limit)))
    if exclude_self:
        pairs = pairs.where(F.col(lid) != F.col(rid))
    order = Window.partitionBy(lid).orderBy("d", rid)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(lid, rid, "d", "rank")


def near_leaves(left: DataFrame, right: DataFrame, lid: str, slack: float) -> DataFrame | None:
    """Left rows (lid, x, y) with the right rows (x2, y2 and others) of the quadtree leaves that may hold the nearest right point, or one farther than that by ``slack`` at most; None without right rows.

    Places are whole: all rows at one place are in one leaf.
    """
    right = right.where("x2 is not null and y2 is not null and not isnan(x2) and not isnan(y2)")
    e, kind = extent(right, "x2", "y2"), left.schema[lid].dataType.simpleString()
    if not e.n:
        return None
    wide = max(e.xmax - e.xmin, e.ymax - e.ymin, 1e-9) * (1 + 1e-9)
    sent = left.sparkSession.sparkContext.broadcast(quadtree.build(right, e.n, (e.xmin, e.ymin), wide))

    def probe(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at : at + 2000]
                who, leaf, reach = sent.value.needed(part.x.to_numpy(float), part.y.to_numpy(float), 1, float("inf"), slack)
                yield part.iloc[who].assign(leaf=leaf, reach=reach)

    @F.pandas_udf("long")
    def leaf_of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(sent.value.leaf(x.to_numpy(), y.to_numpy()))

    places = left.where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    asked = places.select(lid, "x", "y").mapInPandas(probe, f"`{lid}` {kind}, x double, y double, leaf long, reach double")
    pairs = asked.join(right.withColumn("leaf", leaf_of("x2", "y2")), "leaf")
    return pairs.where(F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) <= F.col("reach")).drop("leaf", "reach", "x2", "y2")
