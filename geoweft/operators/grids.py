"""Binning and generated grids, points and roses."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import circle, rectangle
from ..plans import cells

Extent = tuple[float, float, float, float]
#: Parts into which polygons are dealt to add up their areas.
PARTS = 1024


def _weighted(df: DataFrame, weight: str | None, x: str, y: str) -> DataFrame:
    """Rows whose weight evaluates to null are skipped."""
    w = F.expr(weight).cast("double") if weight else F.lit(1.0)
    return df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), w.alias("w")).where("w is not null and x is not null and y is not null")


def _box(df: DataFrame, bbox: Extent | None, x: str, y: str) -> Extent:
    if bbox:
        return bbox
    e = cells.extent(df, x, y)
    return (e.xmin or 0.0, e.ymin or 0.0, e.xmax or 0.0, e.ymax or 0.0)


def lattice(spark: SparkSession, cols: int, rows: int) -> DataFrame:
    """col, row and a row-major uid from 1."""
    return spark.range(cols * rows).select((F.col("id") % cols).alias("col"), F.floor(F.col("id") / cols).alias("row"), (F.col("id") + 1).alias("uid"))


def _filled(spark, sums: DataFrame, cols: int, rows: int, valid: bool) -> DataFrame:
    if valid:
        return sums.withColumn("uid", F.col("row") * cols + F.col("col") + 1)
    return lattice(spark, cols, rows).join(sums, ["col", "row"], "left").na.fill(0.0, ["val"])


def rectangular_binning(df: DataFrame, width: float, height: float, weight: str | None = None, bbox: Extent | None = None, valid_grid: bool = True, x="x", y="y", geometry: bool = True) -> DataFrame:
    """Sum of weight a cell from the lower left; points outside the grid are ignored."""
    b = _box(df, bbox, x, y)
    cols, rows = max(1, math.ceil((b[2] - b[0]) / width)), max(1, math.ceil((b[3] - b[1]) / height))
    if (b[2] - b[0]) / width == cols:
        cols += 0 if bbox else 1
    if (b[3] - b[1]) / height == rows:
        rows += 0 if bbox else 1
    c, r = F.floor((F.col("x") - F.lit(b[0])) / width), F.floor((F.col("y") - F.lit(b[1])) / height)
    s = _weighted(df, weight, x, y).select(c.alias("col"), r.alias("row"), "w").where(F.col("col").between(0, cols - 1) & F.col("row").between(0, rows - 1)).groupBy("col", "row").agg(F.sum("w").alias("val"))
    out = _filled(df.sparkSession, s, cols, rows, valid_grid)
    if geometry:
        x0, y0 = F.lit(b[0]) + F.col("col") * width, F.lit(b[1]) + F.col("row") * height
        out = out.withColumn("geom", rectangle(x0, y0, x0 + width, y0 + height))
    return out


def circular_binning(df: DataFrame, radius: float, weight: str | None = None, bbox: Extent | None = None, valid_grid: bool = True, x="x", y="y", geometry: bool = True) -> DataFrame:
    b = _box(df, bbox, x, y)
    out = rectangular_binning(df, 2 * radius, 2 * radius, weight, b if bbox else None, valid_grid, x, y, False)
    return out.withColumn("geom", circle(F.lit(b[0]) + F.col("col") * 2 * radius + radius, F.lit(b[1]) + F.col("row") * 2 * radius + radius, F.lit(float(radius)))) if geometry else out


def hexagon(cx: Column, cy: Column, side: float, pointy: bool = True) -> Column:
    start = 30 if pointy else 0
    pts = [F.struct((cx + side * math.cos(math.radians(start + 60 * (i % 6)))).alias("x"), (cy + side * math.sin(math.radians(start + 60 * (i % 6)))).alias("y")) for i in range(7)]
    return F.array(F.array(F.array(*pts)))


def hexagonal_binning(df: DataFrame, size: float, weight: str | None = None, bbox: Extent | None = None, valid_grid: bool = True, x="x", y="y", geometry: bool = True) -> DataFrame:
    """Pointy-top hexagons: rows 1.5 size apart, columns sqrt(3) size, odd rows shifted by half a column."""
    b = _box(df, bbox, x, y)
    dx, dy = math.sqrt(3) * size, 1.5 * size
    px, py = (F.col("x") - F.lit(b[0])) / dx, (F.col("y") - F.lit(b[1])) / dy
    d = _weighted(df, weight, x, y).withColumn("_py", F.round(py)).withColumn("_shift", F.when(F.pmod(F.col("_py"), F.lit(2)) == 1, 0.5).otherwise(0.0))
    d = d.withColumn("_px", F.round(px - F.col("_shift"))).withColumn("_fy", py - F.col("_py")).withColumn("_fx", px - F.col("_shift") - F.col("_px"))
    # the only other candidate is the nearest centre in the neighbouring row
    row2 = F.col("_py") + F.when(F.col("_fy") < 0, -1.0).otherwise(1.0)
    odd2 = F.when(F.pmod(row2, F.lit(2)) == 1, 0.5).otherwise(0.0)
    d = d.withColumn("_row2", row2).withColumn("_col2", F.round(px - odd2)).withColumn("_fx2", px - odd2 - F.round(px - odd2)).withColumn("_fy2", py - row2)
    near = F.pow(F.col("_fx") * dx, F.lit(2)) + F.pow(F.col("_fy") * dy, F.lit(2)) <= F.pow(F.col("_fx2") * dx, F.lit(2)) + F.pow(F.col("_fy2") * dy, F.lit(2))
    d = d.select(F.when(near, F.col("_px")).otherwise(F.col("_col2")).cast("long").alias("col"), F.when(near, F.col("_py")).otherwise(F.col("_row2")).cast("long").alias("row"), "w")
    s = d.groupBy("col", "row").agg(F.sum("w").alias("val"))
    cols, rows = int((b[2] - b[0]) / dx) + 2, int((b[3] - b[1]) / dy) + 2
    if not valid_grid:
        s = df.sparkSession.range((cols + 1) * (rows + 1)).select((F.col("id") % (cols + 1) - 1).alias("col"), F.floor(F.col("id") / (cols + 1)).alias("row")).join(s, ["col", "row"], "left").na.fill(0.0, ["val"])
    if geometry:
        cx = F.lit(b[0]) + (F.col("col") + F.when(F.pmod("row", F.lit(2)) == 1, 0.5).otherwise(0.0)) * dx
        s = s.withColumn("geom", hexagon(cx, F.lit(b[1]) + F.col("row") * dy, size))
    return s


def _bounded(grid: DataFrame, bounds: DataFrame | None, inside: bool) -> DataFrame:
    """Cells that meet (or, if ``inside``, lie in) a bounds polygon."""
    if bounds is None:
        return grid
    from . import overlay

    return overlay.semi_join(grid, bounds, "contains" if inside else "intersects")


def fishnet(spark: SparkSession, extent: Extent, columns: int, rows: int, bounds: DataFrame | None = None, inside: bool = False, circles: bool = False) -> DataFrame:
    w, h = (extent[2] - extent[0]) / columns, (extent[3] - extent[1]) / rows
    x0, y0 = F.lit(extent[0]) + F.col("col") * w, F.lit(extent[1]) + F.col("row") * h
    shape = circle(x0 + w / 2, y0 + h / 2, F.lit(min(w, h) / 2)) if circles else rectangle(x0, y0, x0 + w, y0 + h)
    return _bounded(lattice(spark, columns, rows).withColumn("geom", shape), bounds, inside)


def fishnet_by_size(spark: SparkSession, extent: Extent, width: float, height: float, bounds: DataFrame | None = None, inside: bool = False) -> DataFrame:
    """Cells of a given size; the count rounds half up and grows by one where it falls short."""
    cols, rows = math.floor((extent[2] - extent[0]) / width + 0.5), math.floor((extent[3] - extent[1]) / height + 0.5)
    cols += cols * width < extent[2] - extent[0]
    rows += rows * height < extent[3] - extent[1]
    return fishnet(spark, (extent[0], extent[1], extent[0] + cols * width, extent[1] + rows * height), int(cols), int(rows), bounds, inside)


def hexagon_grid(spark: SparkSession, extent: Extent, side: float, orientation: str = "FLAT", bounds: DataFrame | None = None) -> DataFrame:
    """Flat or angled hexagons over the extent grown by the side."""
    x0, y0, x1, y1 = extent[0] - side, extent[1] - side, extent[2] + side, extent[3] + side
    if orientation == "FLAT":
        dx, dy = 1.5 * side, math.sqrt(3) * side
        cols, rows = math.ceil((x1 - x0) / dx) + 1, math.ceil((y1 - y0) / dy) + 1
        cx = F.lit(x0) + F.col("col") * dx
        cy = F.lit(y0) + (F.col("row") + F.when(F.col("col") % 2 == 1, 0.5).otherwise(0.0)) * dy
    else:
        dx, dy = math.sqrt(3) * side, 1.5 * side
        cols, rows = math.ceil((x1 - x0) / dx) + 1, math.ceil((y1 - y0) / dy) + 1
        cx = F.lit(x0) + (F.col("col") + F.when(F.col("row") % 2 == 1, 0.5).otherwise(0.0)) * dx
        cy = F.lit(y0) + F.col("row") * dy
    return _bounded(lattice(spark, cols, rows).withColumn("geom", hexagon(cx, cy, side, orientation != "FLAT")), bounds, False)


def triangular_grid(spark: SparkSession, extent: Extent, size: float, orientation: str = "FLAT", bounds: DataFrame | None = None) -> DataFrame:
    """Equilateral triangles of side ``size``, pointing up and down in turn."""
    h = size * math.sqrt(3) / 2
    flat = orientation == "FLAT"
    wide, high = (extent[2] - extent[0], extent[3] - extent[1]) if flat else (extent[3] - extent[1], extent[2] - extent[0])
    cols, rows = math.ceil(wide / (size / 2)) + 1, math.ceil(high / h)
    u0 = (F.col("col") - 1) * (size / 2)
    v0, v1 = F.col("row") * h, (F.col("row") + 1) * h
    up = (F.col("col") + F.col("row")) % 2 == 0
    low, high_ = F.when(up, v0).otherwise(v1), F.when(up, v1).otherwise(v0)
    pts = [(u0, low), (u0 + size, low), (u0 + size / 2, high_), (u0, low)]
    ring = [F.struct((F.lit(extent[0]) + (u if flat else v)).alias("x"), (F.lit(extent[1]) + (v if flat else u)).alias("y")) for u, v in pts]
    return _bounded(lattice(spark, cols, rows).withColumn("geom", F.array(F.array(F.array(*ring)))), bounds, False)


def circular_grid(spark: SparkSession, extent: Extent, radius: float, kind: str = "Grid", bounds: DataFrame | None = None) -> DataFrame:
    if kind == "Grid":
        cols, rows = math.ceil((extent[2] - extent[0]) / (2 * radius)), math.ceil((extent[3] - extent[1]) / (2 * radius))
        cx, cy = F.lit(extent[0]) + F.col("col") * 2 * radius + radius, F.lit(extent[1]) + F.col("row") * 2 * radius + radius
    else:
        dy = radius * math.sqrt(3)
        cols, rows = math.ceil((extent[2] - extent[0]) / (2 * radius)) + 1, math.ceil((extent[3] - extent[1]) / dy) + 1
        cx = F.lit(extent[0]) + (F.col("col") + F.when(F.col("row") % 2 == 1, 0.5).otherwise(0.0)) * 2 * radius
        cy = F.lit(extent[1]) + F.col("row") * dy
    return _bounded(lattice(spark, cols, rows).withColumn("geom", circle(cx, cy, F.lit(float(radius)))), bounds, False)


def sector(cx: Column, cy: Column, inner: Column, outer: Column, start: Column, width: Column, steps: int = 16) -> Column:
    """Annular sector; angles in degrees clockwise from north."""
    def arc(r, back):
        i = F.sequence(F.lit(steps), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(steps))
        return F.transform(i, lambda k: F.struct((cx + r * F.sin(F.radians(start + width * k / steps))).alias("x"), (cy + r * F.cos(F.radians(start + width * k / steps))).alias("y")))

    rim = F.concat(arc(outer, False), F.when(inner > 0, arc(inner, True)).otherwise(F.array(F.struct(cx.alias("x"), cy.alias("y")))))
    return F.array(F.array(F.concat(rim, F.slice(rim, 1, 1))))


def polar_grids(origins: DataFrame, radii: list[float], kind: str = "Polar", sides: int = 8, x="x", y="y") -> DataFrame:
    """Sides x sorted radii annular sectors round each origin; half a step of offset unless Base."""
    step = 360 / sides
    rs = sorted(radii)
    ring = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("inner"), F.lit(float(b)).alias("radius")) for a, b in zip([0.0, *rs[:-1]], rs)])).alias("_r")
    d = origins.select("*", ring).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))).withColumn("angle", F.col("_i") * step)
    start = F.col("angle") - (0.0 if kind == "Base" else step / 2)
    names = F.array(*[F.lit(n) for n in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    d = d.withColumn("radius", F.col("_r.radius")).withColumn("geom", sector(F.col(x), F.col(y), F.col("_r.inner"), F.col("_r.radius"), start, F.lit(step)))
    if sides == 8:
        d = d.withColumn("azimuth", F.element_at(names, F.col("_i") + 1))
    return d.drop("_r", "_i")


def polar_grids_from_point(spark: SparkSession, origin: tuple[float, float], radii: list[float], kind: str = "Polar", sides: int = 8) -> DataFrame:
    """The same round one place."""
    one = spark.createDataFrame([(1, float(origin[0]), float(origin[1]))], "fid int, x double, y double")
    return polar_grids(one, radii, kind, sides)


def random_points(spark: SparkSession, extent: Extent, count: int = 1000, polygons: DataFrame | None = None, seed: int = 1) -> DataFrame:
    """Uniform points in the extent or in the polygons (by area), weight 1; seeded."""
    if polygons is None:
        r = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1 << 52)) / float(1 << 52))
        return spark.range(count).select((F.col("id") + 1).alias("fid"), (F.lit(extent[0]) + r(1) * (extent[2] - extent[0])).alias("x"), (F.lit(extent[1]) + r(2) * (extent[3] - extent[1])).alias("y"), F.lit(1).alias("weight"))
    from ..functions.expr import area

    sized = polygons.withColumn("_a", area(F.col("geom")))
    # the points are numbers 0 to count - 1; a polygon gets those in its stretch of the total area
    order = Window.orderBy("_part")
    parts = sized.withColumn("_part", F.pmod(F.xxhash64("fid"), F.lit(PARTS)))
    sums = parts.groupBy("_part").agg(F.sum("_a").alias("_sum"))
    sums = sums.withColumn("_base", F.sum("_sum").over(order) - F.col("_sum")).withColumn("_total", F.sum("_sum").over(Window.partitionBy())).drop("_sum")
    within = F.sum("_a").over(Window.partitionBy("_part").orderBy("fid"))
    shares = parts.withColumn("_high", within).join(F.broadcast(sums), "_part")
    cut = lambda v: F.least(F.ceil(v / F.col("_total") * count - 1e-9), F.lit(count)).cast("int")
    shares = shares.withColumn("_n", cut(F.col("_base") + F.col("_high")) - cut(F.col("_base") + F.col("_high") - F.col("_a")))
    return random_points_per_feature(shares, "_n", seed).withColumn("weight", F.lit(1)).select("fid", "x", "y", "weight")


def random_points_per_feature(polygons: DataFrame, expression: str, seed: int = 1, fid: str = "fid") -> DataFrame:
    """Expression-many points in each polygon, drawn by trapezoids, so none is rejected; a polygon without area gets none."""
    from .. import kernels

    d = polygons.select(F.col(fid).cast("long").alias("fid"), "geom", F.expr(expression).cast("int").alias("n")).where("n > 0")

    def run(batches):
        import numpy as np

        for pdf in batches:
            out = []
            for f, g, n in zip(pdf.fid, pdf.geom, pdf.n):
                rng = np.random.default_rng([seed, int(f) & 0xFFFFFFFF])
                out += [(f, i + 1, a, b) for i, (a, b) in enumerate(kernels.random_points(kernels.to_numpy(g), rng, n).tolist())]
            yield pd.DataFrame(out, columns=["fid", "num", "x", "y"])

    return d.mapInPandas(run, "fid long, num int, x double, y double")


def regular_points(spark: SparkSession, extent: Extent, width: float, height: float, unit: str = "Count", bounds: DataFrame | None = None) -> DataFrame:
    """Cell-centre lattice, by number of columns and rows or by distance."""
    w, h = extent[2] - extent[0], extent[3] - extent[1]
    cols, rows = (int(width), int(height)) if unit == "Count" else (max(1, int(w // width)), max(1, int(h // height)))
    dx, dy = (w / cols, h / rows) if unit == "Count" else (width, height)
    p = lattice(spark, cols, rows).withColumn("x", F.lit(extent[0]) + (F.col("col") + 0.5) * dx).withColumn("y", F.lit(extent[1]) + (F.col("row") + 0.5) * dy)
    if bounds is None:
        return p
    from . import overlay

    g = p.withColumn("geom", F.array(F.array(F.array(F.struct("x", "y")))))
    return overlay.semi_join(g, bounds, "intersects").drop("geom")


def wind_rose(df: DataFrame, weight: str | None = None, center: tuple[float, float] | None = None, sectors: int = 36, x="x", y="y") -> dict[str, DataFrame]:
    """Statistics a sector round the centre, and anchor rings; radius is the diagonal over 1.98."""
    e = cells.extent(df, x, y)
    c = center or ((e.xmin + e.xmax) / 2, (e.ymin + e.ymax) / 2)
    radius, step = math.hypot(e.xmax - e.xmin, e.ymax - e.ymin) / 1.98, 360 / sectors
    w = F.coalesce(F.expr(weight).cast("double"), F.lit(0.0)) if weight else F.lit(1.0)
    angle = F.pmod(F.degrees(F.atan2(F.col(x) - c[0], F.col(y) - c[1])) + 360 + step / 2, F.lit(360.0))
    s = df.select(F.floor(angle / step).alias("sector"), w.alias("w")).groupBy("sector").agg(F.count("*").alias("count"), F.min("w").alias("min"), F.max("w").alias("max"), F.sum("w").alias("sum"), F.avg("w").alias("mean"), F.stddev_pop("w").alias("std_dev"), F.var_pop("w").alias("variance"))
    all_ = df.sparkSession.range(sectors).select(F.col("id").alias("sector"))
    rose = all_.join(s, "sector", "left").na.fill(0).crossJoin(F.broadcast(s.agg(F.max("sum").alias("_top"))))
    rose = rose.withColumn("geom", sector(F.lit(c[0]), F.lit(c[1]), F.lit(0.0), F.lit(radius) * F.coalesce(F.try_divide("sum", "_top"), F.lit(0.0)), F.col("sector") * step - step / 2, F.lit(step))).drop("_top")
    anchor = df.sparkSession.range(1, 6).select(F.col("id").alias("ring"), (F.col("id") * radius / 5).alias("radius")).withColumn("geom", circle(F.lit(c[0]), F.lit(c[1]), F.col("radius")))
    return {"wind_rose": rose, "anchor": anchor}


def multi_wind_rose(layers: list[DataFrame], weights: list[str] | None, centers: DataFrame, radius: float, sectors: int = 36) -> dict[str, DataFrame]:
    """Statistics a centre (cid, x, y), layer and sector of the points within ``radius``."""
    step, parts = 360 / sectors, None
    c = centers.select("cid", F.col("x").alias("x2"), F.col("y").alias("y2"))
    for i, layer in enumerate(layers):
        w = F.coalesce(F.expr(weights[i]).cast("double"), F.lit(0.0)) if weights else F.lit(1.0)
        p = cells.point_pairs(layer.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), w.alias("w")), c, radius).withColumn("layer", F.lit(i))
        parts = p if parts is None else parts.unionByName(p)
    angle = F.pmod(F.degrees(F.atan2(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))) + 360 + step / 2, F.lit(360.0))
    s = parts.withColumn("sector", F.floor(angle / step)).groupBy("cid", "layer", "sector").agg(F.sum("w").alias("val"), F.count("*").alias("cnt"), F.min("w").alias("min"), F.max("w").alias("max"), F.avg("w").alias("mean"), F.percentile("w", F.lit(0.5)).alias("median"), F.stddev_pop("w").alias("stdev"))
    top = s.groupBy("cid", "sector").agg(F.sum("val").alias("_t")).groupBy("cid").agg(F.max("_t").alias("_top"))
    from pyspark.sql import Window

    order = Window.partitionBy("cid", "sector").orderBy("layer")
    s = s.join(top, "cid").join(c, "cid").withColumn("_outer", F.sum("val").over(order) / F.col("_top") * radius).withColumn("_inner", F.col("_outer") - F.col("val") / F.col("_top") * radius)
    rose = s.withColumn("geom", sector(F.col("x2"), F.col("y2"), F.col("_inner"), F.col("_outer"), F.col("sector") * step - step / 2, F.lit(step))).drop("_top", "_outer", "_inner", "x2", "y2")
    anchor = c.withColumn("ring", F.explode(F.sequence(F.lit(1), F.lit(5)))).withColumn("geom", circle(F.col("x2"), F.col("y2"), F.col("ring") * radius / 5)).drop("x2", "y2")
    return {"wind_rose": rose, "wind_rose_anchor": anchor}


def ring_map(df: DataFrame, fields: list[str], target: str = "ring_val", gap: int = 1, fid="fid", x="x", y="y") -> dict[str, DataFrame]:
    """One angular slot a feature (by angle round the extent's centre), one ring a field."""
    from pyspark.sql import Window

    e = cells.extent(df, x, y)
    cx, cy, base = (e.xmin + e.xmax) / 2, (e.ymin + e.ymax) / 2, math.hypot(e.xmax - e.xmin, e.ymax - e.ymin) / 2
    step, width = 360 / max(1, e.n), base / max(4, len(fields) + 2)
    angle = F.pmod(F.degrees(F.atan2(F.col(x) - cx, F.col(y) - cy)) + 360, F.lit(360.0))
    d = df.select(F.col(fid).alias("fid"), angle.alias("_a"), *[F.col(f).cast("double").alias(f) for f in fields]).withColumn("slot", F.row_number().over(Window.orderBy("_a", "fid")) - 1)
    long = d.select("fid", "slot", F.posexplode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias(target)) for f in fields])).alias("ring", "_e")).select("fid", "slot", "ring", "_e.*")
    inner = F.lit(base) + F.col("ring") * (width + gap)
    rings = long.withColumn("geom", sector(F.lit(cx), F.lit(cy), inner, inner + width, F.col("slot") * step, F.lit(step)))
    anchor = d.select("fid", "slot", F.array(F.array(F.array(F.struct(F.lit(cx).alias("x"), F.lit(cy).alias("y")), F.struct((F.lit(cx) + base * F.sin(F.radians((F.col("slot") + 0.5) * step))).alias("x"), (F.lit(cy) + base * F.cos(F.radians((F.col("slot") + 0.5) * step))).alias("y"))))).alias("geom"))
    return {"ringmap": rings, "anchor": anchor}


def circle_map(df: DataFrame, field: str, fid="fid", x="x", y="y") -> dict[str, DataFrame]:
    """Circles on a ring round the extent, one slot a feature by its angle, radius by the min-max scaled value; anchor lines lead back."""
    from pyspark.sql import Window

    e = cells.extent(df, x, y)
    cx, cy, ring = (e.xmin + e.xmax) / 2, (e.ymin + e.ymax) / 2, math.hypot(e.xmax - e.xmin, e.ymax - e.ymin) / 1.6
    step, top = 360 / max(1, e.n), ring * math.sin(math.radians(min(90.0, 180 / max(1, e.n))))
    angle = F.pmod(F.degrees(F.atan2(F.col(x) - cx, F.col(y) - cy)) + 360, F.lit(360.0))
    d = df.select(F.col(fid).alias("fid"), F.col(x).cast("double").alias("x0"), F.col(y).cast("double").alias("y0"), angle.alias("_a"), F.col(field).cast("double").alias("value")).where("value is not null")
    d = d.withColumn("slot", F.row_number().over(Window.orderBy("_a", "fid")) - 1).crossJoin(F.broadcast(d.agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))))
    at = F.radians((F.col("slot") + 0.5) * step)
    d = d.withColumn("x", F.lit(cx) + ring * F.sin(at)).withColumn("y", F.lit(cy) + ring * F.cos(at)).withColumn("radius", F.lit(top) * (0.1 + 0.9 * F.coalesce(F.try_divide(F.col("value") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(1.0))))
    d = d.drop("_a", "_lo", "_hi")
    anchor = d.select("fid", F.array(F.array(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct("x", "y")))).alias("geom"))
    return {"circles": d.withColumn("geom", circle(F.col("x"), F.col("y"), F.col("radius"))), "anchor": anchor}
