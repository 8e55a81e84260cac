"""Rasters as tables of cells, and everything computed cell by cell or in a 3 x 3 window.

``Raster.cells`` has band, row, col, value with a row for every cell; null is noData and row 0 is the
top row.  A 3 x 3 window takes two lag/lead passes, one along rows and one along columns, so a cell
is shuffled twice and never multiplied; missing neighbours count as the centre.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import finite, rectangle
from ..plans import cells as C


@dataclass(frozen=True)
class Meta:
    ncols: int
    nrows: int
    minx: float
    miny: float
    dx: float
    dy: float
    crs: str = ""
    nodata: float = -9999.0

    @property
    def maxx(self) -> float:
        return self.minx + self.ncols * self.dx

    @property
    def maxy(self) -> float:
        return self.miny + self.nrows * self.dy


@dataclass(frozen=True)
class Raster:
    cells: DataFrame
    meta: Meta

    def band(self, index: int = 0) -> DataFrame:
        return self.cells.where(F.col("band") == index)

    def with_cells(self, cells: DataFrame, **meta) -> Raster:
        return Raster(cells.select("band", "row", "col", F.col("value").cast("double").alias("value")), replace(self.meta, **meta))


def meta_for(extent, cell: float = 0.0, crs: str = "") -> Meta:
    """Cell size min side / 250 unless given; counts round half up."""
    w, h = extent[2] - extent[0], extent[3] - extent[1]
    cell = cell or min(w, h) / 250
    return Meta(max(1, math.floor(w / cell + 0.5)), max(1, math.floor(h / cell + 0.5)), extent[0], extent[1], cell, cell, crs)


def center(meta: Meta, col="col", row="row") -> tuple[Column, Column]:
    c, r = (F.col(col) if isinstance(col, str) else col), (F.col(row) if isinstance(row, str) else row)
    return F.lit(meta.minx) + (c + 0.5) * meta.dx, F.lit(meta.maxy) - (r + 0.5) * meta.dy


def at(meta: Meta, x: Column, y: Column) -> tuple[Column, Column]:
    """col, row of a place; the far edges belong to the last cell."""
    c, r = F.floor((x - F.lit(meta.minx)) / meta.dx), F.floor((F.lit(meta.maxy) - y) / meta.dy)
    c = F.when(x == F.lit(meta.maxx), F.lit(meta.ncols - 1).cast("long")).otherwise(c)
    return c, F.when(y == F.lit(meta.miny), F.lit(meta.nrows - 1).cast("long")).otherwise(r)


def blank(spark: SparkSession, meta: Meta) -> DataFrame:
    return spark.range(meta.ncols * meta.nrows).select(F.lit(0).alias("band"), F.floor(F.col("id") / meta.ncols).cast("int").alias("row"), (F.col("id") % meta.ncols).cast("int").alias("col"))


# ---- 3 x 3 windows


def windows(r: Raster, z: float = 1.0) -> DataFrame:
    """band, row, col, value and the window a b c / d e f / g h i (top to bottom), times z."""
    v = F.col("value") * z if z != 1 else F.col("value")
    across, down = Window.partitionBy("band", "row").orderBy("col"), Window.partitionBy("band", "col").orderBy("row")

    def beside(step, name, window, by):
        shifted = F.lag if step < 0 else F.lead
        return F.when(shifted(by).over(window) == F.col(by) + step, shifted(name).over(window))

    d = r.cells.withColumn("e", v)
    d = d.withColumn("d", beside(-1, "e", across, "col")).withColumn("f", beside(1, "e", across, "col"))
    d = d.withColumn("_s", F.struct("d", "e", "f"))
    d = d.withColumn("_u", beside(-1, "_s", down, "row")).withColumn("_l", beside(1, "_s", down, "row"))
    e = F.col("e")
    names = {"a": F.col("_u.d"), "b": F.col("_u.e"), "c": F.col("_u.f"), "d": F.col("d"), "f": F.col("f"), "g": F.col("_l.d"), "h": F.col("_l.e"), "i": F.col("_l.f")}
    return d.select("band", "row", "col", "value", "e", *[F.coalesce(c, e).alias(n) for n, c in names.items()])


def _focal(r: Raster, value: Column, z: float = 1.0) -> Raster:
    return r.with_cells(windows(r, z).select("band", "row", "col", F.when(F.col("e").isNotNull(), value).alias("value")))


def _gradient(dx: float, dy: float) -> tuple[Column, Column]:
    a, b, c, d, f, g, h, i = (F.col(n) for n in "abcdfghi")
    return ((c + 2 * f + i) - (a + 2 * d + g)) / (8.0 * dx), ((g + 2 * h + i) - (a + 2 * b + c)) / (8.0 * dy)


def slope(r: Raster, kind: str = "Degree", z: float = 1.0) -> Raster:
    """Horn slope in degrees or percent; values over 100 become noData, percent too."""
    gx, gy = _gradient(r.meta.dx, r.meta.dy)
    rise = F.sqrt(gx * gx + gy * gy)
    s = F.degrees(F.atan(rise)) if kind == "Degree" else rise * 100
    return _focal(r, F.when((s >= 0) & (s <= 100), s), z)


def aspect(r: Raster) -> Raster:
    """Degrees clockwise from north; flat is -1."""
    gx, gy = _gradient(1.0, 1.0)
    ang = F.degrees(F.atan2(gy, -gx))
    return _focal(r, F.when((gx == 0) & (gy == 0), -1.0).when(ang > 90, 450 - ang).otherwise(90 - ang))


def hillshade(r: Raster, azimuth: float = 315.0, altitude: float = 45.0, z: float = 1.0) -> Raster:
    """0 to 255; the z factor scales the window and the slope, as the reference semantics have it."""
    gx, gy = _gradient(r.meta.dx, r.meta.dy)
    zenith, math_az = math.radians(90 - altitude), math.radians((450 - azimuth) % 360)
    s, a = F.atan(z * F.sqrt(gx * gx + gy * gy)), F.atan2(gy, -gx)
    a = F.when((gx == 0) & (gy > 0), math.pi / 2).when((gx == 0) & (gy < 0), 1.5 * math.pi).otherwise(a)
    shade = 255.0 * (math.cos(zenith) * F.cos(s) + math.sin(zenith) * F.sin(s) * F.cos(F.lit(math_az) - a))
    return _focal(r, F.least(F.greatest(shade, F.lit(0.0)), F.lit(255.0)), z)


def _others():
    return [F.col(n) for n in "abcdfghi"]


def tpi(r: Raster) -> Raster:
    return _focal(r, F.col("e") - sum(_others()) / 8.0)


def tri(r: Raster) -> Raster:
    return _focal(r, sum(F.abs(n - F.col("e")) for n in _others()) / 8.0)


def roughness(r: Raster) -> Raster:
    return _focal(r, F.greatest("e", *_others()) - F.least("e", *_others()))


def curvature(r: Raster, z: float = 1.0) -> Raster:
    b, d, e, f, h = (F.col(n) for n in "bdefh")
    dd, ee = ((d + f) / 2 - e) / (r.meta.dx**2), ((b + h) / 2 - e) / (r.meta.dy**2)
    flat = (f == d) & (b == h)
    return _focal(r, F.when(flat, 0.0).otherwise(-2.0 * (dd + ee)) * (100.0 * z), z)


def flow_direction(r: Raster) -> Raster:
    """D8 code of the largest drop; the first in row order wins a tie."""
    # Codes of the eight neighbours, row by row.
    codes = {"a": 32, "b": 64, "c": 128, "d": 16, "f": 1, "g": 8, "h": 4, "i": 2}
    drops = {n: (F.col("e") - F.col(n)) / (100.0 * (math.sqrt(2) if n in "acgi" else 1.0)) for n in codes}
    top = F.greatest(*drops.values())
    value = F.lit(None).cast("int")
    for n in reversed(codes):
        value = F.when(drops[n] == top, codes[n]).otherwise(value)
    return _focal(r, value)


# ---- map algebra


def _expr(r: Raster, value: Column, band: int = 0) -> Raster:
    return r.with_cells(r.band(band).withColumn("Value", F.col("value")).withColumn("value", value))


def con(r: Raster, condition: str, true_value: int = 1, false_value: int | None = None, band: int = 0) -> Raster:
    """Integer true or false value; noData stays noData; no false value means noData."""
    return _expr(r, F.when(F.col("value").isNotNull(), F.when(F.expr(condition), F.lit(true_value)).otherwise(F.lit(false_value).cast("int"))), band)


def set_null(r: Raster, condition: str, replace_nodata: bool = False, new_value: float = 0.0, band: int = 0) -> Raster:
    v = F.when(F.expr(condition), F.lit(None)).otherwise(F.col("value"))
    return _expr(r, F.when(F.col("value").isNull(), F.lit(new_value)).otherwise(v) if replace_nodata else v, band)


def parse_ranges(text: str) -> list[tuple[float, float, int]]:
    """"min max class; ..." with later ranges of a class replacing earlier ones."""
    by_class = {}
    for part in filter(None, (p.strip() for p in text.split(";"))):
        low, high, cls = part.replace(",", " ").split()
        by_class[int(float(cls))] = (float(low), float(high))
    return [(low, high, cls) for cls, (low, high) in by_class.items()]


def reclass(r: Raster, ranges: str, retain_missing: bool = True, band: int = 0) -> Raster:
    v = F.lit(None).cast("double")
    for low, high, cls in reversed(parse_ranges(ranges)):
        v = F.when((F.col("value") >= low) & (F.col("value") < high + 1e-8), F.lit(float(cls))).otherwise(v)
    return _expr(r, F.coalesce(v, F.col("value").cast("long").cast("double")) if retain_missing else v, band)


def calculate(r: Raster, expression: str, band: int = 0) -> Raster:
    """Any expression on ``value``; infinite and NaN results become noData."""
    v = F.expr(expression).cast("double")
    return _expr(r, F.when(F.col("value").isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), v), band)


def extract(r: Raster, condition: str, band: int = 0) -> Raster:
    return _expr(r, F.when(F.expr(condition), F.col("value")), band)


def _shape(meta: Meta, cells: DataFrame, region, inside: bool = True) -> Column | None:
    """Whether a cell's centre lies in ``region``: an extent, or a geometry given as nested lists."""
    x, y = center(meta)
    if region is None:
        return F.lit(True)
    if isinstance(region, tuple) and len(region) == 4:
        return x.between(region[0], region[2]) & y.between(region[1], region[3])
    from .. import kernels

    return kernels.contains_column(region)(x, y)


def replace_values(r: Raster, region, value: float) -> Raster:
    return _expr(r, F.when(_shape(r.meta, r.cells, region), F.lit(float(value))).otherwise(F.col("value")))


def _joined(a: Raster, b: Raster, ia: int = 0, ib: int = 0) -> DataFrame:
    return a.band(ia).select("row", "col", F.col("value").alias("va")).join(b.band(ib).select("row", "col", F.col("value").alias("vb")), ["row", "col"]).withColumn("band", F.lit(0))


def ndvi(nir: Raster, red: Raster, nir_index: int = 0, red_index: int = 0) -> Raster:
    v = F.try_divide(F.col("va") - F.col("vb"), F.col("va") + F.col("vb"))
    return nir.with_cells(_joined(nir, red, nir_index, red_index).withColumn("value", v))


def histogram(r: Raster, band: int = 0, region=None) -> DataFrame:
    d = r.band(band).where(_shape(r.meta, r.cells, region)) if region is not None else r.band(band)
    return d.where("value is not null").groupBy("value").agg(F.count("*").alias("frequency"))


def statistics(r: Raster, band: int = 0, region=None) -> DataFrame:
    from .stats import statistics as stats

    d = r.band(band).where(_shape(r.meta, r.cells, region)) if region is not None else r.band(band)
    return stats(d, ["value"])


def describe(r: Raster, detailed: bool = False) -> DataFrame:
    m = r.meta
    head = [F.lit(v).alias(k) for k, v in (("ncols", m.ncols), ("nrows", m.nrows), ("minx", m.minx), ("miny", m.miny), ("maxx", m.maxx), ("maxy", m.maxy), ("dx", m.dx), ("dy", m.dy), ("nodata", m.nodata), ("crs", m.crs))]
    per = r.cells.groupBy("band").agg(*([F.count("value").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std_dev")] if detailed else [F.count("*").alias("cells")]))
    return per.select("*", *head)


def clip(r: Raster, region, inside: bool = True) -> Raster:
    """Cells of the region; the grid shrinks to an extent, and elsewhere cells become noData."""
    if isinstance(region, tuple) and len(region) == 4:
        m = r.meta
        c0, c1 = max(0, math.floor((region[0] - m.minx) / m.dx + 1e-9)), min(m.ncols, math.ceil((region[2] - m.minx) / m.dx - 1e-9))
        r0, r1 = max(0, math.floor((m.maxy - region[3]) / m.dy + 1e-9)), min(m.nrows, math.ceil((m.maxy - region[1]) / m.dy - 1e-9))
        d = r.cells.where(F.col("col").between(c0, c1 - 1) & F.col("row").between(r0, r1 - 1)).withColumn("col", F.col("col") - c0).withColumn("row", F.col("row") - r0)
        return r.with_cells(d, ncols=c1 - c0, nrows=r1 - r0, minx=m.minx + c0 * m.dx, miny=m.maxy - r1 * m.dy)
    ok = _shape(r.meta, r.cells, region)
    return r.with_cells(r.cells.withColumn("value", F.when(ok if inside else ~ok, F.col("value"))))


def clip_circle(r: Raster, cx: float, cy: float, radius: float, inside: bool = True) -> Raster:
    x, y = center(r.meta)
    near = F.hypot(x - cx, y - cy) <= radius
    return r.with_cells(r.cells.withColumn("value", F.when(near if inside else ~near, F.col("value"))))


def clip_features(r: Raster, features: DataFrame) -> Raster:
    from .rastervec import zone_cells

    hit = zone_cells(features.withColumn("fid", F.lit(1)), r.meta).select("row", "col").distinct()
    d = r.cells.join(hit.withColumn("_hit", F.lit(True)), ["row", "col"], "left")
    return r.with_cells(d.withColumn("value", F.when(F.col("_hit"), F.col("value"))))


def extract_by_mask(r: Raster, mask: Raster) -> Raster:
    m = mask.band().where("value is not null").select("row", "col", F.lit(True).alias("_m"))
    return r.with_cells(r.cells.join(m, ["row", "col"], "left").withColumn("value", F.when(F.col("_m"), F.col("value"))))


def _cut_fill(d: DataFrame, area: float) -> DataFrame:
    """Rows 1 cut, -1 fill, 0 unchanged with area, volume and count; d has diff."""
    return d.where("diff is not null").groupBy(F.signum("diff").cast("int").alias("flag")).agg((F.count("*") * area).alias("area"), F.sum(F.abs("diff") * area).alias("volume"), F.count("*").alias("count"))


def cut_fill(r: Raster, base_height: float | None = None, region=None) -> DataFrame:
    """Against a base height, by default the mean."""
    d = r.band().where(_shape(r.meta, r.cells, region)) if region is not None else r.band()
    if base_height is None or base_height == -9999:
        d = d.crossJoin(F.broadcast(d.agg(F.avg("value").alias("_base"))))
        return _cut_fill(d.withColumn("diff", F.col("value") - F.col("_base")), r.meta.dx * r.meta.dy)
    return _cut_fill(d.withColumn("diff", F.col("value") - base_height), r.meta.dx * r.meta.dy)


def cut_fill_between(before: Raster, after: Raster, region=None, base_height: float | None = None) -> DataFrame:
    """Before less after; with a base height only cells above it in either raster count."""
    d = _joined(before, after)
    if region is not None:
        d = d.where(_shape(before.meta, d, region))
    if base_height is not None:
        d = d.where((F.col("va") > base_height) | (F.col("vb") > base_height))
    return _cut_fill(d.withColumn("diff", F.col("va") - F.col("vb")), before.meta.dx * before.meta.dy)


def cut_fill_regions(before: Raster, after: Raster | None = None, base_height: float | None = None, region=None) -> DataFrame:
    """Polygons of connected cells to cut (flag 1), to fill (-1) or unchanged (0), against a height (the mean) or another raster."""
    from .rastervec import to_polygons

    d = _joined(before, after) if after is not None else before.band().withColumn("va", F.col("value"))
    if region is not None:
        d = d.where(_shape(before.meta, d, region))
    if after is None:
        base = F.lit(float(base_height)) if base_height is not None else F.col("_base")
        d = d.crossJoin(F.broadcast(d.agg(F.avg("va").alias("_base")))).withColumn("vb", base)
    flags = d.select(F.lit(0).alias("band"), "row", "col", F.signum(F.col("va") - F.col("vb")).alias("value"))
    found = to_polygons(before.with_cells(flags.where("value is not null")), field="flag")
    return found.withColumn("flag", F.col("flag").cast("int"))


def surface_area(r: Raster, region=None) -> DataFrame:
    """Planar and surface area of the two triangles of each square of neighbouring cell centres."""
    d = r.band().where(_shape(r.meta, r.cells, region)) if region is not None else r.band()
    across, down = Window.partitionBy("row").orderBy("col"), Window.partitionBy("col").orderBy("row")
    d = d.withColumn("_r", F.when(F.lead("col").over(across) == F.col("col") + 1, F.lead("value").over(across))).withColumn("_s", F.struct("value", "_r"))
    d = d.withColumn("_d", F.when(F.lead("row").over(down) == F.col("row") + 1, F.lead("_s").over(down)))
    dx, dy = r.meta.dx, r.meta.dy
    a, b, c, e = F.col("value"), F.col("_r"), F.col("_d.value"), F.col("_d._r")

    def triangle(zx, zy):  # half the norm of the cross product of (dx, 0, zx) and (0, dy, zy)
        return 0.5 * F.sqrt(F.pow(zx * dy, F.lit(2)) + F.pow(zy * dx, F.lit(2)) + (dx * dy) ** 2)

    s = triangle(b - a, c - a) + triangle(e - c, e - b)
    return d.where(a.isNotNull() & b.isNotNull() & c.isNotNull() & e.isNotNull()).agg(F.sum(s).alias("surface_area"), (F.count("*") * dx * dy).alias("planar_area"))


# ---- profiles and lines of sight


def _sample(r: Raster, points: DataFrame) -> DataFrame:
    """points (x, y) with z of their cell (null outside)."""
    c, w = at(r.meta, F.col("x"), F.col("y"))
    return points.withColumn("_c", c.cast("int")).withColumn("_w", w.cast("int")).join(r.band().select(F.col("col").alias("_c"), F.col("row").alias("_w"), F.col("value").alias("z")), ["_c", "_w"], "left").drop("_c", "_w")


def profile(r: Raster, line: list[tuple[float, float]], interval: float = 50.0) -> DataFrame:
    """Surface values along a line, each segment divided into steps of at most ``interval``."""
    pts, dist = [], 0.0
    for (x0, y0), (x1, y1) in zip(line, line[1:]):
        d = math.hypot(x1 - x0, y1 - y0)
        n = max(1, math.ceil(d / interval))
        pts += [(dist + d * i / n, x0 + (x1 - x0) * i / n, y0 + (y1 - y0) * i / n) for i in range(n)]
        dist += d
    pts.append((dist, *map(float, line[-1])))
    p = r.cells.sparkSession.createDataFrame([(i, *map(float, v)) for i, v in enumerate(pts)], "step int, distance double, x double, y double")
    return _sample(r, p).where("z is not null")


def _sight(r: Raster, rays: DataFrame, offset: float, curvature: bool, refraction: bool, factor: float) -> DataFrame:
    """rays: ray, ox, oy, tx, ty -> steps with visible."""
    m = r.meta
    n = F.greatest(F.abs(((F.col("tx") - F.col("ox")) / m.dx).cast("int")), F.abs(((F.col("ty") - F.col("oy")) / m.dy).cast("int")))
    d = rays.withColumn("_n", n).where("_n > 0").withColumn("_len", F.hypot(F.col("tx") - F.col("ox"), F.col("ty") - F.col("oy")))
    d = d.withColumn("step", F.explode(F.sequence(F.lit(1), F.col("_n")))).withColumn("distance", F.col("step") * F.col("_len") / F.col("_n"))
    d = d.withColumn("x", F.col("ox") + (F.col("tx") - F.col("ox")) * F.col("step") / F.col("_n")).withColumn("y", F.col("oy") + (F.col("ty") - F.col("oy")) * F.col("step") / F.col("_n"))
    eye = _sample(r, rays.select("ray", F.col("ox").alias("x"), F.col("oy").alias("y"))).select("ray", (F.col("z") + offset).alias("_eye"))
    d = _sample(r, d).where("z is not null").join(eye.where("_eye is not null"), "ray")
    z = F.col("z")
    if curvature:
        z = z + F.col("distance") * F.col("distance") * ((factor if refraction else 0.13) - 1) / 12740000.0
    d = d.withColumn("slope", F.atan2(z - F.col("_eye"), F.col("distance")))
    before = Window.partitionBy("ray").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    top = F.max("slope").over(before)
    return d.withColumn("visible", F.when(top.isNull() | (F.col("slope") > top), 1).otherwise(0)).select("ray", "step", "x", "y", "z", "distance", "visible")


def linear_line_of_sight(r: Raster, observer, target, offset: float = 1.7, curvature: bool = False, refraction: bool = False, factor: float = 0.13) -> DataFrame:
    rays = r.cells.sparkSession.createDataFrame([(0, *map(float, observer), *map(float, target))], "ray int, ox double, oy double, tx double, ty double")
    return _sight(r, rays, offset, curvature, refraction, factor)


def radial_line_of_sight(r: Raster, observer, radius: float = 5000.0, sides: int = 180, offset: float = 1.7, curvature: bool = False, refraction: bool = False, factor: float = 0.13) -> DataFrame:
    ang = F.radians(F.col("ray") * 360.0 / sides)
    ox, oy = F.lit(float(observer[0])), F.lit(float(observer[1]))
    rays = r.cells.sparkSession.range(sides).select(F.col("id").cast("int").alias("ray"), ox.alias("ox"), oy.alias("oy")).withColumn("tx", F.col("ox") + radius * F.sin(ang)).withColumn("ty", F.col("oy") + radius * F.cos(ang))
    return _sight(r, rays, offset, curvature, refraction, factor).withColumn("angle", F.col("ray") * 360.0 / sides)


# ---- georeferencing


def force_crs(r: Raster, crs: str) -> Raster:
    return replace(r, meta=replace(r.meta, crs=crs))


def flip(r: Raster) -> Raster:
    return r.with_cells(r.cells.withColumn("row", F.lit(r.meta.nrows - 1) - F.col("row")))


def mirror(r: Raster) -> Raster:
    return r.with_cells(r.cells.withColumn("col", F.lit(r.meta.ncols - 1) - F.col("col")))


def rescale(r: Raster, x_scale: float = 1.0, y_scale: float = 1.0) -> Raster:
    return replace(r, meta=replace(r.meta, dx=r.meta.dx * x_scale, dy=r.meta.dy * y_scale))


def shift(r: Raster, x_shift: float = 0.0, y_shift: float = 0.0) -> Raster:
    return replace(r, meta=replace(r.meta, minx=r.meta.minx + x_shift, miny=r.meta.miny + y_shift))


def _warp(r: Raster, target: Meta, inverse, method: str = "NEAREST") -> Raster:
    """Target cells sampled at inverse(x, y) in source coordinates."""
    x, y = center(target)
    sx, sy = inverse(x, y)
    g = blank(r.cells.sparkSession, target).drop("band").withColumn("_fx", (sx - F.lit(r.meta.minx)) / r.meta.dx - 0.5).withColumn("_fy", (F.lit(r.meta.maxy) - sy) / r.meta.dy - 0.5)
    src = r.cells.select("band", F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("value").alias("_v"))
    if method == "NEAREST":
        g = g.withColumn("_c", F.floor(F.col("_fx") + 0.5).cast("int")).withColumn("_r", F.floor(F.col("_fy") + 0.5).cast("int"))
        return Raster(g.join(src, ["_r", "_c"]).select("band", "row", "col", F.col("_v").alias("value")), target)
    taps = (0, 1) if method == "BILINEAR" else (-1, 0, 1, 2)

    def weight(d: Column) -> Column:
        d = F.abs(d)
        if method == "BILINEAR":
            return F.greatest(1 - d, F.lit(0.0))
        return F.when(d <= 1, 1.5 * d * d * d - 2.5 * d * d + 1).when(d < 2, -0.5 * d * d * d + 2.5 * d * d - 4 * d + 2).otherwise(0.0)

    g = g.withColumn("_c", F.explode(F.array(*[(F.floor("_fx") + t).cast("int") for t in taps]))).withColumn("_r", F.explode(F.array(*[(F.floor("_fy") + t).cast("int") for t in taps])))
    g = g.withColumn("_w", weight(F.col("_fx") - F.col("_c")) * weight(F.col("_fy") - F.col("_r")))
    d = g.join(src.where("_v is not null"), ["_r", "_c"]).groupBy("band", "row", "col").agg((F.sum(F.col("_v") * F.col("_w")) / F.sum("_w")).alias("value"))
    return Raster(d, target)


def resample(r: Raster, cell: float, method: str = "NEAREST") -> Raster:
    return _warp(r, meta_for((r.meta.minx, r.meta.miny, r.meta.maxx, r.meta.maxy), cell, r.meta.crs), lambda x, y: (x, y), method)


def rotate(r: Raster, angle: float, anchor=None, method: str = "NEAREST") -> Raster:
    """Clockwise degrees about the anchor, by default the lower left corner."""
    m = r.meta
    ax, ay = anchor or (m.minx, m.miny)
    t = math.radians(angle)
    forward = lambda x, y: (ax + (x - ax) * math.cos(t) + (y - ay) * math.sin(t), ay - (x - ax) * math.sin(t) + (y - ay) * math.cos(t))
    corners = [forward(x, y) for x in (m.minx, m.maxx) for y in (m.miny, m.maxy)]
    ext = (min(c[0] for c in corners), min(c[1] for c in corners), max(c[0] for c in corners), max(c[1] for c in corners))
    target = Meta(math.ceil((ext[2] - ext[0]) / m.dx - 1e-9), math.ceil((ext[3] - ext[1]) / m.dy - 1e-9), ext[0], ext[1], m.dx, m.dy, m.crs)
    return _warp(r, target, lambda x, y: (F.lit(ax) + (x - ax) * math.cos(t) - (y - ay) * math.sin(t), F.lit(ay) + (x - ax) * math.sin(t) + (y - ay) * math.cos(t)), method)


def reproject(r: Raster, target_crs: str, method: str = "NEAREST", cell: float = 0.0, forced: str | None = None) -> Raster:
    from ..functions import crs as P

    m, source = r.meta, forced or r.meta.crs
    edge = [P.transform_xy(m.minx + (m.maxx - m.minx) * i / 20, m.miny + (m.maxy - m.miny) * j / 20, source, target_crs) for i in range(21) for j in range(21) if i in (0, 20) or j in (0, 20)]
    ext = (min(p[0] for p in edge), min(p[1] for p in edge), max(p[0] for p in edge), max(p[1] for p in edge))
    size = cell or math.sqrt((ext[2] - ext[0]) * (ext[3] - ext[1]) / (m.ncols * m.nrows))
    return _warp(r, meta_for(ext, size, target_crs), lambda x, y: P.transform_columns(x, y, target_crs, source), method)


def fuzzy(r: Raster, points: list[float], kind: str = "Linear", direction: str = "Increasing") -> Raster:
    """Membership 0 to 1 over two control points, or four for a plateau."""
    def ramp(v, a, b):
        u = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - a) / (b - a)))
        if kind == "Sigmoidal":
            return F.pow(F.sin(u * math.pi / 2), F.lit(2))
        if kind == "Jshaped":
            return 1 / (1 + F.pow((v - b) / (b - a), F.lit(2)))
        return u

    v = F.col("value")
    if len(points) == 4:
        a, b, c, d = points
        out = F.when(v < b, ramp(v, a, b)).when(v <= c, 1.0).otherwise(ramp(-v, -d, -c))
    else:
        a, b = points
        out = F.when(v >= b, 1.0).otherwise(ramp(v, a, b)) if direction == "Increasing" else F.when(v <= a, 1.0).otherwise(ramp(-v, -b, -a))
    return _expr(r, out)


def high_low_points(r: Raster, kind: str = "High", band: int = 0, region=None) -> DataFrame:
    d = r.band(band).where("value is not null")
    if region is not None:
        d = d.where(_shape(r.meta, d, region))
    best = d.agg((F.max if kind == "High" else F.min)("value").alias("_v"))
    x, y = center(r.meta)
    return d.join(F.broadcast(best), F.col("value") == F.col("_v")).select("row", "col", x.alias("x"), y.alias("y"), "value")
