"""Column expressions shared by the operators: geometry measures, units, tail probabilities.

A geometry is ``array<array<array<struct<x:double,y:double>>>>``: parts, then rings (or one path),
then vertices; polygon rings are closed and the first ring of a part is its shell.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOMETRY = "array<array<array<struct<x:double,y:double>>>>"

# Metres in a length unit, square metres in an area unit.
METRES = {"Default": 1.0, "Meters": 1.0, "Kilometers": 1000.0, "Inches": 0.0254, "Feet": 0.3048, "Yards": 0.9144, "Miles": 1609.344, "NauticalMiles": 1852.0}
SQUARE_METRES = {"Default": 1.0, "SquareMeters": 1.0, "SquareKilometers": 1e6, "SquareFeet": 0.09290304, "SquareYards": 0.83612736, "SquareMiles": 2589988.110336, "Hectare": 10000.0, "Acre": 4046.8564224}


def convert_length(value, source: str, target: str):
    """Length in ``source`` units as ``target`` units; Default leaves a number as it is."""
    return value if "Default" in (source, target) else value * (METRES[source] / METRES[target])


def convert_area(value, source: str, target: str):
    return value if "Default" in (source, target) else value * (SQUARE_METRES[source] / SQUARE_METRES[target])


def xy(x, y) -> Column:
    return F.struct(F.col(x).cast("double").alias("x") if isinstance(x, str) else x.cast("double").alias("x"), F.col(y).cast("double").alias("y") if isinstance(y, str) else y.cast("double").alias("y"))


def pairs(path: Column) -> Column:
    """Consecutive vertices of a path as structs a, b."""
    n = F.size(path)
    return F.when(n > 1, F.zip_with(F.slice(path, 1, n - 1), F.slice(path, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))


def total(values: Column) -> Column:
    return F.aggregate(F.coalesce(values, F.array().cast("array<double>")), F.lit(0.0), lambda s, v: s + v)


def ring_area(ring: Column) -> Column:
    """Signed shoelace area about the first vertex, which keeps large coordinates exact."""
    o = ring[0]
    cross = F.transform(pairs(ring), lambda e: (e.a.x - o.x) * (e.b.y - o.y) - (e.b.x - o.x) * (e.a.y - o.y))
    return total(cross) / 2


def path_length(path: Column) -> Column:
    return total(F.transform(pairs(path), lambda e: F.hypot(e.b.x - e.a.x, e.b.y - e.a.y)))


def part_area(part: Column) -> Column:
    return 2 * F.abs(ring_area(part[0])) - total(F.transform(part, lambda r: F.abs(ring_area(r))))


def area(geom: Column) -> Column:
    """Shells less holes."""
    return total(F.transform(geom, part_area))


def length(geom: Column) -> Column:
    """Length of all paths, or perimeter of all rings."""
    return total(F.transform(F.flatten(geom), path_length))


def vertices(geom: Column) -> Column:
    return F.flatten(F.flatten(geom))


def bounds(geom: Column) -> dict[str, Column]:
    xs, ys = F.transform(vertices(geom), lambda v: v.x), F.transform(vertices(geom), lambda v: v.y)
    return {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}


def rectangle(xmin, ymin, xmax, ymax) -> Column:
    """A one-part polygon, counter-clockwise from the lower left."""
    p = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(F.array(F.array(p(xmin, ymin), p(xmax, ymin), p(xmax, ymax), p(xmin, ymax), p(xmin, ymin))))


def circle(x: Column, y: Column, r: Column, segments: int = 96) -> Column:
    """A closed regular polygon with a vertex at every 360 / segments degrees."""
    step = 2 * math.pi / segments
    ring = F.transform(F.sequence(F.lit(0), F.lit(segments)), lambda i: F.struct((x + r * F.cos((i % segments) * step)).alias("x"), (y + r * F.sin((i % segments) * step)).alias("y")))
    return F.array(F.array(ring))


def centroid(geom: Column) -> Column:
    """struct x, y: by area for polygons, by length for lines, the mean of vertices for points."""
    rings = F.flatten(F.transform(geom, lambda p: F.transform(p, lambda r, i: F.struct(r.alias("r"), F.when(i == 0, 1.0).otherwise(-1.0).alias("s")))))
    closed = F.exists(rings, lambda q: (F.size(q.r) > 3) & (q.r[0] == F.element_at(q.r, -1)))

    def moment(axis: str) -> tuple[Column, Column]:
        o = vertices(geom)[0]

        def ring(q):
            r, sign = q.r, q.s * F.signum(ring_area(q.r))
            terms = F.transform(pairs(r), lambda e: (e.a[axis] - o[axis] + e.b[axis] - o[axis]) * ((e.a.x - o.x) * (e.b.y - o.y) - (e.b.x - o.x) * (e.a.y - o.y)))
            return sign * total(terms) / 6

        by_area = total(F.transform(rings, ring)) / area(geom) + o[axis]
        edges = F.flatten(F.transform(F.flatten(geom), lambda p: F.coalesce(pairs(p), F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"))))
        by_length = total(F.transform(edges, lambda e: F.hypot(e.b.x - e.a.x, e.b.y - e.a.y) * (e.a[axis] + e.b[axis]) / 2)) / length(geom)
        mean = total(F.transform(vertices(geom), lambda v: v[axis])) / F.size(vertices(geom))
        return F.when(closed & (area(geom) > 0), by_area).when(length(geom) > 0, by_length).otherwise(mean)

    return F.struct(moment("x").alias("x"), moment("y").alias("y"))


def with_xy(df, x: str = "x", y: str = "y"):
    """``df`` with coordinates; features of other shapes are placed at their centroid."""
    if x in df.columns or "geom" not in df.columns:
        return df
    c = centroid(F.col("geom"))
    return df.withColumn("_c", c).withColumn(x, F.col("_c.x")).withColumn(y, F.col("_c.y")).drop("_c")


def zprob_sql(z: str) -> str:
    """Two-sided normal tail of ``z`` by Algorithm AS 66 (Hill 1973), as SQL."""
    # The coefficients of AS 66.
    a, y = f"abs({z})", f"(0.5 * ({z}) * ({z}))"
    near = f"0.5 - {a} * (0.398942280444 - 0.39990348504 * {y} / ({y} + 5.75885480458 + -29.8213557808 / ({y} + 2.62433121679 + 48.6959930692 / ({y} + 5.92885724438))))"
    far = f"0.398942280385 * exp(-{y}) / ({a} + -3.8052e-08 + 1.00000615302 / ({a} + 3.98064794e-04 + 1.98615381364 / ({a} + -0.151679116635 + 5.29330324926 / ({a} + 4.8385912808 + -15.1508972451 / ({a} + 0.742380924027 + 30.789933034 / ({a} + 3.99019417011))))))"
    return f"2.0 * (CASE WHEN {a} > 7 THEN 0.0 WHEN {a} <= 1.28 THEN {near} ELSE {far} END)"


def zprob(z: str) -> Column:
    """Two-sided tail of the column named ``z``."""
    return F.expr(zprob_sql(z))


def finite(value: Column, instead: float = 0.0) -> Column:
    ok = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    return F.when(ok, value).otherwise(F.lit(instead))
