"""Rasters from features and features from rasters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import kernels
from ..functions.expr import GEOMETRY, bounds, centroid, rectangle
from .raster import Meta, Raster, aspect, at, blank, center, meta_for, slope


def to_points(r: Raster, band: int = 0, field: str = "value", retain_nodata: bool = False) -> DataFrame:
    x, y = center(r.meta)
    d = r.band(band) if retain_nodata else r.band(band).where("value is not null")
    return d.select((F.col("row").cast("long") * r.meta.ncols + F.col("col") + 1).alias("fid"), x.alias("x"), y.alias("y"), F.col("value").alias(field))


def to_grid_polygons(r: Raster, band: int = 0, field: str = "value", retain_nodata: bool = False) -> DataFrame:
    d = to_points(r, band, field, retain_nodata)
    hx, hy = r.meta.dx / 2, r.meta.dy / 2
    return d.select("fid", rectangle(F.col("x") - hx, F.col("y") - hy, F.col("x") + hx, F.col("y") + hy).alias("geom"), field)


def regions(r: Raster, band: int = 0) -> DataFrame:
    """row, col, value, region: 4-connected cells of equal value share the least cell number.

    Runs along rows are labelled by a window; runs that touch across rows are links, and the
    components of the links are found by repeated min-label steps over runs, not cells.
    """
    from pyspark.sql import Window

    d = r.band(band).where("value is not null").select("row", "col", "value")
    across = Window.partitionBy("row").orderBy("col")
    new = F.when((F.lag("col").over(across) == F.col("col") - 1) & (F.lag("value").over(across) == F.col("value")), 0).otherwise(1)
    d = d.withColumn("_n", new).withColumn("_k", F.sum("_n").over(across))
    first = F.min("col").over(Window.partitionBy("row", "_k"))
    d = d.withColumn("run", F.col("row").cast("long") * r.meta.ncols + first).select("row", "col", "value", "run")
    below = d.select((F.col("row") - 1).alias("row"), "col", F.col("value").alias("_v"), F.col("run").alias("run2"))
    links = d.join(below, ["row", "col"]).where("value = _v").select(F.col("run").alias("u"), F.col("run2").alias("v")).distinct()
    from ..plans.components import components

    parts = components(links)
    return d.join(parts.select(F.col("node").alias("run"), "component"), "run", "left").select("row", "col", "value", F.coalesce("component", "run").alias("region"))


def to_polygons(r: Raster, band: int = 0, weeding: bool = False, field: str = "value") -> DataFrame:
    """One polygon a region of equal values; weeding simplifies by sqrt(0.5) of a cell."""
    m, tolerance = r.meta, (0.5**0.5) * r.meta.dx if weeding else 0.0

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        geom = kernels.cells_to_polygon(pdf.row.to_numpy(), pdf.col.to_numpy())
        geom = [[np.stack([m.minx + ring[:, 0] * m.dx, m.maxy - ring[:, 1] * m.dy], axis=1) for ring in part] for part in geom]
        if tolerance:
            geom = [[kernels.simplify(ring, tolerance) for ring in part] for part in geom]
        return pd.DataFrame({"fid": [int(pdf.region.iloc[0])], "geom": [kernels.from_numpy(geom)], field: [float(pdf.value.iloc[0])]})

    return regions(r, band).groupBy("region").applyInPandas(trace, f"fid long, geom {GEOMETRY}, {field} double")


def extract_values(points: DataFrame, r: Raster, field: str = "rasterval", kind: str = "Default") -> DataFrame:
    """Value, slope or aspect of the cell under each point."""
    src = {"Default": lambda: r, "SlopeAsDegree": lambda: slope(r), "SlopeAsPercentrise": lambda: slope(r, "Percentrise"), "Aspect": lambda: aspect(r)}[kind]()
    c, w = at(r.meta, F.col("x"), F.col("y"))
    return points.withColumn("_c", c.cast("int")).withColumn("_w", w.cast("int")).join(src.band().select(F.col("col").alias("_c"), F.col("row").alias("_w"), F.col("value").alias(field)), ["_c", "_w"], "left").drop("_c", "_w")


def zone_cells(zones: DataFrame, meta: Meta, geom: str = "geom") -> DataFrame:
    """fid, row, col of the cells whose centres lie in each zone; runs of cells a scan line, made in numpy, exploded by Spark."""

    def run(batches):
        for pdf in batches:
            out = []
            for fid, g in zip(pdf.fid, pdf[geom]):
                for row, a, b in kernels.scan(kernels.to_numpy(g), meta):
                    out.append((fid, row, a, b))
            yield pd.DataFrame(out, columns=["fid", "row", "a", "b"])

    d = zones.select(F.col("fid").cast("long").alias("fid"), geom).mapInPandas(run, "fid long, row int, a int, b int")
    return d.select("fid", "row", F.explode(F.sequence("a", "b")).alias("col"))


def features_to_raster(features: DataFrame, field: str | None = None, cell: float = 0.0, extent=None) -> Raster:
    """Numeric value, 1-based rank of a string, or id; the feature of largest fid wins a cell."""
    if extent is None:
        extent = tuple(features.select(*[c.alias(n) for n, c in bounds(F.col("geom")).items()]).agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first())
    meta = meta_for(extent, cell)
    d = features
    if field is None:
        d = d.withColumn("_v", F.col("fid").cast("double"))
    elif dict(features.dtypes)[field] == "string":
        from pyspark.sql import Window

        ranks = d.select(field).distinct().withColumn("_v", F.row_number().over(Window.orderBy(field)).cast("double"))  # one row a distinct value
        d = d.join(ranks, field)
    else:
        d = d.withColumn("_v", F.col(field).cast("double"))
    hit = zone_cells(d, meta).join(d.select(F.col("fid").cast("long").alias("fid"), "_v"), "fid").groupBy("row", "col").agg(F.max_by("_v", "fid").alias("value"))
    return Raster(blank(features.sparkSession, meta).join(hit, ["row", "col"], "left").select("band", "row", "col", "value"), meta)


def points_to_raster(points: DataFrame, field: str | None, assignment: str = "MostFrequent", cell: float = 0.0, extent=None) -> Raster:
    from ..plans import cells as C

    if extent is None:
        e = C.extent(points)
        extent = (e.xmin, e.ymin, e.xmax, e.ymax)
    meta = meta_for(extent, cell)
    v = F.expr(field).cast("double") if field else F.lit(1.0)
    agg = {"MostFrequent": lambda c: F.mode(c, True), "Sum": F.sum, "Mean": F.avg, "StandardDeviation": F.stddev_pop, "Maximum": F.max, "Minimum": F.min, "Range": lambda c: F.max(c) - F.min(c), "Count": lambda c: F.count(c).cast("double")}[assignment if field else "Count"]
    c, r = at(meta, F.col("x").cast("double"), F.col("y").cast("double"))
    d = points.select(c.cast("int").alias("col"), r.cast("int").alias("row"), v.alias("v")).groupBy("row", "col").agg(agg("v").alias("value"))
    return Raster(blank(points.sparkSession, meta).join(d, ["row", "col"], "left").select("band", "row", "col", "value"), meta)


def geometry_to_raster(spark, geometry, value: float = 1.0, cell: float = 0.0, extent=None) -> Raster:
    g = kernels.to_numpy(geometry)
    if extent is None:
        lo, hi = kernels.geometry_bounds(g)
        extent = (*lo, *hi)
    meta = meta_for(extent, cell)
    runs = [(int(r), int(a), int(b)) for r, a, b in kernels.scan(g, meta)]
    hit = spark.createDataFrame(runs, "row int, a int, b int").select("row", F.explode(F.sequence("a", "b")).alias("col"), F.lit(float(value)).alias("value"))
    return Raster(blank(spark, meta).join(hit, ["row", "col"], "left").select("band", "row", "col", "value"), meta)


def zonal_statistics(zones: DataFrame, r: Raster, kind: str = "Mean", target: str = "val", band: int = 0) -> DataFrame:
    """Statistic and area (count x cell) of the cells in each zone; zones without cells keep nulls."""
    agg = {"Count": lambda: F.count("value").cast("double"), "Sum": lambda: F.sum("value"), "Mean": lambda: F.avg("value"), "Minimum": lambda: F.min("value"), "Maximum": lambda: F.max("value"), "Range": lambda: F.max("value") - F.min("value"), "StdDev": lambda: F.stddev_pop("value")}[kind]()
    hit = zone_cells(zones, r.meta).join(r.band(band).where("value is not null").select("row", "col", "value"), ["row", "col"])
    s = hit.groupBy("fid").agg(agg.alias(target), (F.count("*") * r.meta.dx * r.meta.dy).alias("area"))
    return zones.join(s, "fid", "left")


def to_image(r: Raster, low=(255, 255, 255), high=(0, 0, 128), band: int = 0) -> bytes:
    """A binary PPM picture with a two-colour ramp, for rasters that fit the driver."""
    m = r.meta
    if m.ncols * m.nrows > 16_000_000:
        raise ValueError("resample the raster before drawing it")
    a = np.full((m.nrows, m.ncols), np.nan)
    p = r.band(band).toPandas()
    a[p.row, p.col] = p.value
    t = (a - np.nanmin(a)) / max(1e-300, np.nanmax(a) - np.nanmin(a))
    rgb = np.where(np.isnan(t)[..., None], 255, np.array(low) + t[..., None] * (np.array(high) - np.array(low))).astype(np.uint8)
    return b"P6\n%d %d\n255\n" % (m.ncols, m.nrows) + rgb.tobytes()
