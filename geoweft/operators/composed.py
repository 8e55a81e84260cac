"""Local spatial autocorrelation of points gathered into cells or polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import centroid
from ..plans import cells as C
from . import grids, joins
from .autocorr import local_sa


def local_sa_binning(df: DataFrame, weight: str | None = None, grid: str = "Hexagon", extent=None, size: float = 0.0, sa_method: str = "MoranI", concept="InverseDistance", method="Euclidean", standardization="Row", band: float = 0.0) -> DataFrame:
    """Bins, empty ones included (default size: the shorter side over 40), then a local statistic on ``val``."""
    if extent is None:
        e = C.extent(df)
        extent = (e.xmin, e.ymin, e.xmax, e.ymax)
    size = size or min(extent[2] - extent[0], extent[3] - extent[1]) / 40
    make = {"Hexagon": lambda: grids.hexagonal_binning(df, size, weight, extent, False), "Rectangle": lambda: grids.rectangular_binning(df, size, size, weight, extent, False), "Circle": lambda: grids.circular_binning(df, size, weight, extent, False)}[grid]()
    if "uid" not in make.columns:
        make = make.withColumn("uid", F.col("row") * 1_000_000 + F.col("col"))
    cells = make.withColumn("_c", centroid(F.col("geom"))).withColumn("x", F.col("_c.x")).withColumn("y", F.col("_c.y")).drop("_c")
    return local_sa(cells, "val", sa_method, concept, method, standardization, band, "uid").drop("x", "y")


def local_sa_overlay(polygons: DataFrame, points: DataFrame, weight: str | None = None, sa_method: str = "MoranI", concept="InverseDistance", method="Euclidean", standardization="Row", band: float = 0.0) -> DataFrame:
    """Count or weighted sum of the points in each polygon, then a local statistic on ``val``."""
    p = points.withColumn("_w", F.expr(weight).cast("double") if weight else F.lit(1.0))
    s = joins.polygon_points(polygons, p).groupBy("poly_fid").agg(F.sum("_w").alias("val"))
    d = polygons.join(s, polygons["fid"] == s["poly_fid"], "left").drop("poly_fid").na.fill(0.0, ["val"])
    d = d.withColumn("_c", centroid(F.col("geom"))).withColumn("x", F.col("_c.x")).withColumn("y", F.col("_c.y")).drop("_c")
    return local_sa(d, "val", sa_method, concept, method, standardization, band).drop("x", "y")
