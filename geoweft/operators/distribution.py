"""Geographic distribution: weighted, grouped summaries of point patterns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import circle, path_length, with_xy

# Size names and their multiples.
SIZES = {"1_STANDARD_DEVIATION": 1.0, "2_STANDARD_DEVIATION": 2.0, "3_STANDARD_DEVIATION": 3.0}


def _weight(weight: str | None) -> Column:
    """Null, NaN and infinite weights count as 1."""
    if not weight:
        return F.lit(1.0)
    w = F.expr(weight).cast("double")
    return F.when(w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")), 1.0).otherwise(w)


def _input(df: DataFrame, weight: str | None, case: str | None, x: str, y: str) -> DataFrame:
    return with_xy(df, x, y).withColumn("_w", _weight(weight)).withColumn("_x", F.col(x).cast("double")).withColumn("_y", F.col(y).cast("double")).withColumn("_case", F.col(case).cast("string") if case else F.lit("ALL"))


def mean_center(df: DataFrame, weight: str | None = None, case: str | None = None, dimension: str | None = None, x="x", y="y") -> DataFrame:
    d = _input(df, weight, case, x, y)
    extra = [(F.sum(F.col(dimension).cast("double")) / F.count("*")).alias(dimension)] if dimension else []
    return d.groupBy(F.col("_case").alias("case")).agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("x"), (F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("y"), F.count("*").alias("count"), *extra)


def median_center(df: DataFrame, weight: str | None = None, case: str | None = None, attributes: list[str] | None = None, x="x", y="y", iterations: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """Weiszfeld iteration from the mean centre.

    All cases step together: one aggregation of the points an iteration, and only the centres, one
    row a case, are carried between steps.  A point that coincides with the centre gets weight
    w x (extent area x 1000), as the reference semantics have it.
    """
    d = _input(df, weight, case, x, y)
    medians = [F.percentile(F.col(a).cast("double"), F.lit(0.5)).alias(a) for a in attributes or []]
    start = d.groupBy("_case").agg((F.sum(F.col("_w") * F.col("_x")) / F.sum("_w")).alias("cx"), (F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("cy"), ((F.max("_x") - F.min("_x")) * (F.max("_y") - F.min("_y"))).alias("area"), F.count("*").alias("count"), *medians).toPandas()
    spark = df.sparkSession
    centers = start[["_case", "cx", "cy", "area"]].copy()
    moving = set(centers["_case"])
    narrow = d.select("_case", "_x", "_y", "_w")
    for _ in range(iterations):
        if not moving:
            break
        c = spark.createDataFrame(centers[centers["_case"].isin(moving)])
        dist = F.hypot(F.col("_x") - F.col("cx"), F.col("_y") - F.col("cy"))
        w = F.when(dist > 0, F.col("_w") / dist).otherwise(F.col("_w") * F.col("area") * 1000)
        new = narrow.join(F.broadcast(c) if len(moving) <= 100_000 else c, "_case").groupBy("_case").agg((F.sum(w * F.col("_x")) / F.sum(w)).alias("nx"), (F.sum(w * F.col("_y")) / F.sum(w)).alias("ny")).toPandas()
        centers = centers.merge(new, on="_case", how="left")
        step = np.hypot(centers.nx - centers.cx, centers.ny - centers.cy)
        moving = set(centers["_case"][step > tolerance])
        centers["cx"], centers["cy"] = centers.nx.fillna(centers.cx), centers.ny.fillna(centers.cy)
        centers = centers.drop(columns=["nx", "ny"])
    out = start.drop(columns=["cx", "cy", "area"]).merge(centers[["_case", "cx", "cy"]], on="_case")
    return spark.createDataFrame(out.rename(columns={"_case": "case", "cx": "x", "cy": "y"}))


def central_feature(df: DataFrame, method: str = "Euclidean", weight: str | None = None, self_potential: str | None = None, case: str | None = None, fid="id", x="x", y="y") -> DataFrame:
    """The feature of least weighted distance to all others of its case; ties go to the least id."""
    d = _input(df, weight, case, x, y).withColumn("_p", F.coalesce(F.expr(self_potential).cast("double"), F.lit(0.0)) if self_potential else F.lit(0.0)).withColumn("_id", F.col(fid))
    o = d.select(F.col("_case"), F.col("_id").alias("_j"), F.col("_x").alias("_xj"), F.col("_y").alias("_yj"), F.col("_w").alias("_wj"))
    dx, dy = F.col("_x") - F.col("_xj"), F.col("_y") - F.col("_yj")
    dist = F.abs(dx) + F.abs(dy) if method == "Manhattan" else F.sqrt(dx * dx + dy * dy)
    term = F.when(F.col("_id") == F.col("_j"), F.col("_p") * F.col("_w")).otherwise(F.col("_wj") * dist)
    cost = d.select("_case", "_id", "_x", "_y", "_w", "_p").join(o, "_case").groupBy("_case", "_id", "_x", "_y").agg(F.sum(term).alias("cost"))
    best = cost.groupBy("_case").agg(F.min(F.struct(F.round("cost", 6).alias("c"), F.col("_id").alias("id"), F.col("_x").alias("x"), F.col("_y").alias("y"))).alias("m"))
    return best.select(F.col("_case").alias("case"), "m.id", "m.x", "m.y", F.col("m.c").alias("cost"))


def standard_distance(df: DataFrame, size: str = "1_STANDARD_DEVIATION", weight: str | None = None, case: str | None = None, x="x", y="y") -> DataFrame:
    d = _input(df, weight, case, x, y)
    w, cx, cy = F.col("_w"), F.col("cx"), F.col("cy")
    c = d.groupBy("_case").agg((F.sum(w * F.col("_x")) / F.sum(w)).alias("cx"), (F.sum(w * F.col("_y")) / F.sum(w)).alias("cy"))
    dev = F.pow(F.col("_x") - cx, F.lit(2)) + F.pow(F.col("_y") - cy, F.lit(2))
    out = d.select("_case", "_x", "_y", "_w").join(c, "_case").groupBy("_case").agg(F.first("cx").alias("x"), F.first("cy").alias("y"), (F.sqrt(F.sum(w * dev) / F.sum(w)) * SIZES[size]).alias("std_dist"), F.count("*").alias("count"))
    return out.withColumnRenamed("_case", "case").withColumn("geom", circle(F.col("x"), F.col("y"), F.col("std_dist"), 360))


def std_dev_ellipse(df: DataFrame, size: str = "1_STANDARD_DEVIATION", weight: str | None = None, case: str | None = None, x="x", y="y") -> DataFrame:
    """Centre, axes and rotation (degrees clockwise from north) with the sqrt(2) factor; the ring has 361 points."""
    d = _input(df, weight, case, x, y)
    w = F.col("_w")
    c = d.groupBy("_case").agg((F.sum(w * F.col("_x")) / F.sum(w)).alias("cx"), (F.sum(w * F.col("_y")) / F.sum(w)).alias("cy"))
    dx, dy = F.col("_x") - F.col("cx"), F.col("_y") - F.col("cy")
    s = d.select("_case", "_x", "_y", "_w").join(c, "_case").groupBy("_case").agg(F.first("cx").alias("x"), F.first("cy").alias("y"), F.sum(w * dx * dx).alias("sxx"), F.sum(w * dy * dy).alias("syy"), F.sum(w * dx * dy).alias("sxy"), F.sum(w).alias("sw"), F.count("*").alias("count"))
    diff = F.col("sxx") - F.col("syy")
    t = F.when(F.col("sxy") == 0, F.lit(0.0)).otherwise(F.atan(F.try_divide(diff + F.sqrt(diff * diff + 4 * F.col("sxy") * F.col("sxy")), 2 * F.col("sxy"))))
    s = s.withColumn("t", t)
    sin, cos, k = F.sin("t"), F.cos("t"), SIZES[size]
    a = F.sqrt(2 * (F.col("sxx") * cos * cos - 2 * F.col("sxy") * sin * cos + F.col("syy") * sin * sin) / F.col("sw")) * k
    b = F.sqrt(2 * (F.col("sxx") * sin * sin + 2 * F.col("sxy") * sin * cos + F.col("syy") * cos * cos) / F.col("sw")) * k
    s = s.withColumn("x_std_dist", a).withColumn("y_std_dist", b).withColumn("rotation", F.pmod(F.degrees("t") + 360, F.lit(360.0)))
    step = lambda i: F.radians((i % 360).cast("double"))
    ring = F.transform(F.sequence(F.lit(0), F.lit(360)), lambda i: F.struct((F.col("x") + F.col("x_std_dist") * F.cos(step(i)) * F.cos("t") + F.col("y_std_dist") * F.sin(step(i)) * F.sin("t")).alias("x"), (F.col("y") - F.col("x_std_dist") * F.cos(step(i)) * F.sin("t") + F.col("y_std_dist") * F.sin(step(i)) * F.cos("t")).alias("y")))
    return s.select(F.col("_case").alias("case"), "x", "y", "x_std_dist", "y_std_dist", "rotation", "count", F.array(F.array(ring)).alias("geom"))


def linear_directional_mean(df: DataFrame, orientation_only: bool = True, case: str | None = None, geom: str = "geom") -> DataFrame:
    """Mean direction of lines, start to end; orientation_only takes directions under 180 degrees."""
    path = F.col(geom)[0][0]
    a, b = path[0], F.element_at(path, -1)
    ang = F.pmod(F.atan2(b.y - a.y, b.x - a.x), F.lit(2 * np.pi))
    if orientation_only:
        ang = F.when(ang >= np.pi, ang - np.pi).otherwise(ang)
    d = df.select(F.col(case).cast("string").alias("case") if case else F.lit("ALL").alias("case"), ang.alias("a"), path_length(path).alias("len"), ((a.x + b.x) / 2).alias("mx"), ((a.y + b.y) / 2).alias("my"))
    s = d.groupBy("case").agg(F.sum(F.sin("a")).alias("s"), F.sum(F.cos("a")).alias("c"), F.avg("len").alias("ave_len"), F.avg("mx").alias("x"), F.avg("my").alias("y"), F.count("*").alias("count"))
    mean = F.pmod(F.atan2("s", "c"), F.lit(2 * np.pi))
    s = s.withColumn("m", mean)
    half_x, half_y = F.col("ave_len") / 2 * F.cos("m"), F.col("ave_len") / 2 * F.sin("m")
    line = F.array(F.array(F.array(F.struct((F.col("x") - half_x).alias("x"), (F.col("y") - half_y).alias("y")), F.struct((F.col("x") + half_x).alias("x"), (F.col("y") + half_y).alias("y")))))
    return s.select("case", F.pmod(90 - F.degrees("m") + 360, F.lit(360.0)).alias("compass"), F.degrees("m").alias("dir_mean"), (1 - F.sqrt(F.col("s") * F.col("s") + F.col("c") * F.col("c")) / F.col("count")).alias("cir_var"), "x", "y", "ave_len", "count", line.alias("geom"))
