"""Buffers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import kernels as K
from ..functions import expr as E
from ..plans.rows import exploded, geometry_udf
from .grids import sector


def buffer_features(df: DataFrame, distance: str, segments: int = 24, cap: str = "Round") -> DataFrame:
    """Buffer by an expression; a null distance drops the row.  Points need no Python."""
    d = df.withColumn("_d", F.expr(distance).cast("double")).where("_d is not null")
    if "geom" not in df.columns:
        return d.where("_d > 0").withColumn("geom", E.circle(F.col("x"), F.col("y"), F.col("_d"), 4 * segments)).drop("_d")
    return d.withColumn("geom", geometry_udf(lambda g, r: K.buffer(g, float(r), segments, cap), F.col("_d"))).where("geom is not null").drop("_d")


def multiple_ring_buffer(df: DataFrame, distances: list[float], outside_only: bool = True, dissolved: bool = False, segments: int = 24) -> DataFrame:
    """One row a distance, largest first; rings lose the next smaller one."""
    ds = sorted(distances)
    rings = F.array(*[F.struct(F.lit(float(b)).alias("distance"), F.lit(float(a)).alias("_inner")) for a, b in reversed(list(zip([0.0, *ds[:-1]], ds)))])
    d = df.withColumn("_r", F.explode(rings)).withColumn("distance", F.col("_r.distance")).withColumn("_inner", F.col("_r._inner")).drop("_r")
    if "geom" not in df.columns:
        outer = E.circle(F.col("x"), F.col("y"), F.col("distance"), 4 * segments)
        hole = F.reverse(E.circle(F.col("x"), F.col("y"), F.col("_inner"), 4 * segments)[0][0])
        d = d.withColumn("geom", F.when((F.col("_inner") > 0) & F.lit(outside_only), F.array(F.array(outer[0][0], hole))).otherwise(outer))
    else:

        def ring(g, outer, inner):
            big = K.buffer(g, outer, segments)
            if not outside_only:
                return big
            less = K.buffer(g, inner, segments) if inner else (g if K.is_polygon(g) else [])
            return K.difference(big, [less]) if less else big

        d = d.withColumn("geom", geometry_udf(ring, F.col("distance"), F.col("_inner")))
    d = d.drop("_inner")
    if not dissolved:
        return d
    from .aggregate import unite

    return unite(d, ["distance"])


def single_sided_buffer(df: DataFrame, distance: str, segments: int = 8) -> DataFrame:
    d = df.withColumn("_d", F.expr(distance).cast("double")).where("_d is not null")
    return d.withColumn("geom", geometry_udf(lambda g, r: K.union([K.one_sided(path, float(r), segments) for part in g for path in part]), F.col("_d"))).where("geom is not null").drop("_d")


def wedge_buffer(df: DataFrame, azimuth: str, angle: str, outer: str, inner: str = "0") -> DataFrame:
    """Sector centred on the azimuth; null or no angle, or no radius, drops the row."""
    d = df.withColumn("_a", F.expr(azimuth).cast("double")).withColumn("_w", F.expr(angle).cast("double")).withColumn("_i", F.coalesce(F.expr(inner).cast("double"), F.lit(0.0))).withColumn("_o", F.coalesce(F.expr(outer).cast("double"), F.lit(0.0)))
    d = d.where("_a is not null and _w > 0 and greatest(_i, _o) > 0")
    lo, hi = F.least("_i", "_o"), F.greatest("_i", "_o")
    w = F.least(F.col("_w"), F.lit(360.0))
    return d.withColumn("geom", sector(F.col("x"), F.col("y"), lo, hi, F.col("_a") - w / 2, w, 64)).drop("_a", "_w", "_i", "_o")


def variable_buffer(df: DataFrame, end: str, start: str = "0", segments: int = 8) -> DataFrame:
    d = df.withColumn("_s", F.expr(start).cast("double")).withColumn("_e", F.expr(end).cast("double")).where("_s is not null and _e is not null")
    return d.withColumn("geom", geometry_udf(lambda g, s, e: K.union([K.variable_buffer(path, float(s), float(e), segments) for part in g for path in part]), F.col("_s"), F.col("_e"))).where("geom is not null").drop("_s", "_e")
