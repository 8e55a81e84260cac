"""Selection, computed columns, merging and coordinate systems of features."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import kernels as K
from ..functions import crs as P
from ..functions import expr as E
from ..plans.rows import exploded, geometry_udf


def count_features(df: DataFrame, condition: str | None = None) -> DataFrame:
    return (df.where(condition) if condition else df).agg(F.count("*").alias("count"))


def sum_areas(df: DataFrame, condition: str | None = None, unit: str = "Default") -> DataFrame:
    d = df.where(condition) if condition else df
    return d.agg(F.coalesce(F.sum(E.area(F.col("geom"))), F.lit(0.0)).alias("area")).select(E.convert_area(F.col("area"), "SquareMeters", unit).alias("area"))


def select_features(df: DataFrame, condition: str, attributes: list[str] | None = None) -> DataFrame:
    d = df.where(condition)
    return d.select(*attributes) if attributes else d


def calculate_field(df: DataFrame, expression: str, name: str = "evaluated") -> DataFrame:
    return df.withColumn(name, F.expr(expression))


def calculate_area(df: DataFrame, name: str = "geom_area", unit: str = "Default", perimeter: str | None = None, perimeter_unit: str = "Default") -> DataFrame:
    d = df.withColumn(name, E.convert_area(E.area(F.col("geom")), "SquareMeters", unit))
    return d.withColumn(perimeter, E.convert_length(E.length(F.col("geom")), "Meters", perimeter_unit)) if perimeter else d


def calculate_length(df: DataFrame, name: str = "geom_len", unit: str = "Default") -> DataFrame:
    return df.withColumn(name, E.convert_length(E.length(F.col("geom")), "Meters", unit))


def inner_point(geom: K.Geometry) -> K.Geometry:
    """Centroid if inside, else a point on the widest run through the middle."""
    a = K.area(geom)
    if not a:
        return geom
    m = sum((1 if i == 0 else -1) * abs(K.ring_area(r)) * _ring_centroid(r) for p in geom for i, r in enumerate(p)) / a
    c = m if K.contains(geom, m[None])[0] else K.np.array(K.interior_point(geom))
    return [[c.reshape(1, 2)]]


def _ring_centroid(r):
    q = r - r[0]
    w = q[:-1, 0] * q[1:, 1] - q[1:, 0] * q[:-1, 1]
    return r[0] + ((q[:-1] + q[1:]) * w[:, None]).sum(axis=0) / (3 * w.sum()) if w.sum() else r.mean(axis=0)


def calculate_xy(df: DataFrame, x: str = "x_coord", y: str = "y_coord", inside: bool = False, source: str | None = None, target: str | None = None) -> DataFrame:
    c = geometry_udf(inner_point)[0][0][0] if inside else E.centroid(F.col("geom"))
    d = df.withColumn("_c", c)
    u, v = (P.transform_columns(F.col("_c.x"), F.col("_c.y"), source, target) if source and target else (F.col("_c.x"), F.col("_c.y")))
    return d.withColumn(x, u).withColumn(y, v).drop("_c")


def merge_features(*tables: DataFrame) -> DataFrame:
    """UNION ALL by name, with the columns of the first table."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t.select(*[c for c in t.columns if c.lower() in {n.lower() for n in tables[0].columns}]), allowMissingColumns=True)
    return out.select(*tables[0].columns)


def reproject(df: DataFrame, target: str, source: str) -> DataFrame:
    s, t = P.system(source), P.system(target)
    return df.withColumn("geom", geometry_udf(lambda g: P.transform_geometry(g, s, t)))


def force_crs(df: DataFrame, crs: str) -> DataFrame:
    """The system is a mark on the geometry column."""
    return df.withMetadata("geom", {"crs": crs})


def geometry_to_features(spark, geometry, single_part: bool = False) -> DataFrame:
    g = K.from_numpy(K.to_numpy(geometry))
    rows = [(i + 1, [p]) for i, p in enumerate(g)] if single_part else [(1, g)]
    return spark.createDataFrame(rows, f"fid long, geom {E.GEOMETRY}")


def force_dimension(df: DataFrame, dimension: str = "XY", z: str | None = None, m: str | None = None) -> DataFrame:
    """Vertices as structs of x, y and, as asked for, z and m from expressions of the row."""
    extra = [F.expr(e).cast("double").alias(n) for n, e in (("z", z), ("m", m)) if n.upper() in dimension and e]
    return df.withColumn("geom", F.transform("geom", lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.struct(v.x.alias("x"), v.y.alias("y"), *extra)))))


def histogram_features(df: DataFrame, field: str) -> DataFrame:
    from .stats import histogram

    return histogram(df, field)


#: Distinct values up to which natural breaks are exact; more are put into so many bins of equal width.
MAX_BREAK_VALUES = 2000


def class_breaks(df: DataFrame, field: str, method: str = "EqualInterval", classes: int = 5) -> list[float]:
    """Class breaks from the histogram of values (equal interval, quantile, natural breaks, standard deviation).

    Natural breaks weigh each value by its rows; above MAX_BREAK_VALUES distinct values they are found on bins."""
    from .stats import _number

    v = df.select(_number(field).alias("v")).where("v is not null")
    if method == "EqualInterval":
        lo, hi = v.agg(F.min("v"), F.max("v")).first()
        return [lo + (hi - lo) * i / classes for i in range(classes)] + [hi]
    if method == "Quantile":
        return v.agg(F.percentile_approx("v", [i / classes for i in range(classes + 1)], 100_000)).first()[0]
    if method == "StandardDeviation":
        lo, hi, mean, sd = v.agg(F.min("v"), F.max("v"), F.avg("v"), F.stddev_pop("v")).first()
        inner = [mean + sd * (k + 0.5) * s for k in range(classes) for s in (-1, 1)]
        return sorted({lo, hi, *[b for b in inner if lo < b < hi]})
    counted = v.groupBy("v").agg(F.count("*").alias("n")).limit(MAX_BREAK_VALUES + 1).collect()
    if len(counted) > MAX_BREAK_VALUES:
        lo, hi = v.agg(F.min("v"), F.max("v")).first()
        place = F.least(F.floor((F.col("v") - lo) / (hi - lo) * MAX_BREAK_VALUES), F.lit(MAX_BREAK_VALUES - 1))
        bins = v.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.avg("v").alias("v"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        bins.sort(key=lambda r: r.v)
        return _natural_breaks([r.v for r in bins], classes, [r.n for r in bins], bins[0].lo, [r.hi for r in bins])
    counted.sort()
    return _natural_breaks([r[0] for r in counted], classes, [r[1] for r in counted])


def _natural_breaks(values: list[float], classes: int, counts: list[int] | None = None, lowest: float | None = None, upper: list[float] | None = None) -> list[float]:
    """Least within-class squared deviation of sorted values with their counts, by dynamic programming; a class ends at ``upper`` of its last value."""
    import numpy as np

    if not values:
        return []
    ends, first = np.array(values if upper is None else upper, float), float(values[0] if lowest is None else lowest)
    x, w = np.array(values, float), np.ones(len(values)) if counts is None else np.array(counts, float)
    n = len(x)
    classes = min(classes, n)
    x = x - np.average(x, weights=w)
    s0, s, s2 = (np.concatenate([[0], np.cumsum(w * x**k)]) for k in (0, 1, 2))
    cost = lambda i, j: s2[j] - s2[i] - (s[j] - s[i]) ** 2 / (s0[j] - s0[i])
    best, cut = np.array([0.0] + [cost(0, j) for j in range(1, n + 1)]), []
    for _ in range(1, classes):
        new, at = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for j in range(1, n + 1):
            i = np.arange(0, j)
            c = best[:j] + cost(i, j)
            at[j] = int(c.argmin())
            new[j] = c[at[j]]
        best = new
        cut.append(at)
    out, j = [float(ends[-1])], n
    for at in reversed(cut):
        j = int(at[j])
        if j:
            out.append(float(ends[j - 1]))
    return sorted({first, *out})
