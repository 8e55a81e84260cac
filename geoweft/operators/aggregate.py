"""Grouping, dissolving and removing duplicates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import kernels as K
from ..functions import expr as E
from ..plans import cells as C
from ..plans import discs, greedy
from ..plans.rows import exploded, geometry_udf
from .summary import parse


def unite(df: DataFrame, keys: list[str], cell: float | None = None) -> DataFrame:
    """Union of geometries a key as a two-level tree: first by key and tile, then by key.

    A tile holds the features whose lower left corner lies in it, so one hot key is shared out.
    """
    from .overlay import cell_size

    size = (cell or cell_size(df)) * 8
    b = E.bounds(F.col("geom"))
    d = df.select(*keys, "geom").where("geom is not null").withColumn("_tx", C.cell(b["xmin"], size)).withColumn("_ty", C.cell(b["ymin"], size))

    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        g = K.union([K.to_numpy(v) for v in pdf.geom])
        return pdf.iloc[:1][[c for c in pdf.columns if c in keys or c in ("_tx", "_ty")]].assign(geom=[K.from_numpy(g)])

    kinds = dict(df.dtypes)
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    d = d.groupBy(*keys, "_tx", "_ty").applyInPandas(up, f"{head}{', ' if head else ''}_tx long, _ty long, geom {E.GEOMETRY}")
    if keys:
        return d.groupBy(*keys).applyInPandas(lambda pdf: up(pdf)[[*keys, "geom"]], f"{head}, geom {E.GEOMETRY}")
    return d.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda pdf: up(pdf)[["geom"]], f"geom {E.GEOMETRY}")


def dissolve(df: DataFrame, field: str, statistics: str | None = None, multipart: bool = True) -> DataFrame:
    """GROUP BY field with united geometry; null is a group of its own."""
    d = df.withColumn("_key", F.coalesce(F.col(field).cast("string"), F.lit("\u0000null")))
    s = d.groupBy("_key").agg(F.first(field).alias(field), F.count("*").alias("count"), *parse(statistics, "fid"))
    out = s.join(unite(d, ["_key"]), "_key").drop("_key")
    return out if multipart else exploded(out, F.transform("geom", lambda p: F.array(p)))


def union_polygon(df: DataFrame, preserve_hole: bool = True) -> DataFrame:
    out = unite(df, [])
    return out if preserve_hole else out.withColumn("geom", F.transform("geom", lambda p: F.slice(p, 1, 1)))


def singlepart_to_multipart(df: DataFrame, case: str, dissolved: bool = False) -> DataFrame:
    """One row a case with all parts; other attributes come from the row of least fid."""
    rest = [c for c in df.columns if c not in (case, "geom")]
    first = [F.min_by(c, "fid").alias(c) for c in rest]
    parts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("fid", "geom"))), lambda s: s.geom)).alias("geom")
    g = df.groupBy(case).agg(*first, parts)
    if not dissolved:
        return g
    return g.drop("geom").join(unite(df, [case]), case)


def collect_events(df: DataFrame, count: str = "icount", tolerance: float = 0.1) -> DataFrame:
    """Greedy merge of points within the tolerance in fid order: the first unmerged point takes the rest.

    Without a tolerance it is a grouping by place.  With one, tiles settle their points in rounds (``plans/greedy``).
    """
    if tolerance <= 0:
        g = df.groupBy("x", "y").agg(F.count("*").alias(count), F.min("fid").alias("_f"))
        return df.join(g.select("_f", count), df["fid"] == F.col("_f")).drop("_f")
    points = df.select(F.col("fid").cast("long").alias("fid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    keep = greedy.merged(points, tolerance).select(F.col("fid").alias("_f"), F.col("n").alias(count))
    return df.join(keep, df["fid"] == F.col("_f")).drop("_f")


def normal_form(tolerance: float = 0.0):
    """Vertices rounded to the tolerance, rings from their least vertex and in one direction, parts sorted; as text."""
    step = tolerance or 1e-9

    @F.pandas_udf("string")
    def run(g: pd.Series) -> pd.Series:
        out = []
        for v in g:
            parts = []
            for part in K.to_numpy(v):
                rings = []
                for r in part:
                    q = K.np.round(r / step).astype(K.np.int64)
                    if len(q) > 3 and (q[0] == q[-1]).all():
                        q = q[:-1] if K.ring_area(r) >= 0 else q[:-1][::-1]
                        k = K.np.lexsort((q[:, 1], q[:, 0]))[0]
                        q = K.np.roll(q, -k, axis=0)
                    elif len(q) > 1 and tuple(q[0]) > tuple(q[-1]):
                        q = q[::-1]
                    rings.append(q.tolist())
                parts.append(rings[:1] + sorted(rings[1:]))
            out.append(str(sorted(parts)))
        return pd.Series(out)

    return run


def collect_features(df: DataFrame, count: str = "icount", tolerance: float = 0.1) -> DataFrame:
    """Equal geometries up to the tolerance become the one of least fid."""
    g = df.withColumn("_n", F.md5(normal_form(tolerance)("geom"))).groupBy("_n").agg(F.min("fid").alias("_f"), F.count("*").alias(count)).drop("_n")
    return df.join(g, df["fid"] == F.col("_f")).drop("_f")


def delete_duplicates(df: DataFrame) -> DataFrame:
    """First of equal geometries, whatever the attributes."""
    key = F.md5(normal_form()("geom")) if "geom" in df.columns else F.concat_ws(",", "x", "y")
    g = df.withColumn("_n", key).groupBy("_n").agg(F.min("fid").alias("_f")).drop("_n")
    return df.join(g, df["fid"] == F.col("_f")).drop("_f")


def spatial_clumps(df: DataFrame, radius: str, segments: int = 8) -> DataFrame:
    """Clumps of points whose circles overlap, each with the union of the circles; tiles find its boundary (``plans/discs``)."""
    d = df.select(F.col("fid").cast("long").alias("fid"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.expr(radius).cast("double").alias("r")).where("r > 0")
    return discs.clumps(d, 4 * segments)
