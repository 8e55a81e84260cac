"""Overlay of polygon and line features.

Candidates meet through grid cells of their boxes; exact geometry runs in numpy on the matched rows.
Pairs whose union is needed are gathered per feature only (its own overlays), never per table.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import kernels as K
from ..functions.expr import GEOMETRY, bounds
from ..plans import cells as C
from ..plans.rows import binary_udf, geometry_udf

BOX = ("xmin", "ymin", "xmax", "ymax")


def boxed(df: DataFrame, suffix: str = "") -> DataFrame:
    d = df
    for n, c in bounds(F.col("geom")).items():
        d = d.withColumn(f"_{n}{suffix}", c)
    return d


def cell_size(*tables: DataFrame) -> float:
    """Twice the mean box side of the larger kind."""
    b = bounds(F.col("geom"))
    means = [t.agg(F.avg(F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"])).alias("side")) for t in tables]
    sides = reduce(DataFrame.union, means).agg(F.max("side")).first()[0]  # one job for all
    return 2 * (sides or 0.0) or 1.0


def candidates(a: DataFrame, b: DataFrame, aid: str = "fid", bid: str = "fid") -> DataFrame:
    """_a, _ga, _b, _gb of features whose boxes meet."""
    left = boxed(a.select(F.col(aid).alias("_a"), "geom")).withColumnRenamed("geom", "_ga")
    right = boxed(b.select(F.col(bid).alias("_b"), "geom"), "2").withColumnRenamed("geom", "_gb")
    return C.box_pairs(left, right, cell_size(a, b), tuple(f"_{n}" for n in BOX), tuple(f"_{n}2" for n in BOX)).select("_a", "_ga", "_b", "_gb")


def meet(a: K.Geometry, b: K.Geometry) -> bool:
    """Whether two geometries share a point."""
    va, vb = (K.np.concatenate([r for p in g for r in p]) for g in (a, b))
    if K.is_polygon(b) and K.contains(b, va).any() or K.is_polygon(a) and K.contains(a, vb).any():
        return True
    for p in a:
        for r in p:
            for q in b:
                for s in q:
                    if len(r) > 1 and len(s) > 1 and len(K.crossings(r, s)):
                        return True
                    if len(r) == 1 and len(s) > 1 and (K.locate(s, r[0])[1] <= K.EPS) or len(s) == 1 and len(r) > 1 and (K.locate(r, s[0])[1] <= K.EPS) or len(r) == len(s) == 1 and K.np.allclose(r, s):
                        return True
    return False


def covers(outer: K.Geometry, inner: K.Geometry) -> bool:
    return bool(K.contains(outer, K.np.concatenate([r for p in inner for r in p])).all()) and abs(K.area(K.intersection(outer, inner)) - K.area(inner)) <= 1e-7 * max(1.0, K.area(inner))


def semi_join(a: DataFrame, b: DataFrame, predicate: str = "intersects", aid: str | None = None) -> DataFrame:
    """Rows of ``a`` that meet (or lie in) a row of ``b``."""
    aid = aid or ("fid" if "fid" in a.columns else "uid")
    right = b if "fid" in b.columns else b.withColumn("fid", F.monotonically_increasing_id())
    test = binary_udf(meet if predicate == "intersects" else lambda x, y: covers(y, x), "boolean")
    keep = candidates(a, right, aid).where(test("_ga", "_gb")).select(F.col("_a").alias(aid)).distinct()
    return a.join(keep, aid, "left_semi")


def _same_dimension(a: K.Geometry, b: K.Geometry):
    """a within polygon b, of a's own dimension."""
    if K.is_polygon(a):
        return K.intersection(a, b)
    out = []
    for part in a:
        for path in part:
            if len(path) == 1:
                out += [[path]] if K.contains(b, path)[0] else []
            else:
                out += [[p] for p in K.clip_path(path, b)]
    return out


def clip_with_geometry(df: DataFrame, geometry) -> DataFrame:
    clip = K.to_numpy(geometry)
    return df.withColumn("geom", geometry_udf(lambda g: _same_dimension(g, clip))).where("geom is not null")


def _renamed(df: DataFrame, taken: list[str]) -> dict[str, str]:
    """Clashing names get _1, _2, ..."""
    used, out = {c.lower() for c in taken}, {}
    for c in df.columns:
        n, k = c, 0
        while n.lower() in used:
            k += 1
            n = f"{c}_{k}"
        used.add(n.lower())
        out[c] = n
    return out


def _attributes(df: DataFrame) -> DataFrame:
    return df.drop("geom")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairwise intersections with the attributes of both."""
    pairs = candidates(a, b).withColumn("geom", binary_udf(_same_dimension, "geometry")("_ga", "_gb")).where("geom is not null").select("_a", "_b", "geom")
    left, right = _attributes(a), _attributes(b)
    names = _renamed(right, left.columns)
    right = right.select(*[F.col(c).alias(n) for c, n in names.items()], F.col("fid").alias("_b"))
    return pairs.join(left.withColumn("_a", F.col("fid")), "_a").join(right, "_b").select(*left.columns, *names.values(), "geom")


def clip_with_features(a: DataFrame, clips: DataFrame) -> DataFrame:
    """The clipped piece of each pair; a row can appear once for each clip feature."""
    pairs = candidates(a, clips).withColumn("geom", binary_udf(_same_dimension, "geometry")("_ga", "_gb")).where("geom is not null").select("_a", "geom")
    return pairs.join(_attributes(a).withColumn("_a", F.col("fid")), "_a").select(*_attributes(a).columns, "geom")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each row less the rows of ``b`` that meet it; emptied rows go."""
    near = candidates(a, b).groupBy("_a").agg(F.collect_list("_gb").alias("_others"))
    d = a.join(near, a["fid"] == near["_a"], "left")

    @F.pandas_udf(GEOMETRY)
    def less(g: pd.Series, others: pd.Series) -> pd.Series:
        out = []
        for x, o in zip(g, others):
            if o is None or not len(o):
                out.append(x)
                continue
            x, cut = K.to_numpy(x), [K.to_numpy(v) for v in o]
            if K.is_polygon(x):
                r = K.difference(x, cut)
            else:
                whole = K.union(cut)
                r = [[p] for part in x for path in part for p in K.clip_path(path, whole, False)]
            out.append(K.from_numpy(r) if r else None)
        return pd.Series(out, dtype=object)

    return d.withColumn("geom", less("geom", "_others")).where("geom is not null").select(*a.columns)


def _merged(*parts: DataFrame) -> DataFrame:
    """Union by name; a name whose types differ becomes a string."""
    types: dict[str, set[str]] = {}
    for p in parts:
        for n, t in p.dtypes:
            types.setdefault(n, set()).add(t)
    fixed = [p.select(*[F.col(n).cast("string") if len(types[n]) > 1 and n != "geom" else F.col(n) for n in p.columns]) for p in parts]
    out = fixed[0]
    for p in fixed[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def sym_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return _merged(difference(a, b), difference(b, a))


def update(a: DataFrame, b: DataFrame) -> DataFrame:
    return _merged(difference(a, b), b)


def _as_overlay(a: DataFrame, b: DataFrame) -> DataFrame:
    names = _renamed(_attributes(b), _attributes(a).columns)
    d = difference(b, a)
    return d.select(*[F.col(c).alias(n) for c, n in names.items()], "geom")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return _merged(intersect(a, b), difference(a, b), _as_overlay(a, b))


def identity(a: DataFrame, b: DataFrame) -> DataFrame:
    return _merged(intersect(a, b), difference(a, b))
