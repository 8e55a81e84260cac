"""Geometry functions of numpy applied to rows, in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import kernels as K
from ..functions.expr import GEOMETRY


def geometry_udf(fn, *args: Column, geom: str | Column = "geom") -> Column:
    """fn(geometry, *values) -> geometry or None."""
    col = F.col(geom) if isinstance(geom, str) else geom

    @F.pandas_udf(GEOMETRY)
    def run(g: pd.Series, *vals: pd.Series) -> pd.Series:
        out = []
        for i, x in enumerate(g):
            r = None if x is None else fn(K.to_numpy(x), *[v.iloc[i] for v in vals])
            out.append(K.from_numpy(r) if r else None)
        return pd.Series(out, dtype=object)

    # marked so that a later filter on the result is not merged into a second evaluation
    return run.asNondeterministic()(col, *args)


def geometries_udf(fn, *args: Column, geom: str = "geom") -> Column:
    """fn(geometry, *values) -> list of geometries, as an array to explode."""

    @F.pandas_udf(f"array<{GEOMETRY}>")
    def run(g: pd.Series, *vals: pd.Series) -> pd.Series:
        return pd.Series([[] if x is None else [K.from_numpy(r) for r in fn(K.to_numpy(x), *[v.iloc[i] for v in vals])] for i, x in enumerate(g)], dtype=object)

    return run(F.col(geom), *args)


def binary_udf(fn, kind: str = "double"):
    """fn(a, b) of two geometry columns."""

    @F.pandas_udf(GEOMETRY if kind == "geometry" else kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = [None if x is None or y is None else fn(K.to_numpy(x), K.to_numpy(y)) for x, y in zip(a, b)]
        if kind == "geometry":
            out = [K.from_numpy(r) if r else None for r in out]
        return pd.Series(out, dtype=object if kind == "geometry" else None)

    return run


def exploded(df: DataFrame, array: Column, name: str = "geom", position: str | None = None) -> DataFrame:
    """One row for each element, replacing ``name``; a position counts from 1."""
    rest = [c for c in df.columns if c not in (name, position)]
    d = df.select(*rest, F.posexplode(array).alias("_pos", name))
    return (d.withColumn(position, F.col("_pos") + 1) if position else d).drop("_pos")
