"""Reading and writing features: delimited text, Parquet, JDBC, WKT and GeoJSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import kernels as K
from ..functions.expr import GEOMETRY


def read_text_points(spark: SparkSession, path: str, schema: str, x: str | None = None, y: str | None = None, wkt: str | None = None, delimiter: str = ",", header: bool = True, source: str | None = None, target: str | None = None) -> DataFrame:
    """Delimited text with coordinate columns or a WKT column; coordinates that do not parse drop the row."""
    d = spark.read.csv(path, schema=schema, sep=delimiter, header=header)
    if wkt:
        d = d.withColumn("geom", from_wkt(wkt)).where("geom is not null")
        return d.withColumn("x", F.col("geom")[0][0][0].x).withColumn("y", F.col("geom")[0][0][0].y)
    d = d.withColumn("x", F.expr(f"try_cast(`{x}` as double)")).withColumn("y", F.expr(f"try_cast(`{y}` as double)")).where("x is not null and y is not null")
    if source and target:
        from ..functions.crs import transform_columns

        u, v = transform_columns(F.col("x"), F.col("y"), source, target)
        d = d.withColumn("_u", u).withColumn("_v", v).withColumn("x", F.col("_u")).withColumn("y", F.col("_v")).drop("_u", "_v")
    return d


def read_jdbc(spark: SparkSession, url: str, table: str, partition: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 16, **options) -> DataFrame:
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition:
        r = r.options(partitionColumn=partition, lowerBound=lower, upperBound=upper, numPartitions=partitions)
    return r.load()


def parse_wkt(text: str | None) -> K.Geometry | None:
    """POINT, LINESTRING, POLYGON and their MULTI forms; anything else is None."""
    m = re.match(r"\s*(MULTI)?(POINT|LINESTRING|POLYGON)\s*(?:Z|M|ZM)?\s*(\(.*\))\s*$", text or "", re.I | re.S)
    if not m:
        return None
    body = re.sub(r"(-?[\d.]+(?:[eE][-+]?\d+)?)\s+(-?[\d.]+(?:[eE][-+]?\d+)?)[^,()]*", r"[\1,\2]", m[3]).replace("(", "[").replace(")", "]")
    try:
        v = json.loads(body)
    except ValueError:
        return None
    kind = m[2].upper()
    if kind == "POLYGON":
        parts = v if m[1] else [v]
    elif kind == "LINESTRING":
        parts = [[p] for p in v] if m[1] else [[v]]
    else:
        parts = [[[p[0] if isinstance(p[0], list) else p]] for p in v]
    return [[K.np.array(r, float).reshape(-1, 2) for r in p] for p in parts]


def to_wkt_text(geom: K.Geometry) -> str:
    pts = lambda r: "(" + ", ".join(f"{x!r} {y!r}" for x, y in r.tolist()) + ")"
    if K.is_polygon(geom):
        parts = ["(" + ", ".join(map(pts, p)) + ")" for p in geom]
        return f"POLYGON {parts[0]}" if len(parts) == 1 else f"MULTIPOLYGON ({', '.join(parts)})"
    kind = "POINT" if all(len(r) == 1 for p in geom for r in p) else "LINESTRING"
    paths = [pts(r) for p in geom for r in p]
    return f"{kind} {paths[0]}" if len(paths) == 1 else f"MULTI{kind} ({', '.join(paths)})"


def from_wkt(column: str):
    @F.pandas_udf(GEOMETRY)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([K.from_numpy(g) if (g := parse_wkt(t)) else None for t in s], dtype=object)

    return run(F.col(column))


def to_wkt(column: str = "geom"):
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if g is None else to_wkt_text(K.to_numpy(g)) for g in s], dtype=object)

    return run(F.col(column))


def _geojson(geom: K.Geometry, decimals: int = 10) -> dict:
    r = lambda q: [[round(x, decimals), round(y, decimals)] for x, y in q.tolist()]
    if K.is_polygon(geom):
        c = [[r(q) for q in p] for p in geom]
        return {"type": "Polygon", "coordinates": c[0]} if len(c) == 1 else {"type": "MultiPolygon", "coordinates": c}
    paths = [r(q) for p in geom for q in p]
    if all(len(p) == 1 for p in paths):
        c = [p[0] for p in paths]
        return {"type": "Point", "coordinates": c[0]} if len(c) == 1 else {"type": "MultiPoint", "coordinates": c}
    return {"type": "LineString", "coordinates": paths[0]} if len(paths) == 1 else {"type": "MultiLineString", "coordinates": paths}


def to_geojson(df: DataFrame, geom: str = "geom") -> DataFrame:
    """One GeoJSON feature a row, in a column ``value``; coordinates have ten decimals."""
    own = [c for c in df.columns if c != geom]

    @F.pandas_udf("string")
    def run(g: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([json.dumps({"type": "Feature", "geometry": None if v is None else _geojson(K.to_numpy(v)), "properties": json.loads(q)}) for v, q in zip(g, p)])

    return df.select(run(F.col(geom), F.to_json(F.struct(*own)) if own else F.lit("{}")).alias("value"))


def write_geojson(df: DataFrame, path: str, geom: str = "geom") -> None:
    """Newline-delimited features."""
    to_geojson(df, geom).write.mode("overwrite").text(path)


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Newline-delimited features with the given properties schema."""

    @F.pandas_udf(GEOMETRY)
    def geom(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            g = (json.loads(t) or {}).get("geometry") or {}
            c, k = g.get("coordinates"), g.get("type", "")
            if c is None:
                out.append(None)
                continue
            parts = {"Point": lambda: [[[c]]], "MultiPoint": lambda: [[[p]] for p in c], "LineString": lambda: [[c]], "MultiLineString": lambda: [[p] for p in c], "Polygon": lambda: [c], "MultiPolygon": lambda: c}[k]()
            out.append([[[{"x": float(v[0]), "y": float(v[1])} for v in r] for r in p] for p in parts])
        return pd.Series(out, dtype=object)

    d = spark.read.text(path).where("value <> ''")
    return d.select(F.from_json(F.get_json_object("value", "$.properties"), properties).alias("p"), geom("value").alias("geom")).select("p.*", "geom")


def write_features(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite").format(fmt)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
