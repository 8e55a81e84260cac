"""Spatial weights as a table of pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import with_xy
from . import cells, dense

#: Pairs above which a concept without a band is refused.
MAX_PAIRS = 4_000_000_000
#: Concepts whose sums are taken without pairs as rows.
WITHOUT_BAND = ("InverseDistance", "InverseDistanceSquared")


def events(df: DataFrame, xv: str, yv: str | None = None, fid: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """id, x, y, xv, yv; a null value counts as 1, and other shapes than points stand at their centroid."""
    return with_xy(df, x, y).select(F.col(fid).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.coalesce(F.col(xv).cast("double"), F.lit(1.0)).alias("xv"), (F.coalesce(F.col(yv).cast("double"), F.lit(1.0)) if yv else F.lit(1.0)).alias("yv"))


def distance(method: str = "Euclidean", a=("x", "y"), b=("x2", "y2")) -> Column:
    dx, dy = F.col(a[0]) - F.col(b[0]), F.col(a[1]) - F.col(b[1])
    return F.abs(dx) + F.abs(dy) if method == "Manhattan" else F.sqrt(dx * dx + dy * dy)


def other(ev: DataFrame) -> DataFrame:
    return ev.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("xv").alias("xv2"), F.col("yv").alias("yv2"))


def default_band(ev: DataFrame, method: str = "Euclidean") -> float:
    """Largest nearest-neighbour distance times 1.0001."""
    near = cells.nearest(ev, other(ev).select("id2", "x2", "y2"), 1, "id", "id2", exclude_self=True)
    full = near.join(ev.select("id", "x", "y"), "id").join(other(ev).select("id2", "x2", "y2"), "id2")
    return (full.agg(F.max(distance(method))).first()[0] or 0.0) * 1.0001


def _checked(ev: DataFrame) -> DataFrame:
    n = ev.count()
    if n * n > MAX_PAIRS:
        raise ValueError(f"{n} features make {n * n} pairs; use FixedDistance or KNearestNeighbors")
    return ev


def _all_pairs(ev: DataFrame) -> DataFrame:
    return _checked(ev).crossJoin(other(ev))


def dense_sums(ev: DataFrame, how: str = "None", concept: str = "InverseDistance", method: str = "Euclidean", self_neighbors: bool = False) -> DataFrame:
    """Sums of the pairs of a concept of ``WITHOUT_BAND`` by id, as ``autocorr`` takes them from ``standardized(pairs())``, without the pairs as rows."""
    points = dense.gathered(_checked(ev))
    nameless = dense.gathered(ev, True) if self_neighbors else points[:0]  # a pair is told from a feature's own by its id

    def weigh(d):
        d = np.maximum(d, 1, out=d)
        return np.reciprocal(np.multiply(d, d, out=d) if concept == "InverseDistanceSquared" else d, out=d)

    points, nameless = points.assign(part=1.0), nameless.assign(part=1.0)  # a weight is divided by the row's sum: wij = w * part of i, wji = w * part of j
    if how != "None":
        raw = dense.pair_sums(ev, points, method, weigh, lambda w, a, b, earlier: w.sum(axis=1, keepdims=True), ["s"], self_neighbors, nameless).toPandas()
        s = points[["id"]].merge(raw, on="id", how="left")["s"].to_numpy(float)
        points["part"] = np.where(s <= 0, 0.0, 1 / np.where(s == 0, 1, s))
        nameless["part"] = 0.0

    def add(w, a, b, earlier):
        one, other = np.ones_like(b["part"]), b["part"]
        raw, swji, swx, swy = (w @ np.column_stack([one, other, b["xv"], b["yv"]])).T[..., None]
        d = a["xv"] - b["xv"]
        swd = np.einsum("ij,ij->i", w, np.multiply(d, d, out=d))[:, None]
        nn = (w.shape[1] - (0 if w.all() else (w == 0).sum(axis=1, keepdims=True))) * (a["part"] > 0)
        own, across, others = (np.multiply(w, w, out=w) @ np.column_stack([one, other, other * other])).T[..., None]
        part = a["part"]
        return np.hstack([part * raw, swji, part**2 * own, part**2 * own + 2 * part * across + others, part * swx, part * swy, part * swd, nn, raw])

    out = dense.pair_sums(ev, points, method, weigh, add, ["sw", "swji", "sw2", "s1", "swx", "swy", "swd", "nn", "raw"], self_neighbors, nameless)
    return out.withColumn("nn", F.col("nn").cast("long"))


def pairs(ev: DataFrame, concept: str = "InverseDistance", method: str = "Euclidean", band: float = 0.0, k: int = 8, self_neighbors: bool = False, contiguity: DataFrame | None = None) -> DataFrame:
    """id, xv, yv, id2, xv2, yv2, d, w: one row for each pair with a weight."""
    d = distance(method)
    if concept in ("InverseDistance", "InverseDistanceSquared"):
        out = _all_pairs(ev).withColumn("d", d)
        w = F.when(F.col("d") <= 1, 1.0).otherwise(1 / F.col("d")) if concept == "InverseDistance" else F.when(F.col("d") <= 1, 1.0).otherwise(1 / (F.col("d") * F.col("d")))
    elif concept == "ZoneOfIndifference":
        band = band or default_band(ev, method)
        out = _all_pairs(ev).withColumn("d", d)
        w = F.when(F.col("d") > band, 1 / ((F.col("d") - band) + 1)).otherwise(1.0)
    elif concept == "FixedDistance":
        band = band or default_band(ev, method)
        out = cells.point_pairs(ev, other(ev), band).withColumn("d", d).where(F.col("d") <= band)  # Manhattan is never below Euclidean
        w = F.lit(1.0)
    elif concept == "KNearestNeighbors":
        near = cells.nearest(ev, other(ev).select("id2", "x2", "y2"), min(k, 24), "id", "id2", exclude_self=True)
        out = near.select("id", "id2").join(ev, "id").join(other(ev), "id2").withColumn("d", d)
        if self_neighbors:
            out = out.unionByName(ev.join(other(ev), F.col("id") == F.col("id2")).withColumn("d", F.lit(0.0)).select(*out.columns))
        w = F.lit(1.0)
    elif concept.startswith("Contiguity"):
        if contiguity is None:
            raise ValueError("contiguity needs the pairs of touching features")
        out = contiguity.select("id", "id2").join(ev, "id").join(other(ev), "id2").withColumn("d", d)
        w = F.lit(1.0)
    else:
        raise ValueError(f"unknown spatial concept {concept}")
    if not self_neighbors:
        out = out.where("id <> id2")
    return out.select("id", "xv", "yv", "id2", "xv2", "yv2", "d").withColumn("w", w)


def standardized(p: DataFrame, how: str = "None") -> DataFrame:
    """wij and wji; Row divides by the row sums of i and of j."""
    if how == "None":
        return p.withColumn("wij", F.col("w")).withColumn("wji", F.col("w"))
    rows = p.groupBy("id").agg(F.sum("w").alias("_s"))
    p = p.join(rows, "id").join(rows.select(F.col("id").alias("id2"), F.col("_s").alias("_t")), "id2", "left")
    return p.withColumn("wij", F.when(F.col("_s") > 0, F.col("w") / F.col("_s")).otherwise(0.0)).withColumn("wji", F.when(F.col("_t") > 0, F.col("w") / F.col("_t")).otherwise(0.0)).drop("_s", "_t")


def rectangle_contiguity(boxes: DataFrame, kind: str = "Queen", size: float | None = None) -> DataFrame:
    """id, id2 of touching boxes (id, xmin, ymin, xmax, ymax): Queen any contact, Rook an edge, Bishops a corner only."""
    if size is None:
        size = boxes.agg(F.max(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")))).first()[0] or 1.0
    right = boxes.select(F.col("id").alias("id2"), *[F.col(c).alias(f"{c}2") for c in ("xmin", "ymin", "xmax", "ymax")])
    met = cells.box_pairs(boxes.select("id", "xmin", "ymin", "xmax", "ymax"), right, size).where("id <> id2")
    corner = (F.least("xmax", "xmax2") - F.greatest("xmin", "xmin2") <= 0) & (F.least("ymax", "ymax2") - F.greatest("ymin", "ymin2") <= 0)
    met = met.where({"Queen": F.lit(True), "Rook": ~corner, "Bishops": corner}[kind])
    return met.select("id", "id2")


def polygon_contiguity(df: DataFrame, kind: str = "Queen", fid: str = "fid") -> DataFrame:
    """id, id2 of polygons (fid, geom) whose boundaries meet: Queen any contact, Rook a common edge, Bishops points only."""
    from .. import kernels as K
    from ..operators.overlay import candidates

    @F.pandas_udf("double")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        found = [K.contact(K.to_numpy(x), K.to_numpy(y)) for x, y in zip(a, b)]
        return pd.Series([length if met else None for met, length in found], dtype="float64")

    pairs = candidates(df, df, fid, fid).where("_a < _b").withColumn("common", common("_ga", "_gb")).where("common is not null and not isnan(common)")
    pairs = pairs.where({"Queen": F.lit(True), "Rook": F.col("common") > 0, "Bishops": F.col("common") == 0}[kind])
    one = pairs.select(F.col("_a").alias("id"), F.col("_b").alias("id2"))
    return one.union(one.select("id2", "id"))
