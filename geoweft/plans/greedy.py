"""The greedy choice of points in the order of their ids, by tiles: a point is kept unless a kept one of smaller id lies within a distance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialize

#: About how many places a tile has in the first round.
TILE = 5000


class _Near:
    """Points by cells of side ``radius``, each number in the order of the arrays."""

    def __init__(self, x: np.ndarray, y: np.ndarray, radius: float):
        self.x, self.y, self.radius = x, y, radius
        self.cx, self.cy = (np.floor((v - v.min()) / radius).astype(np.int64) + 1 for v in (x, y))
        self.wide = int(self.cx.max()) + 2
        code = self.cy * self.wide + self.cx
        self.order = np.argsort(code, kind="stable")
        self.code = code[self.order]

    def later(self, i: int) -> np.ndarray:
        """Numbers above i of points within the radius of it."""
        at = (self.cy[i] + np.arange(-1, 2)) * self.wide + self.cx[i]
        low, high = np.searchsorted(self.code, at - 1), np.searchsorted(self.code, at + 1, side="right")
        found = np.concatenate([self.order[a:b] for a, b in zip(low, high)])
        found = found[found > i]
        return found[np.hypot(self.x[found] - self.x[i], self.y[found] - self.y[i]) <= self.radius]


def _round(pdf: pd.DataFrame, radius: float) -> pd.DataFrame:
    """What one tile can tell of its own points: kept (1), gone (left out) or still unknown (0)."""
    pdf = pdf.sort_values("fid", kind="stable")
    own, kept = pdf["own"].to_numpy(bool), pdf["kept"].to_numpy() == 1
    if not (own & ~kept).any():
        return pdf[own][["fid", "x", "y", "kept"]]
    near = _Near(pdf["x"].to_numpy(), pdf["y"].to_numpy(), radius)
    gone, doubt, state = np.zeros(len(pdf), bool), np.zeros(len(pdf), bool), np.full(len(pdf), -1)
    for i in range(len(pdf)):
        if gone[i]:
            continue
        if kept[i] or (own[i] and not doubt[i]):
            state[i] = 1
            gone[near.later(i)] = True
        else:  # another tile's, or one of smaller id near it is unknown
            state[i] = 0
            doubt[near.later(i)] = True
    return pdf.assign(kept=state)[own & ~gone][["fid", "x", "y", "kept"]]


def _take(pdf: pd.DataFrame, radius: float) -> pd.DataFrame:
    """For each kept point the places of a tile that it is the first to take."""
    pdf = pdf.sort_values(["fid", "own"], kind="stable", ignore_index=True)  # a kept point before its own place
    near, n, kept = _Near(pdf["x"].to_numpy(), pdf["y"].to_numpy(), radius), pdf["n"].to_numpy(), pdf["kept"].to_numpy() == 1
    free, out = pdf["own"].to_numpy(bool), []
    for i in np.flatnonzero(kept):
        hit = near.later(i)
        hit = hit[free[hit]]
        free[hit] = False
        out.append((pdf["fid"].iat[i], int(n[hit].sum())))
    return pd.DataFrame(out, columns=["fid", "n"])


def _tiled(df: DataFrame, side: float, radius: float, shift: float, own: bool | None) -> DataFrame:
    """Rows in their tile (own 1) and, but where ``own``, in each other one within the radius (own 0)."""
    at = lambda c, by: F.floor((F.col(c) + F.lit(by + shift)) / side)
    d = df.withColumn("_tx", at("x", 0.0)).withColumn("_ty", at("y", 0.0))
    if own:
        return d.withColumn("own", F.lit(1))
    wide = radius * (1 + 1e-9)
    d = d.withColumn("_ax", F.explode(F.sequence(at("x", -wide), at("x", wide)))).withColumn("_ay", F.explode(F.sequence(at("y", -wide), at("y", wide))))
    d = d.withColumn("own", ((F.col("_ax") == F.col("_tx")) & (F.col("_ay") == F.col("_ty"))).cast("int")).withColumn("_tx", F.col("_ax")).withColumn("_ty", F.col("_ay"))
    return d.drop("_ax", "_ay")


def merged(df: DataFrame, radius: float) -> DataFrame:
    """fid, n of the kept points of ``df`` (fid long, x, y double): how many points each takes, itself included.

    Points of one place go together.  In a round a tile settles the points whose fate depends on its own and on kept ones; those near
    its edge may stay unknown, and the next round has tiles of twice the side at other places.  Kept points are sparse and points that
    are taken drop out, so that rounds get smaller; the last has one tile at most.
    """
    known = F.expr("x is not null and y is not null and not isnan(x) and not isnan(y)")
    alone = df.where(~known).groupBy("fid").agg(F.lit(1).cast("long").alias("n"))
    places = materialize(df.where(known).groupBy("x", "y").agg(F.min("fid").alias("fid"), F.count("*").alias("n")), "places")
    block = 8 * radius
    cells = places.groupBy(F.floor(F.col("x") / block), F.floor(F.col("y") / block)).count().agg(F.avg("count")).first()[0] or TILE
    first = block * max(1.0, (TILE / cells) ** 0.5)
    now, side, shift = places.select("fid", "x", "y", F.lit(0).alias("kept")), first, 0.0
    while True:
        tiles = _tiled(now, side, radius, shift, None)
        done = materialize(tiles.groupBy("_tx", "_ty").applyInPandas(lambda pdf: _round(pdf, radius), "fid long, x double, y double, kept int"), "greedy")
        discard(now)
        now, side, shift = done, side * 2, shift + side / 2
        if not now.where("kept = 0").head(1):
            break
    rows = _tiled(places.withColumn("kept", F.lit(0)), first, radius, 0.0, True).unionByName(_tiled(now.withColumn("n", F.lit(0).cast("long")), first, radius, 0.0, None).withColumn("own", F.lit(0)))
    taken = rows.groupBy("_tx", "_ty").applyInPandas(lambda pdf: _take(pdf, radius), "fid long, n long")
    return taken.groupBy("fid").agg(F.sum("n").alias("n")).unionByName(alone)
