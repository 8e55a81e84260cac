"""A quadtree over points, with a bounded number of leaves, that tells which leaves a k-nearest search needs.

Counts of cells come from a few aggregations; only cells with more than ``cap`` points are looked into, and
``cap`` grows with the table so that at most about ``LEAVES`` leaves reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Levels of the finest cells, and about how many leaves there may be.
DEPTH, LEAVES = 26, 50_000
#: Points of a leaf where the table is small.
LEAF = 16


def _spread(v: np.ndarray) -> np.ndarray:
    """The bits of v at the even places."""
    v = v.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | v << np.uint64(shift)) & np.uint64(mask)
    return v


class Tree:
    """Nodes by level; a node's children lie side by side on the next level or the node is a leaf."""

    def __init__(self, corner: tuple[float, float], wide: float, leaves: list[tuple[int, int, int, int]]):
        """``leaves``: (level, column, row, points)."""
        self.corner, self.wide = corner, wide
        level, cx, cy, n = (np.array(c, np.int64) for c in zip(*leaves))
        start = _spread(cx << (DEPTH - level)) | _spread(cy << (DEPTH - level)) << np.uint64(1)
        order = np.argsort(start, kind="stable")
        self.start, self.level, self.n = start[order], level[order], n[order]
        self.cx, self.cy = cx[order], cy[order]

    def leaf(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Leaf that holds each place; the places are points of the table."""
        fx, fy = (np.minimum(np.floor((v - c) / self.wide * 2.0**DEPTH), 2**DEPTH - 1).astype(np.int64) for v, c in zip((x, y), self.corner))
        code = _spread(fx) | _spread(fy) << np.uint64(1)
        return np.searchsorted(self.start, code, side="right") - 1

    def _split(self, level: int, low: np.ndarray, high: np.ndarray):
        """Children (owner, low, high) at ``level`` of nodes given as ranges of leaves."""
        shift = np.uint64(2 * (DEPTH - level))
        owner, lows, highs = [], [], []
        base = self.start[low] >> (shift + np.uint64(2)) << np.uint64(2)
        for c in range(4):
            a = np.searchsorted(self.start, (base + np.uint64(c)) << shift)
            b = np.searchsorted(self.start, (base + np.uint64(c + 1)) << shift)
            a, b = np.maximum(a, low), np.minimum(b, high)
            some = np.flatnonzero(b > a)
            owner.append(some)
            lows.append(a[some])
            highs.append(b[some])
        return map(np.concatenate, (owner, lows, highs))

    def needed(self, x: np.ndarray, y: np.ndarray, k: int, within: float, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the place, leaf, radius): leaves that may hold one of its k nearest, or a point farther than that by ``slack`` at most, and the distance they lie in."""
        total = np.concatenate([[0], np.cumsum(self.n)])
        who, low, high = np.arange(len(x)), np.zeros(len(x), np.int64), np.full(len(x), len(self.start))
        radius = np.full(len(x), within)
        for level in range(DEPTH + 1):
            single = high - low == 1
            size = self.wide / 2.0 ** np.where(single, self.level[low], level)
            at = np.where(single, self.level[low], level)
            left = self.corner[0] + (self.cx[low] >> (self.level[low] - at)) * size
            down = self.corner[1] + (self.cy[low] >> (self.level[low] - at)) * size
            px, py = x[who], y[who]
            near = np.hypot(np.maximum(np.maximum(left - px, px - left - size), 0), np.maximum(np.maximum(down - py, py - down - size), 0))
            far = np.hypot(np.maximum(px - left, left + size - px), np.maximum(py - down, down + size - py))
            order = np.lexsort((far, who))
            first = np.searchsorted(who[order], np.arange(len(x)))
            points = np.cumsum((total[high] - total[low])[order])
            before = np.concatenate([[0], points])[first]
            enough = points - before[who[order]] >= k
            np.minimum.at(radius, who[order][enough], far[order][enough] * (1 + 1e-9) + self.wide * 1e-12)
            keep = near <= (radius[who] + slack) * (1 + 1e-9) + self.wide * 1e-12
            who, low, high = who[keep], low[keep], high[keep]
            single = high - low == 1
            if single.all():
                break
            done = who[single], low[single], high[single]
            owner, a, b = self._split(level + 1, low[~single], high[~single])
            who, low, high = np.concatenate([done[0], who[~single][owner]]), np.concatenate([done[1], a]), np.concatenate([done[2], b])
            order = np.argsort(who, kind="stable")
            who, low, high = who[order], low[order], high[order]
        return who, low, radius[who] + slack


def _at(value: Column, corner: float, wide: float, level: int) -> Column:
    finest = F.least(F.floor((value - F.lit(corner)) / F.lit(wide) * F.lit(2.0**DEPTH)), F.lit(2**DEPTH - 1)).cast("long")
    return F.shiftright(finest, DEPTH - level)


def build(points: DataFrame, n: int, corner: tuple[float, float], wide: float, x: str = "x2", y: str = "y2") -> Tree:
    """The tree of ``n`` points in the square at ``corner``."""
    cap = max(LEAF, n // LEAVES)
    level, leaves, rest = 0, [], None
    while level < DEPTH and cap << 2 * level < n:
        level += 1
    while True:
        cells = points if rest is None else points.join(F.broadcast(rest), (_at(F.col(x), corner[0], wide, before) == F.col("_px")) & (_at(F.col(y), corner[1], wide, before) == F.col("_py")), "left_semi")
        rows = cells.groupBy(_at(F.col(x), corner[0], wide, level).alias("c"), _at(F.col(y), corner[1], wide, level).alias("r")).count().collect()  # 16 cells at most for each that is full
        full = [(r[0], r[1]) for r in rows if r[2] > 4 * cap and level < DEPTH]
        heavy = set(full)
        leaves += [(level, r[0], r[1], r[2]) for r in rows if (r[0], r[1]) not in heavy]
        if not full:
            return Tree(corner, wide, leaves)
        rest, before, level = points.sparkSession.createDataFrame(full, "_px long, _py long"), level, min(DEPTH, level + 2)
