"""Nearest neighbours against brute force: spread, clustered, repeated and far points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweft.operators import joins
from geoweft.plans import cells, quadtree


def _frame(spark, xy, names):
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], f"{names[0]} long, {names[1]} double, {names[2]} double")


def _brute(a, b, k, self_too, within):
    out = {}
    for i, p in enumerate(a):
        d = np.hypot(*(b - p).T)
        near = sorted((round(v, 9), j) for j, v in enumerate(d) if (self_too or j != i) and v <= within)[:k]
        out |= {(i, j): r + 1 for r, (_, j) in enumerate(near)}
    return out


def _points(kind, rng, n):
    if kind == "spread":
        return rng.uniform(0, 1000, (n, 2))
    if kind == "clustered":
        return np.concatenate([rng.normal(0, 0.01, (n - 2, 2)), [[1e6, 1e6], [-5e5, 3]]])
    if kind == "lattice":
        return rng.integers(0, 12, (n, 2)).astype(float)
    return np.concatenate([np.full((n - 3, 2), 7.0), rng.uniform(0, 9, (3, 2))])


@pytest.mark.parametrize("kind", ["spread", "clustered", "lattice", "one place"])
@pytest.mark.parametrize(("k", "self_too", "within"), [(1, True, None), (5, False, None), (3, True, 4.0)])
def test_equals_brute_force(spark, monkeypatch, kind, k, self_too, within):
    monkeypatch.setattr(quadtree, "LEAF", 4)
    rng = np.random.default_rng(4)
    b = _points(kind, rng, 300)
    a = b if not self_too else np.concatenate([_points(kind, rng, 60), rng.uniform(-2000, 2000, (20, 2))])
    got = cells.nearest(_frame(spark, a, ("id", "x", "y")), _frame(spark, b, ("id2", "x2", "y2")), k, exclude_self=not self_too, within=within)
    rows = got.collect()
    assert {(r.id, r.id2): r["rank"] for r in rows} == _brute(a, b, k, self_too, within or np.inf)


def test_few_and_none(spark):
    a, none = _frame(spark, [(0, 0), (1, 1)], ("id", "x", "y")), _frame(spark, [(0, 0)], ("id2", "x2", "y2")).where("false")
    assert cells.nearest(a, none, 3).count() == 0
    assert cells.nearest(a, _frame(spark, [(5, 5)], ("id2", "x2", "y2")), 3).count() == 2
    nowhere = a.selectExpr("id", "cast(null as double) as x", "y")
    assert cells.nearest(nowhere, _frame(spark, [(5, 5)], ("id2", "x2", "y2")), 3).count() == 0


def test_clustered_points_ask_for_few_leaves():
    rng = np.random.default_rng(1)
    xy = np.concatenate([rng.normal(0, 1, (4000, 2)), [[1e6, 0]]])
    corner, wide = tuple(xy.min(axis=0)), float(np.ptp(xy, axis=0).max()) * (1 + 1e-9)
    f = np.floor((xy - corner) / wide * 2.0**quadtree.DEPTH).astype(int)
    cells_, counts = np.unique(f >> 6, axis=0, return_counts=True)
    tree = quadtree.Tree(corner, wide, [(quadtree.DEPTH - 6, *map(int, c), int(n)) for c, n in zip(cells_, counts)])
    who, _, _ = tree.needed(xy[:, 0], xy[:, 1], 1, np.inf)
    assert np.bincount(who).max() < 40


def test_boxes_of_all_sizes_meet_once(spark):
    """Against all pairs: tiny, middle and huge boxes, equal boxes, boxes that only touch, and places."""
    rng = np.random.default_rng(5)

    def boxes(n, first):
        low, side = rng.uniform(-50, 50, (n, 2)), 10 ** rng.uniform(-2, 2.5, (n, 1)) * rng.uniform(0, 1, (n, 2))
        side[:5] = 0
        low[5:9], side[5:9] = np.floor(low[5:9]), 4
        return [(first + i, *map(float, np.concatenate([a, a + b]))) for i, (a, b) in enumerate(zip(low, side))]

    a, b = boxes(150, 0), boxes(120, 1000)
    a += [(500, 0.0, 0.0, 1.0, 1.0), (501, 0.0, 0.0, 1.0, 1.0), (502, None, None, None, None)]
    b += [(1500, 1.0, 1.0, 2.0, 2.0), (1501, 0.0, 0.0, 1.0, 1.0)]
    left = spark.createDataFrame(a, "id long, xmin double, ymin double, xmax double, ymax double")
    right = spark.createDataFrame(b, "id2 long, xmin2 double, ymin2 double, xmax2 double, ymax2 double")
    want = sorted((p[0], q[0]) for p in a for q in b if p[1] is not None and p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    for size in (0.5, 7.0, 1000.0):
        assert sorted((r.id, r.id2) for r in cells.box_pairs(left, right, size).collect()) == want
    assert cells.box_pairs(left.where("false"), right, 1.0).count() == 0


def test_snap_to_the_nearest_of_many_lines(spark):
    rng = np.random.default_rng(3)
    a = rng.uniform(0, 100, (120, 2))
    ends = [(i, [[[tuple(p.tolist()), tuple((p + d).tolist())]]]) for i, (p, d) in enumerate(zip(a, rng.normal(0, 4, (120, 2))))]
    ends += [(500, [[[(50.0, 50.0), (50.0, 50.0)]]]), (501, [[[(-300.0, 7.0), (400.0, 9.0)]]]), (502, None)]
    places = [*rng.uniform(-20, 120, (300, 2)).tolist(), [50.0, 50.0], [9e4, -7e5], [None, 3.0]]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "fid long, x double, y double")
    lines = spark.createDataFrame(ends, "fid long, geom array<array<array<struct<x:double,y:double>>>>")
    got = {r.fid: r for r in joins.snap_points_to_lines(points, lines).collect()}
    seg = np.array([(*g[0][0][0], *g[0][0][1]) for _, g in ends if g])
    for i, (x, y) in enumerate(places[:-1]):
        u = seg[:, 2:] - seg[:, :2]
        t = np.clip(((np.array([x, y]) - seg[:, :2]) * u).sum(axis=1) / np.maximum((u * u).sum(axis=1), 1e-300), 0, 1)
        want = np.hypot(*(seg[:, :2] + t[:, None] * u - [x, y]).T).min()
        assert got[i].snap_dist == pytest.approx(want, rel=1e-12, abs=1e-12)
    assert got[302].snap_dist is None and got[302].y == 3.0 and len(got) == 303
    few = points.where("fid < 300").join(joins.points_nearest_segments(points, lines), F.col("fid") == F.col("pid"))
    assert few.count() < 300 * len(seg) / 3  # not every line with every point
    assert {r.snap_dist for r in joins.snap_points_to_lines(points, lines.where("false")).collect()} == {None}
