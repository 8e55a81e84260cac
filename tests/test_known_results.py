"""Operators without SQL, on inputs whose result is known."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweft import kernels as K
from geoweft.functions import expr as E
from geoweft.operators import aggregate, buffers, construct, distribution, edit, grids, raster, stats, surface
from geoweft.plans.weights import polygon_contiguity


def points(spark, xy, **more):
    rows = [(i, float(a), float(b), *[float(v[i]) for v in more.values()]) for i, (a, b) in enumerate(xy)]
    return spark.createDataFrame(rows, "fid long, x double, y double" + "".join(f", {n} double" for n in more))


def shapes(spark, geoms, **more):
    rows = [(i, [[[(float(a), float(b)) for a, b in ring] for ring in part] for part in g], *[float(v[i]) for v in more.values()]) for i, g in enumerate(geoms)]
    return spark.createDataFrame(rows, f"fid long, geom {E.GEOMETRY}" + "".join(f", {n} double" for n in more))


def line(*xy):
    return [[list(xy)]]


def box(a, b, c, d):
    return [[[(a, b), (c, b), (c, d), (a, d), (a, b)]]]


def plane(spark, n, f, cell=10.0):
    cells = spark.range(n * n).select(F.lit(0).alias("band"), F.floor(F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"))
    x, y = (F.col("col") + 0.5) * cell, n * cell - (F.col("row") + 0.5) * cell
    return raster.Raster(cells.withColumn("value", f(x, y).cast("double")), raster.meta_for((0.0, 0.0, n * cell, n * cell), cell))


def test_median_center(spark):
    rng = np.random.default_rng(1)
    xy, w = rng.normal(0, 10, (60, 2)), rng.uniform(1, 5, 60)
    c = np.average(xy, axis=0, weights=w)
    for _ in range(3000):
        k = w / np.hypot(*(xy - c).T)
        c = (xy * k[:, None]).sum(axis=0) / k.sum()
    got = distribution.median_center(points(spark, xy, w=w), "w").first()
    assert (got.x, got.y) == pytest.approx(tuple(c), abs=1e-3)


def test_k_means_finds_separate_clusters(spark):
    rng = np.random.default_rng(2)
    xy = np.concatenate([rng.normal(c, 1, (40, 2)) for c in ((0, 0), (100, 0), (50, 90))])
    got = {r.fid: r.cluster for r in stats.k_means(points(spark, xy), k=3).collect()}
    groups = [{got[i] for i in range(40 * g, 40 * g + 40)} for g in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3


def test_triangulation_covers_the_hull(spark):
    rng = np.random.default_rng(3)
    xy = rng.uniform(0, 100, (80, 2))
    hull = K.convex_hull(xy)
    t = construct.delaunay(points(spark, xy)).select(E.area(F.col("geom")).alias("a")).collect()
    assert len(t) == 2 * 80 - 2 - (len(hull) - 1) and sum(r.a for r in t) == pytest.approx(abs(K.ring_area(hull)))


def test_tin_and_bilinear_resampling_are_exact_on_a_plane(spark):
    rng = np.random.default_rng(4)
    xy = np.concatenate([rng.uniform(0, 100, (40, 2)), [(-1, -1), (101, -1), (101, 101), (-1, 101)]])
    got = surface.tin(points(spark, xy, v=3 * xy[:, 0] - 2 * xy[:, 1] + 5), "v", 10.0, (0.0, 0.0, 100.0, 100.0)).cells.collect()
    assert len(got) == 100
    for r in got:
        assert r.value == pytest.approx(3 * (r.col * 10 + 5) - 2 * (100 - r.row * 10 - 5) + 5, abs=1e-6)
    flat = plane(spark, 12, lambda x, y: 2 * x + y)
    fine = raster.resample(flat, 5.0, "BILINEAR")
    for r in fine.cells.where("row between 2 and 20 and col between 2 and 20").collect():
        assert r.value == pytest.approx(2 * (r.col * 5 + 2.5) + 120 - r.row * 5 - 2.5, abs=1e-6)


def test_line_of_sight(spark):
    flat = plane(spark, 20, lambda x, y: F.lit(0.0))
    assert all(r.visible for r in raster.linear_line_of_sight(flat, (5.0, 105.0), (195.0, 105.0)).collect())
    wall = plane(spark, 20, lambda x, y: F.when((x > 100) & (x < 110), 50.0).otherwise(0.0))
    seen = raster.linear_line_of_sight(wall, (5.0, 105.0), (195.0, 105.0)).collect()
    assert all(r.visible for r in seen if r.distance < 90) and not any(r.visible for r in seen if r.distance > 115)


def test_planted_cluster_is_found(spark):
    rng = np.random.default_rng(5)
    people = points(spark, rng.uniform(0, 1000, (2000, 2)), pop=np.ones(2000))
    sick = np.concatenate([rng.uniform(0, 1000, (100, 2)), rng.normal(500, 25, (40, 2))])
    cases = points(spark, sick, cas=np.ones(140)).withColumnRenamed("fid", "id")
    found = stats.besag_newell(people, "pop", cases, "cas", 25).collect()
    assert found and all(r.cases == 25 for r in found) and all(math.hypot(r.x - 500, r.y - 500) < r.radius + 75 for r in found)
    for r in found:
        inside = np.hypot(*(np.array([(q.x, q.y) for q in people.collect()]) - (r.x, r.y)).T) <= r.radius
        assert r.population == inside.sum() and r.expected == pytest.approx(inside.sum() * 140 / 2000)
        break
    at = stats.cluster_gam(people, "pop", cases, "cas", 50.0, 60.0, 10.0).toPandas()
    assert len(at) and (np.hypot(at.x - 500, at.y - 500) < 150).mean() > 0.5


def test_clumps_and_merged_events(spark):
    xy = [(0, 0), (3, 0), (6, 0), (100, 0), (102, 0), (300, 300)]
    area = [r.a for r in aggregate.spatial_clumps(points(spark, xy), "2.0").select(E.area(F.col("geom")).alias("a")).collect()]
    assert len(area) == 3 and min(area) == pytest.approx(4 * math.pi, rel=0.05)
    near = aggregate.collect_events(points(spark, [(0, 0), (0.5, 0), (50, 0), (0.2, 0.1)]), tolerance=1.0).collect()
    assert sorted(r.icount for r in near) == [1, 3]


def test_lines_that_cross(spark):
    cross = shapes(spark, [line((0, 0), (104, 0)), line((100, -50), (100, 50)), line((0, 30), (95, 30))])
    length = lambda d: {r.fid: r.n for r in d.select("fid", E.length(F.col("geom")).alias("n")).collect()}
    assert length(edit.trim_line(cross, 10.0))[0] == pytest.approx(100)
    assert length(edit.extend_line(cross, 10.0))[2] == pytest.approx(100)
    pieces = construct.feature_to_line(cross).select("fid", E.length(F.col("geom")).alias("n")).collect()
    assert sorted(round(r.n, 6) for r in pieces) == [4, 50, 50, 95, 100]


def test_areas_of_polygons_made_from_lines(spark):
    lines = shapes(spark, [line((0, 0), (100, 0))])
    wide = buffers.variable_buffer(lines, "10", "5", segments=64).select(E.area(F.col("geom")).alias("a")).first().a
    # two circles of radius 5 and 10 at a distance of 100 and their outer tangents
    s = math.asin(5 / 100)
    want = 100 * math.cos(s) * 15 + 100 * (math.pi / 2 + s) + 25 * (math.pi / 2 - s)
    assert wide == pytest.approx(want, rel=0.01)
    parts = edit.split_polygon_by_count(shapes(spark, [box(0, 0, 90, 60)]), "6").select(E.area(F.col("geom")).alias("a")).collect()
    assert len(parts) == 6 and sum(r.a for r in parts) == pytest.approx(5400) and min(r.a for r in parts) > 450
    rounded = edit.smooth(shapes(spark, [line((0, 0), (10, 10), (20, 0))])).first().geom[0][0]
    assert (rounded[0].x, rounded[-1].x) == (0, 20) and len(rounded) > 3 and max(v.y for v in rounded) <= 10 + 1e-9


def test_concave_hull_of_a_ring_of_points(spark):
    angle = np.linspace(0, 2 * math.pi, 200, endpoint=False)
    xy = np.concatenate([np.column_stack([np.cos(angle), np.sin(angle)]) * r for r in (8, 9, 10)])
    hull = construct.concave_hull(points(spark, xy), alpha=0.15).select(E.area(F.col("geom")).alias("a")).first().a
    assert hull == pytest.approx(math.pi * (100 - 64), rel=0.05)


def test_density_of_a_line(spark):
    r = surface.line_density(shapes(spark, [line((0, 105), (200, 105))]), radius=30.0, cell=10.0, extent=(0.0, 0.0, 200.0, 200.0))
    rows = {k.row: k.value for k in r.cells.where("col = 10").collect()}
    assert max(rows, key=lambda k: rows[k] or 0) in (9, 10) and not rows[0] and not rows[19]


def test_rings_and_polar_cells(spark):
    one = points(spark, [(0, 0)])
    areas = [r.a for r in grids.polar_grids(one, [10.0, 20.0], "ring", 8).select(E.area(F.col("geom")).alias("a")).collect()]
    assert sum(areas) == pytest.approx(math.pi * 400, rel=0.02)


def test_contiguity_of_polygons(spark):
    # a square, a triangle on half of its right edge, a square at a corner, one apart, an L that follows two edges
    geoms = [box(0, 0, 10, 10), [[[(10, 0), (15, 0), (10, 5), (10, 0)]]], box(10, 10, 20, 20), box(30, 30, 40, 40), [[[(-5, -5), (10, -5), (10, 0), (0, 0), (0, 10), (-5, 10), (-5, -5)]]]]
    pairs = lambda kind: {(r.id, r.id2) for r in polygon_contiguity(shapes(spark, geoms), kind).collect()}
    both = lambda *p: {q for a, b in p for q in ((a, b), (b, a))}
    assert pairs("Queen") == both((0, 1), (0, 2), (0, 4), (1, 4))
    assert pairs("Rook") == both((0, 1), (0, 4))
    assert pairs("Bishops") == both((0, 2), (1, 4))
    assert K.contact([[np.array(box(0, 0, 10, 10)[0][0], float)]], [[np.array(box(0, 0, 4, 10)[0][0], float)]])[1] == pytest.approx(18)


def test_regions_of_cut_and_fill(spark):
    hill = plane(spark, 10, lambda x, y: F.when(x < 30, 8.0).when(x < 60, 5.0).otherwise(1.0))
    got = {r.flag: r.a for r in raster.cut_fill_regions(hill, base_height=5.0).select("flag", E.area(F.col("geom")).alias("a")).collect()}
    assert got == pytest.approx({1: 3000, 0: 3000, -1: 4000})
    assert {r.flag for r in raster.cut_fill_regions(hill, hill).collect()} == {0}


def test_random_points_of_polygons_are_as_many_as_asked(spark):
    zones = shapes(spark, [box(0, 0, 10, 10), box(20, 0, 21, 1), box(30, 0, 30 + 1e-6, 1), box(40, 0, 50, 30)])
    for count in (1, 7, 1000):
        assert grids.random_points(spark, None, count, zones).count() == count
