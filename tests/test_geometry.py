import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoweft import kernels as K
from geoweft.functions import crs, expr
from geoweft.functions.ecql import to_sql
from geoweft.operators import raster, stats
from geoweft.sources import features


def square(x, y, s):
    return [[K.close(np.array([(x, y), (x + s, y), (x + s, y + s), (x, y + s)], float))]]


points = st.lists(st.tuples(st.integers(-50, 50), st.integers(-50, 50)), min_size=4, max_size=12, unique=True)


@settings(max_examples=60, deadline=None)
@given(points, points)
def test_area_identities(p, q):
    a, b = [[K.convex_hull(np.array(p, float))]], [[K.convex_hull(np.array(q, float))]]
    if not K.area(a) or not K.area(b):
        return
    i = K.area(K.intersection(a, b))
    assert K.area(a) == pytest.approx(i + K.area(K.difference(a, [b])), abs=1e-5)
    assert K.area(K.union([a, b])) == pytest.approx(K.area(a) + K.area(b) - i, abs=1e-5)


@settings(max_examples=40, deadline=None)
@given(points)
def test_hull_and_triangles(p):
    xy = np.array(p, float)
    hull = K.convex_hull(xy)
    if abs(K.ring_area(hull)) == 0:
        return
    assert K.contains([[hull]], xy).all()
    assert sum(abs(K.ring_area(K.close(xy[t]))) for t in K.delaunay(xy)) == pytest.approx(abs(K.ring_area(hull)), rel=1e-6)
    x, y, r = K.bounding_circle(xy)
    assert (np.hypot(xy[:, 0] - x, xy[:, 1] - y) <= r + 1e-6).all()


def test_holes_and_parts():
    ring = K.difference(square(0, 0, 4), [square(1, 1, 2)])
    assert K.area(ring) == 12 and len(ring[0]) == 2
    assert K.area(K.union([ring, square(1, 1, 2)])) == 16
    assert K.union([square(0, 0, 1), square(1, 0, 1)]) and len(K.union([square(0, 0, 1), square(1, 0, 1)])[0][0]) == 5
    assert K.intersection(square(0, 0, 1), square(5, 5, 1)) == []


def test_buffers():
    line = [[np.array([(0, 0), (3, 0)], float)]]
    assert K.area(K.buffer(line, 1, 64)) == pytest.approx(6 + math.pi, rel=1e-3)
    assert K.area(K.buffer(line, 1, 8, "Flat")) == pytest.approx(6)
    assert K.area(K.buffer(line, 1, 8, "Square")) == pytest.approx(10)
    assert K.area(K.buffer(square(0, 0, 4), -1)) == pytest.approx(4)


def test_voronoi_fills_the_box():
    p = np.random.default_rng(1).uniform(size=(80, 2))
    assert sum(abs(K.ring_area(v)) for v in K.voronoi(p, square(0, 0, 1)[0][0])) == pytest.approx(1)


def test_units():
    assert expr.convert_area(1.0, "SquareKilometers", "Acre") == pytest.approx(247.10538146716533)
    assert expr.convert_length(1.0, "Kilometers", "Miles") == pytest.approx(0.621371192237334)


def test_projections():
    x, y = crs.transform_xy(np.array([127.5]), np.array([37.2]), "EPSG:4326", "EPSG:32652")
    lon, lat = crs.transform_xy(x, y, "EPSG:32652", "EPSG:4326")
    assert lon[0] == pytest.approx(127.5, abs=1e-8) and lat[0] == pytest.approx(37.2, abs=1e-8)
    assert crs.transform_xy(np.array([129.0]), np.array([0.0]), "EPSG:4326", "EPSG:32652")[0][0] == pytest.approx(500000, abs=1e-3)
    with pytest.raises(ValueError):
        crs.code("EPSG:5186")


def test_tails():
    assert stats.t_tail(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert stats.f_tail(3.0, 2, 10) == pytest.approx(0.0953674, abs=1e-6)


def test_wkt():
    for t in ("POINT (1.0 2.0)", "LINESTRING (0.0 0.0, 1.0 1.0)", "POLYGON ((0.0 0.0, 4.0 0.0, 4.0 4.0, 0.0 0.0))", "MULTIPOINT ((1.0 2.0), (3.0 4.0))"):
        assert features.to_wkt_text(features.parse_wkt(t)) == t
    assert features.parse_wkt("nonsense") is None


def test_ecql():
    assert to_sql("name = 'INCLUDE' AND INCLUDE") == "name = 'INCLUDE' AND true"
    assert "x BETWEEN 1 AND 3" in to_sql("BBOX(geom, 1, 2, 3, 4)")
    assert to_sql("strConcat(a, b) = 'x'") == "concat(a, b) = 'x'"


def test_ranges():
    assert raster.parse_ranges("0 10 1; 10 20 2;") == [(0.0, 10.0, 1), (10.0, 20.0, 2)]


def test_random_points_are_uniform_and_inside():
    rng = np.random.default_rng(2)
    ring = np.array([(0, 0), (10, 0), (10, 4), (5, 4), (5, 10), (0, 10), (0, 0)], float)  # an L of area 70 with a hole of 4
    hole = np.array([(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)], float)
    p = K.random_points([[ring, hole]], rng, 40_000)
    assert len(p) == 40_000 and K.contains([[ring, hole]], p).all()
    assert (p[:, 1] > 4).mean() == pytest.approx(30 / 66, abs=0.01) and (p[:, 0] > 5).mean() == pytest.approx(20 / 66, abs=0.01)
    triangle = np.array([(0, 0), (6, 0), (0, 3), (0, 0)], float)
    q = K.random_points([[triangle]], rng, 40_000)
    assert q.mean(axis=0) == pytest.approx([2, 1], abs=0.03)
    sliver = np.array([(0, 0), (1e6, 1e6), (1e6, 1e6 + 1e-3), (0, 0)], float)
    assert len(K.random_points([[sliver]], rng, 5)) == 5
    assert len(K.random_points([[np.array([(0, 0), (1, 0), (0, 0)], float)]], rng, 5)) == 0


@pytest.mark.parametrize(
    "code, lon, lat, x, y, within",
    [
        ("EPSG:2154", 3.0, 46.5, 700000.0, 6600000.0, 1e-6),
        ("EPSG:25832", 9.0, 0.0, 500000.0, 0.0, 1e-6),
    ],
)
def test_projected_places(code, lon, lat, x, y, within):
    u, v = crs.transform_xy(np.array([lon]), np.array([lat]), "EPSG:4258", code)
    assert u[0] == pytest.approx(x, abs=within) and v[0] == pytest.approx(y, abs=within)


def test_published_examples_of_projections():
    """Worked examples of the guidance note on projections: transverse Mercator on Airy's ellipsoid, Lambert on two parallels."""
    e, n = crs.system("EPSG:27700").forward(np.array([0.5]), np.array([50.5]))
    assert float(e[0]) == pytest.approx(577274.99, abs=0.01) and float(n[0]) == pytest.approx(69740.50, abs=0.01)
    foot = 0.3048006096012192
    clarke = crs.Datum(6378206.4, 294.9786982)
    texas = crs.LambertConic(clarke, -99.0, 27 + 50 / 60, 28 + 23 / 60, 30 + 17 / 60, 1.0, 2000000.0 * foot, 0.0)
    e, n = texas.forward(np.array([-96.0]), np.array([28.5]))
    assert float(e[0] / foot) == pytest.approx(2963503.91, abs=0.02) and float(n[0] / foot) == pytest.approx(254759.80, abs=0.02)


def test_systems_return_to_their_place(spark):
    lon, lat = np.array([-1.5, 2.35, 6.0]), np.array([52.0, 48.85, 45.0])
    for code in ("EPSG:27700", "EPSG:2154", "EPSG:4277", "EPSG:25831", "EPSG:32631"):
        back = crs.transform_xy(*crs.transform_xy(lon, lat, "EPSG:4326", code), code, "EPSG:4326")
        assert np.allclose(back[0], lon, atol=1e-8) and np.allclose(back[1], lat, atol=1e-8), code
    moved = crs.transform_xy(lon, lat, "EPSG:4277", "EPSG:4326")
    assert 50 < 111000 * np.hypot(moved[0][0] - lon[0], moved[1][0] - lat[0]) < 300
    crs.define(999001, crs.TransverseMercator(crs.GRS80, 127.0, 38.0, 1.0, 200000.0, 600000.0))
    from pyspark.sql import functions as F

    u, v = crs.transform_columns(F.col("x"), F.col("y"), "EPSG:4326", "EPSG:999001")
    r = spark.createDataFrame([(127.0, 38.0)], "x double, y double").select(u.alias("u"), v.alias("v")).first()
    assert (round(r.u, 6), round(r.v, 6)) == (200000.0, 600000.0)
