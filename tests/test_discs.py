"""Unions of discs by tiles against the union by slabs, and no union of a whole clump in one task."""

import math

import numpy as np
import pandas as pd
import pytest

from geoweft import kernels as K
from geoweft.functions import expr as E
from geoweft.operators import aggregate
from geoweft.plans import discs


def perimeter(geom):
    return sum(K.path_length(ring) for part in geom for ring in part)


def slabs(at, segments):
    """Count, area and perimeter by least number of a clump: pairs one by one, and one union of whole polygons."""
    root = list(range(len(at)))
    for _ in at:
        for i, (x, y, r) in enumerate(at):
            for j, (u, v, q) in enumerate(at):
                if math.hypot(x - u, y - v) <= r + q:
                    root[i] = root[j] = min(root[i], root[j])
    out = {}
    for c in set(root):
        geom = K.union([[[K.circle_ring(*at[i], segments)]] for i in range(len(at)) if root[i] == c])
        out[c] = (root.count(c), K.area(geom), perimeter(geom), len(geom), sum(len(p) - 1 for p in geom))
    return out


def by_tile(at, segments):
    """The same of one tile."""
    x, y, r = np.array(at, float).T
    eps = 1e-11 * r.min() + 1e-15 * max(np.abs(x).max(), np.abs(y).max())
    rows = discs.tile(pd.DataFrame({"fid": np.arange(len(at)), "x": x, "y": y, "r": r, "shared": 1, "top": r.max(), "own": True}), segments, eps)
    links = rows[rows["v"].notna()]
    root = discs._join(np.arange(len(at)), links["fid"].to_numpy(), links["v"].to_numpy(int))
    shapes = discs.assembled(rows[rows["v"].isna()].assign(clump=lambda d: root[d["fid"]]), 20 * eps / math.sin(2 * math.pi / segments))
    out = {}
    for c, xs, ys in zip(shapes["clump"], shapes["xs"], shapes["ys"]):
        geom = [[np.column_stack(ring) for ring in zip(*part)] for part in zip(xs, ys)]
        out[c] = (int((root == c).sum()), K.area(geom), perimeter(geom), len(geom), sum(len(p) - 1 for p in geom))
    return out


def alike(got, want):
    assert got.keys() == want.keys()
    for c, w in want.items():
        assert got[c] == pytest.approx(w, rel=1e-6, abs=1e-6), c


rng = np.random.default_rng(5)
CASES = {
    "random": [(*rng.uniform(0, 12, 2), 2.0) for _ in range(25)],
    "mixed radii": [(*rng.uniform(0, 12, 2), float(rng.uniform(0.05, 3))) for _ in range(25)],
    "whole numbers": sorted({(float(a), float(b), 2.0) for a, b in rng.integers(0, 9, (25, 2))}),
    "far from the origin": sorted({(a + 1e6, b - 1e6, 2.0) for a, b in rng.integers(0, 12, (20, 2))}),
    "touching": [(0.0, 0.0, 2.0), (4.0, 0.0, 2.0), (2.0, 2.0, 2.0), (0.0, 4.0, 2.0), (20.0, 0.0, 1.0)],
    "one in another": [(0.0, 0.0, 5.0), (1.0, 1.0, 1.0), (0.0, 0.0, 2.0), (5.0, 0.0, 1.0)],
    "a ring round a hole and a disc in it": [(10 * math.cos(k * math.pi / 16), 10 * math.sin(k * math.pi / 16), 1.5) for k in range(32)] + [(0.0, 0.0, 3.0)],
    "edges on one another": [(5 + a * math.cos(math.pi / 8), 5 + a * math.sin(math.pi / 8), 2.0) for a in (0.0, 1.0, 2.5, 2.5 + 4 * math.cos(math.pi / 8))],
}


@pytest.mark.parametrize("segments", [4, 8, 32])
@pytest.mark.parametrize("case", CASES)
def test_tile_against_slabs(case, segments, monkeypatch):
    monkeypatch.setattr(discs, "PAIRS", 20)
    alike(by_tile(CASES[case], segments), slabs(CASES[case], segments))


def measured(df, segments=8):
    got = aggregate.spatial_clumps(df, "r", segments).select("uid", "count", E.area("geom").alias("area"), E.length("geom").alias("length"), "geom").collect()
    assert len({r.uid for r in got}) == len(got)
    return {r.uid: (r["count"], r.area, r.length, len(r.geom), sum(len(p) - 1 for p in r.geom)) for r in got}


@pytest.mark.parametrize("case", ["random", "mixed radii", "whole numbers"])
def test_clumps_need_no_union_of_whole_polygons(spark, monkeypatch, case):
    def whole(*_args, **_more):
        raise AssertionError("a clump's polygons were united in one task")

    monkeypatch.setattr(aggregate, "unite", whole)
    monkeypatch.setattr(discs, "TILE", 3)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(CASES[case])], "fid long, x double, y double, r double").repartition(3)
    alike(measured(df), slabs(CASES[case], 32))


def test_odd_points_of_clumps(spark):
    inf, nan, one = float("inf"), float("nan"), 32 / 2 * math.sin(2 * math.pi / 32)
    rows = [(1, 0.0, 0.0, 1.0), (2, 0.0, 0.0, 1.0), (3, 50.0, 0.0, 1.0), (3, 90.0, 0.0, 1.0), (4, None, 0.0, 1.0), (5, nan, 0.0, 1.0), (None, 0.0, 0.0, 1.0), (6, 20.0, 0.0, inf), (7, 0.0, 9.0, 0.0), (2**60 + 1, 70.0, 0.0, 1.0), (2**60 + 3, 71.0, 0.0, 1.0), (3, None, 1.0, 1.0)]
    got = measured(spark.createDataFrame(rows, "fid long, x double, y double, r double"))
    assert {k: v[:1] + v[3:] for k, v in got.items()} == {1: (2, 1, 0), 3: (3, 2, 0), 4: (1, 0, 0), 5: (1, 0, 0), 6: (1, 0, 0), 2**60 + 1: (2, 1, 0)}
    assert (got[1][1], got[3][1], got[4][1]) == pytest.approx((one, 2 * one, 0))
    assert measured(spark.createDataFrame([], "fid long, x double, y double, r double")) == {}
