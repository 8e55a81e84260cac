"""Merging of points within a tolerance, in the order of their ids, against a pass over all of them."""

import numpy as np
import pytest

from geoweft.operators import aggregate
from geoweft.plans import greedy


def one_by_one(points, tolerance):
    left, out = [p for p in sorted(points) if p[1] is not None], {p[0]: 1 for p in points if p[1] is None}
    while left:
        f, x, y = left[0]
        rest = [p for p in left[1:] if np.hypot(p[1] - x, p[2] - y) > tolerance]
        out[f], left = len(left) - len(rest), rest
    return out


@pytest.mark.parametrize("kind", ["random", "in a row", "clusters"])
def test_collect_events_in_tiles(spark, monkeypatch, kind):
    monkeypatch.setattr(greedy, "TILE", 20)
    monkeypatch.setattr(aggregate, "components", lambda links: pytest.fail("links of all pairs"))
    rng = np.random.default_rng(1)
    xy = {"random": rng.integers(-60, 60, (500, 2)) / 1.0, "in a row": np.column_stack([np.arange(500) * 0.9, np.zeros(500)]), "clusters": rng.normal(0, 0.5, (500, 2)) + rng.integers(0, 4, (500, 1)) * 40 - 50}[kind]
    points = [(i, *p) for i, p in enumerate(xy.tolist())] + [(900, *xy[3].tolist()), (901, 1e6, -1e6), (902, None, 1.0)]
    got = aggregate.collect_events(spark.createDataFrame(points, "fid long, x double, y double"), tolerance=1.0)
    assert {r.fid: r.icount for r in got.collect()} == one_by_one(points, 1.0)
