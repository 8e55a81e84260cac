"""Splines of more samples than a dense matrix is solved for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweft.operators import surface


@pytest.mark.parametrize("field", ["3 * x - 2 * y + 5", "sin(x / 9) * y + id % 7"])
def test_spline_by_steps(spark, monkeypatch, field):
    rng = np.random.default_rng(5)
    xy = np.unique(rng.integers(0, 100, (900, 2)), axis=0).tolist()
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, x double, y double").withColumn("z", F.expr(field))
    cells = lambda: surface.thin_plate_spline(df, "z", 10.0, (0.0, 0.0, 100.0, 100.0)).cells.orderBy("row", "col").toPandas()["value"].to_numpy()
    want = cells()
    monkeypatch.setattr(surface, "MAX_SPLINE_POINTS", 100)
    got = cells()
    assert len(got) == 100 and got == pytest.approx(want, abs=1e-6)
