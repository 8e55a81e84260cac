import math

import pytest
from pyspark.sql import functions as F

from geoweft.operators import autocorr, grids, joins, raster, stats
from geoweft.plans.components import components
from geoweft.plans.weights import rectangle_contiguity
from geoweft.sources import features, rasters
from geoweft.streaming.binning import stream_binning


def board(spark, n=8):
    d = spark.range(n * n).select((F.col("id") + 1).alias("id"), (F.col("id") % n).alias("c"), F.floor(F.col("id") / n).alias("r"))
    d = d.withColumn("v", ((F.col("c") + F.col("r")) % 2).cast("double"))
    return d.select("id", "v", *[e.cast("double").alias(a) for a, e in (("x", F.col("c")), ("y", F.col("r")), ("xmin", F.col("c")), ("ymin", F.col("r")), ("xmax", F.col("c") + 1), ("ymax", F.col("r") + 1))])


def test_checkerboard(spark):
    b = board(spark)
    m = autocorr.global_morans_i(b, "v", "ContiguityEdgesOnly", contiguity=rectangle_contiguity(b, "Rook")).first()
    assert m.observed == pytest.approx(-1)
    assert rectangle_contiguity(b, "Queen").count() == rectangle_contiguity(b, "Rook").count() + rectangle_contiguity(b, "Bishops").count()


def test_inclined_plane(spark):
    r = raster.Raster(spark.range(100).select(F.lit(0).alias("band"), F.floor(F.col("id") / 10).cast("int").alias("row"), (F.col("id") % 10).cast("int").alias("col"), ((F.col("id") % 10) * 2.0).alias("value")), raster.Meta(10, 10, 0, 0, 1, 1))
    inner = "row between 1 and 8 and col between 1 and 8"
    assert {round(x.value, 9) for x in raster.slope(r).cells.where(inner).collect()} == {round(math.degrees(math.atan(2)), 9)}
    assert {x.value for x in raster.aspect(r).cells.where(inner).collect()} == {270.0}


def test_exact_line(spark):
    d = spark.range(50).select(F.col("id").cast("double").alias("x"), (3.0 * F.col("id") + 2).alias("y"))
    rep = {r.variable: r for r in stats.ols(d, "y", ["x"])["report"].collect()}
    assert rep["x"].coefficient == pytest.approx(3) and rep["Intercept"].coefficient == pytest.approx(2) and rep["x"].r2 == pytest.approx(1)


def test_lattice_quadrats(spark):
    d = spark.range(400).select((F.col("id") % 20 + 0.5).alias("x"), (F.floor(F.col("id") / 20) + 0.5).alias("y"))
    assert stats.quadrat(d, 4.75).first().variance == pytest.approx(0, abs=1e-9)


def test_nulls_and_empty(spark):
    d = spark.createDataFrame([(1, 0.0, 0.0, None), (2, 1.0, 1.0, 5.0), (3, 3.0, 1.0, None)], "fid long, x double, y double, w double")
    assert grids.rectangular_binning(d, 1, 1, "w", (0.0, 0.0, 4.0, 4.0)).count() == 1
    e = d.where("false")
    assert grids.rectangular_binning(e, 1, 1, "w", (0.0, 0.0, 4.0, 4.0)).count() == 0
    assert grids.rectangular_binning(e, 1, 1, "w", (0.0, 0.0, 4.0, 4.0), False).count() == 16
    assert {r.near_id for r in joins.near(d, e).collect()} == {None}
    s = {r.field: r for r in stats.statistics(d, ["w"]).collect()}["w"]
    assert (s["count"], s.invalid, s.mean) == (1, 2, 5.0)


def test_ties_go_to_the_least_id(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0)], "fid long, x double, y double")
    b = spark.createDataFrame([(9, 1.0, 0.0), (4, -1.0, 0.0), (7, 0.0, 1.0)], "fid long, x double, y double")
    assert joins.near(a, b).first().near_id == 4


def test_partitions_do_not_matter(spark, data):
    from geoweft import fixtures

    s = fixtures.suppliers(spark, data)
    got = [sorted((r.fid, r.LMiIndex) for r in autocorr.local_morans_i(s.repartition(n), "v", "FixedDistance", band=200.0, fid="fid").collect()) for n in (1, 4, 16)]
    assert all([(f, pytest.approx(v, abs=1e-6)) for f, v in got[0]] == g for g in got[1:])


def test_components(spark):
    d = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (6, 7), (7, 5), (9, 9)], "u long, v long")
    assert {r.node: r.component for r in components(d).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5}
    chain = spark.range(1, 200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.component for r in components(chain).collect()} == {1}


def test_round_trips(spark, tmp_path):
    r = raster.Raster(spark.range(12).select(F.lit(0).alias("band"), F.floor(F.col("id") / 4).cast("int").alias("row"), (F.col("id") % 4).cast("int").alias("col"), F.when(F.col("id") != 5, F.col("id").cast("double")).alias("value")), raster.Meta(4, 3, 10.0, 20.0, 2.0, 2.0))
    rasters.write_raster(r, str(tmp_path / "r"))
    back = rasters.read_raster(spark, str(tmp_path / "r"))
    assert back.meta == r.meta and {(x.row, x.col, x.value) for x in back.cells.collect()} == {(x.row, x.col, x.value) for x in r.cells.collect()}
    f = tmp_path / "g.asc"
    f.write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9999\n1 2\n-9999 4\n")
    assert [x.value for x in rasters.read_ascii_grid(spark, str(f)).cells.orderBy("row", "col").collect()] == [1.0, 2.0, None, 4.0]
    g = grids.fishnet(spark, (0.0, 0.0, 2.0, 1.0), 2, 1).select("uid", "geom")
    features.write_geojson(g, str(tmp_path / "j"))
    assert sorted(r.uid for r in features.read_geojson(spark, str(tmp_path / "j"), "uid long").collect()) == [1, 2]
    (tmp_path / "p.csv").write_text("id,lon,lat\n1,2.5,3\n2,bad,4\n")
    assert features.read_text_points(spark, str(tmp_path / "p.csv"), "id int, lon string, lat string", "lon", "lat").count() == 1


def test_stream(spark, data, tmp_path):
    from geoweft import fixtures

    t = fixtures.tracks(spark, data)
    t.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    q = stream_binning(s, 100, 100).writeStream.outputMode("complete").format("memory").queryName("bins").start()
    q.processAllAvailable()
    q.stop()
    total = spark.sql("SELECT sum(count) FROM bins").first()[0]
    assert total == t.count() == stream_binning(t, 100, 100).agg(F.sum("count")).first()[0]


def test_store(spark):
    import os

    from geoweft.plans import store

    t = store.materialize(spark.range(5), "five")
    folder = t._stored_at.removeprefix("file:")
    assert t.count() == 5 and os.path.isdir(folder)
    store.discard(t)
    assert not os.path.isdir(folder)
    store.discard(spark.range(3))


def test_natural_breaks_weigh_rows(spark, monkeypatch):
    import itertools

    from geoweft.operators import vector

    counts = {0.0: 1, 1.0: 400, 2.0: 1, 3.0: 1, 4.0: 300, 5.0: 1, 6.0: 2}
    df = spark.createDataFrame([(v,) for v, n in counts.items() for _ in range(n)], "v double")

    def spread(part):
        n = sum(counts[v] for v in part)
        mean = sum(v * counts[v] for v in part) / n
        return sum(counts[v] * (v - mean) ** 2 for v in part)

    xs = sorted(counts)
    cuts = min(itertools.combinations(range(1, len(xs)), 2), key=lambda c: sum(spread(xs[a:b]) for a, b in itertools.pairwise((0, *c, len(xs)))))
    want = [0.0, *(xs[c - 1] for c in cuts), 6.0]
    assert vector.class_breaks(df, "v", "NaturalBreaks", 3) == want
    rare = spark.range(20000).select((F.col("id") % 1000 / 1000.0).alias("v")).union(spark.createDataFrame([(100.0,), (101.0,)], "v double"))
    assert vector.class_breaks(rare, "v", "NaturalBreaks", 2) == [0.0, 0.999, 101.0]
    monkeypatch.setattr(vector, "MAX_BREAK_VALUES", 500)
    assert vector.class_breaks(rare, "v", "NaturalBreaks", 2) == [0.0, 0.999, 101.0]
