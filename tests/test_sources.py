"""Round trips of file formats, and files put together by hand."""

import datetime
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweft import kernels as K
from geoweft.operators import raster
from geoweft.sources import geotiff, shapefile

SQUARE = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)]
HOLE = [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]
FAR = [(9, 9), (9, 10), (10, 10), (9, 9)]


def geom(*parts):
    return [[[{"x": float(x), "y": float(y)} for x, y in r] for r in p] for p in parts]


@pytest.fixture()
def features(spark):
    day = datetime.date(2024, 2, 29)
    rows = [
        (1, "plain", 1.5, True, day, geom([SQUARE, HOLE], [FAR])),
        (2, None, None, None, None, geom([[(0, 0), (1, 1), (2, 0)]], [[(5, 5), (6, 6)]])),
        (3, "ä" * 200, -1e-7, False, day, geom([[(3, 4)]])),
        (4, "many", 1e200, True, day, geom([[(3, 4)]], [[(5, 6)]])),
        (5, "", 0.1, True, day, None),
    ]
    return spark.createDataFrame(rows, "fid long, a_very_long_name string, v double, ok boolean, a_very_long_day date, geom " + "array<array<array<struct<x:double,y:double>>>>")


def test_shapefile_round_trip(spark, features, tmp_path):
    folder = str(tmp_path / "out")
    assert shapefile.write_shapefile(features.repartition(2), folder) == 5
    out = {r.fid: r for r in shapefile.read_shapefile(spark, folder).collect()}
    assert sorted(out) == [1, 2, 3, 4, 5] and set(out[1].asDict()) == {"fid", "a_very_lon", "v", "ok", "a_very_lo1", "geom"}
    for r in features.collect():
        got = out[r.fid]
        assert (got.v, got.ok, got.a_very_lo1) == (r.v, r.ok, r.a_very_long_day)
        if r.geom is None:
            assert got.geom is None
            continue
        a, b = K.to_numpy(r.geom), K.to_numpy(got.geom)
        assert [len(p) for p in a] == [len(p) for p in b] and K.is_polygon(a) == K.is_polygon(b)
        assert all({tuple(v) for v in x} == {tuple(v) for v in y} for p, q in zip(a, b) for x, y in zip(p, q))
    assert out[3].a_very_lon == "ä" * 127 and out[5].a_very_lon is None
    assert K.area(K.to_numpy(out[1].geom)) == pytest.approx(16 - 1 + 0.5)
    one = next(p for p in (tmp_path / "out").glob("*.shp"))
    assert shapefile.read_shapefile(spark, str(one)).count() >= 1
    empty = str(tmp_path / "none")
    assert shapefile.write_shapefile(features.where("false"), empty) == 0


def test_shapefile_of_other_origin(spark, tmp_path):
    """Point Z records, one of them deleted in the .dbf, and a shapefile without a .dbf."""
    def record(i, x, y):
        body = struct.pack("<i4d", 11, x, y, 7.0, 0.0)
        return struct.pack(">ii", i, len(body) // 2) + body

    body = record(1, 1, 2) + record(2, 3, 4)
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + len(body) // 2) + struct.pack("<ii8d", 1000, 11, *[0.0] * 8)
    field = struct.pack("<11sc4xBB14x", b"N", b"N", 4, 0)
    dbf = struct.pack("<4BIHH20x", 3, 1, 1, 1, 2, 65, 5) + field + b"\r" + b"*   1" + b"    2" + b"\x1a"
    (tmp_path / "P.shp").write_bytes(head + body)
    (tmp_path / "P.dbf").write_bytes(dbf)
    rows = shapefile.read_shapefile(spark, str(tmp_path / "P.shp")).collect()
    assert [(r.N, r.geom[0][0][0].x, r.geom[0][0][0].y) for r in rows] == [(2, 3.0, 4.0)]
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "q.shp").write_bytes(head + body)
    assert shapefile.read_shapefile(spark, str(tmp_path / "b")).count() == 2


def test_geotiff_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(geotiff, "TILE", 16)
    meta = raster.Meta(40, 25, 1000.0, 2000.0, 2.5, 5.0, "EPSG:32652", -1.0)
    cells = spark.range(2000).select((F.col("id") % 2).cast("int").alias("band"), F.floor(F.col("id") / 80).cast("int").alias("row"), (F.floor(F.col("id") / 2) % 40).cast("int").alias("col"), F.when(F.col("id") % 7 != 0, F.col("id") / 3).alias("value"))
    assert geotiff.write_geotiff(raster.Raster(cells, meta), str(tmp_path / "t")) == 6
    back = geotiff.read_geotiff(spark, str(tmp_path / "t"))
    assert back.meta == meta
    assert sorted(map(tuple, back.cells.collect()), key=str) == sorted(map(tuple, cells.collect()), key=str)


@pytest.mark.parametrize("order", ["<", ">"])
def test_geotiff_of_other_origin(spark, tmp_path, order):
    """A tiled, interleaved file of 16-bit samples with predictor, in either byte order."""
    v = np.arange(2 * 5 * 6).reshape(5, 6, 2) * 37 % 5000
    full = np.zeros((16, 16, 2), f"{order}u2")
    full[:5, :6] = v
    coded = full.copy()
    coded[:, 1:] = full[:, 1:] - full[:, :-1]
    raw = zlib.compress(coded.tobytes())
    entries = [(256, "H", [6]), (257, "H", [5]), (258, "H", [16, 16]), (259, "H", [8]), (262, "H", [1]), (277, "H", [2]), (284, "H", [1]), (317, "H", [2]), (322, "H", [16]), (323, "H", [16]), (324, "I", [8]), (325, "I", [len(raw)])]
    at = 8 + len(raw) + len(raw) % 2
    ifd = struct.pack(f"{order}H", len(entries))
    for tag, kind, x in entries:
        ifd += struct.pack(f"{order}HHI", tag, {"H": 3, "I": 4}[kind], len(x)) + struct.pack(f"{order}{len(x)}{kind}", *x).ljust(4, b"\0")
    data = {"<": b"II", ">": b"MM"}[order] + struct.pack(f"{order}HI", 42, at) + raw.ljust(at - 8, b"\0") + ifd + b"\0" * 4
    (tmp_path / "a.tif").write_bytes(data)
    r = geotiff.read_geotiff(spark, str(tmp_path / "a.tif"))
    assert (r.meta.ncols, r.meta.nrows, r.meta.dx) == (6, 5, 1.0)
    got = {(x.row, x.col, x.band): x.value for x in r.cells.collect()}
    assert got == {k: float(n) for k, n in np.ndenumerate(v)}
