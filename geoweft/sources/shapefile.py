"""Shapefiles: one file, or a folder of them, read by one task a file and written by one task a partition.

Read: records deleted in the .dbf go, a null shape is a null geometry, Z and M values are left out.  The
columns come from the .dbf of least path; fields that another file lacks are null.  Written: a folder of
files, one set a partition and kind of shape, since a file holds one kind; a file ends at FILE_BYTES.
"""

from __future__ import annotations

import datetime
import io
import struct

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import kernels as K
from .files import read_files, write_file

# Shape types of the format, less 10 or 20 for those with Z or M.
POINT, POLYLINE, POLYGON, MULTIPOINT = 1, 3, 5, 8
FILE_BYTES = 256 << 20
BATCH = 10_000

GEOMETRY_TYPE = T.ArrayType(T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))))


def _fields(dbf: bytes) -> list[tuple[str, str, int, int]]:
    """name, type letter, width, decimals of the fields of a .dbf."""
    out, at = [], 32
    while at + 32 <= len(dbf) and dbf[at] != 0x0D:
        name = dbf[at : at + 11].split(b"\0")[0].decode("latin-1").strip()
        out.append((name, chr(dbf[at + 11]), dbf[at + 16], dbf[at + 17]))
        at += 32
    return out


def _type(letter: str, width: int, decimals: int) -> T.DataType:
    if letter == "N" and not decimals and width <= 18:
        return T.LongType()
    return {"N": T.DoubleType(), "F": T.DoubleType(), "L": T.BooleanType(), "D": T.DateType()}.get(letter, T.StringType())


def _value(raw: bytes, kind: T.DataType, encoding: str):
    text = raw.decode(encoding, "replace").strip(" \0")
    if isinstance(kind, T.StringType):
        return text or None
    try:
        if isinstance(kind, T.BooleanType):
            return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper())
        if isinstance(kind, T.DateType):
            return datetime.datetime.strptime(text, "%Y%m%d").date()
        return int(text) if isinstance(kind, T.LongType) else float(text)
    except ValueError:
        return None


def _polygon(rings: list[np.ndarray]) -> K.Geometry:
    """Clockwise rings are shells; a hole goes to a shell that holds it."""
    shells = [r for r in rings if K.ring_area(r) < 0] or rings
    holes = [r for r in rings if not any(r is s for s in shells)]
    parts = [[s] for s in shells]
    for h in holes:
        home = parts[0] if len(parts) == 1 else next((p for p in parts if K.contains([[p[0]]], h[:1])[0]), None)
        if home is None:
            parts.append([h])
        else:
            home.append(h)
    return parts


def _shape(record: memoryview) -> K.Geometry | None:
    kind = struct.unpack_from("<i", record)[0] % 10
    if kind == 0:
        return None
    if kind == POINT:
        return [[np.frombuffer(record, "<f8", 2, 4).reshape(1, 2)]]
    if kind == MULTIPOINT:
        n = struct.unpack_from("<i", record, 36)[0]
        return [[p] for p in np.frombuffer(record, "<f8", 2 * n, 40).reshape(n, 1, 2)]
    if kind not in (POLYLINE, POLYGON):
        raise ValueError(f"shape type {kind} is not read")
    n, m = struct.unpack_from("<ii", record, 36)
    cuts = [*struct.unpack_from(f"<{n}i", record, 44), m]
    points = np.frombuffer(record, "<f8", 2 * m, 44 + 4 * n).reshape(m, 2)
    rings = [points[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    return _polygon(rings) if kind == POLYGON else [[r] for r in rings]


def _geometry_array(shapes: list):
    """Nested Arrow lists from offsets, without an object a vertex."""
    import pyarrow as pa

    rings = [r for g in shapes if g for p in g for r in p]
    points = np.concatenate([*rings, np.zeros((0, 2))])
    ends = lambda sizes: np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]).astype(np.int32)
    vertices = pa.StructArray.from_arrays([pa.array(points[:, 0]), pa.array(points[:, 1])], names=["x", "y"])
    ring = pa.ListArray.from_arrays(pa.array(ends([len(r) for r in rings])), vertices)
    part = pa.ListArray.from_arrays(pa.array(ends([len(p) for g in shapes if g for p in g])), ring)
    missing = np.array([g is None for g in shapes] + [False], bool)
    return pa.ListArray.from_arrays(pa.array(ends([len(g or ()) for g in shapes]), mask=missing), part)


def read_shapefile(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """The fields of the .dbf and ``geom``; ``path`` is a .shp or a folder."""
    stem = F.regexp_replace("path", r"(?i)\.(shp|dbf)$", "")
    shp = read_files(spark, path, "shp").select(stem.alias("stem"), F.col("content").alias("shp"))
    one = path.lower().endswith(".shp")
    table = f"{path[:-4]}{'.DBF' if path.endswith('SHP') else '.dbf'}" if one else path
    dbf = read_files(spark, table, "dbf").select("path", stem.alias("stem"), F.col("content").alias("dbf"))
    first = dbf.agg(F.min("path")).first()[0]  # a scan of names only
    head = dbf.where(F.col("path") == first).select(F.substring("dbf", 1, 65535)).first() if first else None
    schema = T.StructType([T.StructField(n, _type(k, w, d)) for n, k, w, d in (_fields(bytes(head[0])) if head else [])])
    schema.add("geom", GEOMETRY_TYPE)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)

        def batch_of(shapes, values):
            columns = [pa.array(v, target.field(i).type) for i, v in enumerate(values)]
            return pa.RecordBatch.from_arrays([*columns, _geometry_array(shapes).cast(target.field("geom").type)], schema=target)

        for batch in batches:
            for r in batch.to_pylist():
                data, rows = memoryview(r["shp"]), r["dbf"]
                own, width, start, n = {}, 0, 0, None
                if rows:
                    n, start, width = struct.unpack_from("<IHH", rows, 4)
                    at = 1
                    for name, _, w, _ in _fields(rows):
                        own[name], at = (at, w), at + w
                shapes, values, at, k = [], [[] for _ in schema.names[:-1]], 100, 0
                while at + 8 <= len(data):
                    size = 2 * struct.unpack_from(">i", data, at + 4)[0]
                    record, row = data[at + 8 : at + 8 + size], start + k * width
                    at, k = at + 8 + size, k + 1
                    if n is not None and k <= n and rows[row : row + 1] == b"*":
                        continue
                    shapes.append(_shape(record))
                    for field, v in zip(schema.fields, values):
                        a, w = own.get(field.name, (0, 0))
                        v.append(_value(rows[row + a : row + a + w], field.dataType, encoding) if w and k <= n else None)
                    if len(shapes) == BATCH:
                        yield batch_of(shapes, values)
                        shapes, values = [], [[] for _ in values]
                if shapes:
                    yield batch_of(shapes, values)

    return shp.join(dbf.select("stem", "dbf"), "stem", "left").select("shp", "dbf").mapInArrow(run, schema)


def _kind(geom: K.Geometry) -> int:
    if K.is_polygon(geom):
        return POLYGON
    rings = [r for p in geom for r in p]
    if all(len(r) == 1 for r in rings):
        return POINT if len(rings) == 1 else MULTIPOINT
    return POLYLINE


def _content(geom: K.Geometry, kind: int) -> bytes:
    rings = [r for p in geom for r in p]
    if kind == POLYGON:  # shells run clockwise, holes the other way
        rings = [r if (K.ring_area(r) < 0) == (i == 0) else r[::-1] for p in geom for i, r in enumerate(p)]
    points = np.concatenate(rings).astype("<f8")
    if kind == POINT:
        return struct.pack("<i", kind) + points.tobytes()
    box = np.concatenate([points.min(axis=0), points.max(axis=0)]).astype("<f8").tobytes()
    if kind == MULTIPOINT:
        return struct.pack("<i", kind) + box + struct.pack("<i", len(points)) + points.tobytes()
    starts = np.cumsum([0, *map(len, rings[:-1])]).astype("<i4")
    return struct.pack("<i", kind) + box + struct.pack("<ii", len(rings), len(points)) + starts.tobytes() + points.tobytes()


def _layout(schema: T.StructType) -> list[tuple[str, str, int, int]]:
    """Fields of the .dbf: names of at most ten characters, made distinct by a number."""
    out, taken = [], set()
    for f in schema.fields:
        name, k = f.name[:10], 0
        while name.upper() in taken:
            k += 1
            name = f"{f.name[: 10 - len(str(k))]}{k}"
        taken.add(name.upper())
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            out.append((name, "N", 11, 0))
        elif isinstance(f.dataType, T.LongType):
            out.append((name, "N", 18, 0))
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            out.append((name, "N", 24, 15))
        elif isinstance(f.dataType, T.BooleanType):
            out.append((name, "L", 1, 0))
        else:
            out.append((name, "D", 8, 0) if isinstance(f.dataType, T.DateType) else (name, "C", 254, 0))
    return out


def _cell(v, letter: str, width: int) -> bytes:
    if letter == "C":
        raw = ("" if v is None else str(v)).encode()[:width]
        return raw.decode("utf-8", "ignore").encode().ljust(width)  # no character is cut in two
    if v is None:
        return (b"?" if letter == "L" else b"").ljust(width)
    if letter == "L":
        return b"T" if v else b"F"
    if letter == "D":
        return v.strftime("%Y%m%d").encode()
    raw = (str(v) if isinstance(v, int) else repr(float(v))).encode().rjust(width)
    if len(raw) > width:
        raise ValueError(f"{v} does not fit a field of {width} characters")
    return raw


class _Writer:
    def __init__(self, kind: int, fields):
        self.kind, self.fields = kind, fields
        self.shp, self.shx, self.dbf, self.n = io.BytesIO(), io.BytesIO(), io.BytesIO(), 0
        self.low, self.high = np.full(2, np.inf), np.full(2, -np.inf)

    def add(self, geom: K.Geometry | None, values: list) -> None:
        body = struct.pack("<i", 0) if geom is None else _content(geom, self.kind)
        if geom is not None:
            low, high = K.geometry_bounds(geom)
            self.low, self.high = np.minimum(self.low, low), np.maximum(self.high, high)
        self.n += 1
        self.shx.write(struct.pack(">ii", 50 + self.shp.tell() // 2, len(body) // 2))
        self.shp.write(struct.pack(">ii", self.n, len(body) // 2) + body)
        self.dbf.write(b" " + b"".join(_cell(v, k, w) for v, (_, k, w, _) in zip(values, self.fields)))

    def _head(self, size: int) -> bytes:
        box = (*self.low, *self.high) if np.isfinite(self.low).all() else (0.0,) * 4
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, 50 + size // 2) + struct.pack("<ii8d", 1000, self.kind, *box, 0, 0, 0, 0)

    def close(self, stem: str) -> None:
        width = 1 + sum(w for _, _, w, _ in self.fields)
        head = struct.pack("<4BIHH20x", 3, 126, 1, 1, self.n, 33 + 32 * len(self.fields), width)
        names = b"".join(struct.pack("<11sc4xBB14x", n.encode("ascii", "replace"), k.encode(), w, d) for n, k, w, d in self.fields)
        write_file(f"{stem}.dbf", head, names, b"\r", self.dbf.getvalue(), b"\x1a")
        write_file(f"{stem}.cpg", b"UTF-8")
        write_file(f"{stem}.shx", self._head(self.shx.tell()), self.shx.getvalue())
        write_file(f"{stem}.shp", self._head(self.shp.tell()), self.shp.getvalue())


def write_shapefile(df: DataFrame, path: str, geom: str = "geom") -> int:
    """Write all rows under the folder ``path``, which must hold no shapefile yet; the number of rows.

    Text beyond 254 bytes is cut, as the format asks; other types than numbers, booleans and dates are
    written as text.
    """
    own = [c for c in df.columns if c != geom]
    schema = df.select(*own).schema
    fields = _layout(schema) or [("id", "N", 11, 0)]

    def run(batches):
        import pyarrow as pa

        pid, open_, files, kind, rows = TaskContext.get().partitionId(), {}, 0, POINT, 0
        for batch in batches:
            for r in batch.to_pylist():
                g = K.to_numpy(r[geom]) if r[geom] else None
                g = g if g and any(len(q) for p in g for q in p) else None
                kind = kind if g is None else _kind(g)
                w = open_.setdefault(kind, _Writer(kind, fields))
                w.add(g, [r[c] for c in own] or [w.n])
                rows += 1
                if w.shp.tell() + w.dbf.tell() > FILE_BYTES:
                    open_.pop(kind).close(f"{path}/part-{pid:05d}-{files:04d}")
                    files += 1
        for w in open_.values():
            w.close(f"{path}/part-{pid:05d}-{files:04d}")
            files += 1
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["n"])

    return df.select(*own, geom).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
