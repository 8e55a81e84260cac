"""GeoTIFF: one file or a folder of tiles of one grid, read by one task a file, written a tile a task.

Read: strips and tiles, whole and floating numbers of 8 to 64 bits, either byte order and plane layout,
without compression or by Deflate or PackBits, with or without the horizontal predictor; anything else
raises.  The place comes from pixel scale and tie point, the system from the EPSG codes of the geo keys,
noData from its text tag; NaN is noData too.  Written: doubles by Deflate.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.raster import Meta, Raster
from .files import read_files, write_file

#: Cells along a side of a written tile.
TILE = 1024
#: Cells of an Arrow batch.
BATCH = 1 << 18

# Tags and field types of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, EXTRA, FORMAT = 284, 317, 322, 323, 324, 325, 338, 339
SCALE, TIE, KEYS, NODATA = 33550, 33922, 34735, 42113
GEOGRAPHIC_KEY, PROJECTED_KEY, RASTER_KEY = 2048, 3072, 1025
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}
META = "ncols int, nrows int, bands int, minx double, maxy double, dx double, dy double, crs string, nodata double"


def _tags(data: bytes) -> tuple[str, dict]:
    """Byte order and the values of the tags of the first image."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file of 32-bit offsets")
    at, out = struct.unpack_from(f"{order}I", data, 4)[0], {}
    for i in range(struct.unpack_from(f"{order}H", data, at)[0]):
        entry = at + 2 + 12 * i
        tag, kind, n = struct.unpack_from(f"{order}HHI", data, entry)
        if kind not in FIELD:
            continue
        size = struct.calcsize(FIELD[kind]) * n
        where = entry + 8 if size <= 4 else struct.unpack_from(f"{order}I", data, entry + 8)[0]
        out[tag] = data[where : where + n] if kind == 2 else struct.unpack_from(f"{order}{n}{FIELD[kind]}", data, where)
    return order, out


def _meta(tags: dict) -> tuple:
    one = lambda t, other: tags.get(t, (other,))[0]
    dx, dy = tags.get(SCALE, (1.0, 1.0))[:2]
    tie = tags.get(TIE, (0.0,) * 6)
    keys = tags.get(KEYS, ())
    found = {k: v for k, place, _, v in zip(*[iter(keys[4:])] * 4) if place == 0}
    epsg = found.get(PROJECTED_KEY) or found.get(GEOGRAPHIC_KEY)
    shift = 0.5 if found.get(RASTER_KEY) == 2 else 0.0  # the tie point is the middle of a cell
    text = tags.get(NODATA, b"").split(b"\0")[0].strip()
    left, top = tie[3] - (tie[0] + shift) * dx, tie[4] + (tie[1] + shift) * dy
    return one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), left, top, dx, dy, f"EPSG:{epsg}" if epsg and epsg != 32767 else "", float(text) if text else None


def _unpack(raw: bytes, method: int) -> bytes:
    if method == 1:
        return raw
    if method in (8, 32946):
        return zlib.decompress(raw)
    if method != 32773:
        raise ValueError(f"TIFF compression {method} is not read")
    out, at = bytearray(), 0
    while at < len(raw):
        n, at = raw[at], at + 1
        if n < 128:
            out += raw[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += raw[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def _pieces(data: bytes, order: str, tags: dict):
    """band, first row, first column and values of every strip or tile."""
    one = lambda t, other: tags.get(t, (other,))[0]
    width, height, samples, bits, kind = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1), one(FORMAT, 1)
    if bits not in (8, 16, 32, 64) or kind not in (1, 2, 3) or (kind == 3 and bits < 32) or len(set(tags.get(BITS, (bits,)))) > 1:
        raise ValueError(f"TIFF samples of {bits} bits and format {kind} are not read")
    dtype = np.dtype(f"{order}{'uif'[kind - 1]}{bits // 8}")
    tiled = TILE_OFFSETS in tags
    w, h = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(STRIP_ROWS, height), height))
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    across, down, split = math.ceil(width / w), math.ceil(height / h), one(PLANAR, 1) == 2
    predictor, inside = one(PREDICTOR, 1), 1 if split else samples
    if predictor not in (1, 2) or predictor == 2 and kind == 3:
        raise ValueError(f"TIFF predictor {predictor} is not read")
    for i, (at, size) in enumerate(zip(offsets, sizes)):
        plane, place = divmod(i, across * down)
        top, left = place // across * h, place % across * w
        rows = h if tiled else min(h, height - top)
        v = np.frombuffer(_unpack(data[at : at + size], one(COMPRESSION, 1)), dtype, rows * w * inside).reshape(rows, w, inside)
        if predictor == 2:
            v = np.cumsum(v, axis=1, dtype=dtype.newbyteorder("="))
        v = v[: height - top, : width - left].astype(float)
        for band in range(inside):
            yield plane if split else band, top, left, v[:, :, band]


def read_geotiff(spark: SparkSession, path: str) -> Raster:
    """A .tif, or a folder of them with equal cells, bands and system as one raster.

    Cells between tiles have no row; where tiles overlap both rows stay.
    """
    files = read_files(spark, path, "tif")

    def heads(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [_meta(_tags(c)[1]) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pylist([dict(zip((c.split()[0] for c in META.split(", ")), r)) for r in rows], schema=pa.schema([(n, {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}[t]) for n, t in (c.split() for c in META.split(", "))]))

    edge = files.mapInArrow(heads, META).agg(
        F.min("minx").alias("minx"), F.max("maxy").alias("maxy"), F.max(F.col("minx") + F.col("ncols") * F.col("dx")).alias("maxx"), F.min(F.col("maxy") - F.col("nrows") * F.col("dy")).alias("miny"),
        F.min("dx").alias("dx"), F.min("dy").alias("dy"), F.max("dx").alias("dx2"), F.max("dy").alias("dy2"), F.min("crs").alias("crs"), F.max("crs").alias("crs2"), F.max("nodata").alias("nodata"),
    ).first()
    if edge.minx is None:
        raise ValueError(f"no .tif file in {path}")
    if not math.isclose(edge.dx, edge.dx2, rel_tol=1e-9) or not math.isclose(edge.dy, edge.dy2, rel_tol=1e-9) or edge.crs != edge.crs2:
        raise ValueError("the files differ in cell size or system")
    dx, dy, x0, y0 = edge.dx, edge.dy, edge.minx, edge.maxy

    def cells(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(1)[i].as_py()
                order, tags = _tags(data)
                _, _, _, left, top, _, _, _, nodata = _meta(tags)
                col0, row0 = round((left - x0) / dx), round((y0 - top) / dy)
                for band, r, c, v in _pieces(data, order, tags):
                    step = max(1, BATCH // v.shape[1])
                    for s in range(0, len(v), step):
                        part = v[s : s + step]
                        row, col = np.indices(part.shape)
                        flat = part.ravel()
                        gone = np.isnan(flat) if nodata is None else np.isnan(flat) | (flat == nodata)
                        columns = [np.full(flat.size, band, np.int32), (row.ravel() + row0 + r + s).astype(np.int32), (col.ravel() + col0 + c).astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(flat, mask=gone)], names=["band", "row", "col", "value"])

    out = files.mapInArrow(cells, "band int, row int, col int, value double")
    ncols, nrows = round((edge.maxx - x0) / dx), round((y0 - edge.miny) / dy)
    return Raster(out, Meta(ncols, nrows, x0, y0 - nrows * dy, dx, dy, edge.crs, -9999.0 if edge.nodata is None else edge.nodata))


def _file(values: np.ndarray, left: float, top: float, meta: Meta) -> bytes:
    """The bytes of one tile: values by band, row and column."""
    bands, height, width = values.shape
    strips = [zlib.compress(np.ascontiguousarray(b, "<f8").tobytes()) for b in values]
    keys = [1, 1, 0, 1, RASTER_KEY, 0, 1, 1]
    if meta.crs:
        code = int(meta.crs.upper().removeprefix("EPSG:"))
        keys[3] = 3
        keys[4:4] = [1024, 0, 1, 2 if code == 4326 else 1]
        keys += [GEOGRAPHIC_KEY if code == 4326 else PROJECTED_KEY, 0, 1, code]
    text = f"{meta.nodata!r}\0".encode()
    entries = {WIDTH: ("I", [width]), HEIGHT: ("I", [height]), BITS: ("H", [64] * bands), COMPRESSION: ("H", [8]), PHOTOMETRIC: ("H", [1]), STRIP_OFFSETS: ("I", [0] * bands), SAMPLES: ("H", [bands]), STRIP_ROWS: ("I", [height]), STRIP_BYTES: ("I", [len(s) for s in strips]), PLANAR: ("H", [2 if bands > 1 else 1]), FORMAT: ("H", [3] * bands), SCALE: ("d", [meta.dx, meta.dy, 0.0]), TIE: ("d", [0.0, 0.0, 0.0, left, top, 0.0]), KEYS: ("H", keys), NODATA: ("s", [text])}
    if bands > 1:
        entries[EXTRA] = ("H", [0] * (bands - 1))
    kinds = {v: k for k, v in FIELD.items()}
    start = 8 + 2 + 12 * len(entries) + 4
    for final in (False, True):  # offsets are known once the other entries have their size
        ifd, tail = b"", b""
        for tag, (kind, v) in sorted(entries.items()):
            n = len(v[0]) if kind == "s" else len(v)
            raw = v[0] if kind == "s" else struct.pack(f"<{n}{kind}", *v)
            if len(raw) > 4:
                place, tail = struct.pack("<I", start + len(tail)), tail + raw + b"\0" * (len(raw) % 2)
            else:
                place = raw.ljust(4, b"\0")
            ifd += struct.pack("<HHI", tag, kinds[kind], n) + place
        at = start + len(tail)
        entries[STRIP_OFFSETS] = ("I", [at + sum(map(len, strips[:i])) for i in range(bands)])
    return b"II*\0" + struct.pack("<IH", 8, len(entries)) + ifd + b"\0" * 4 + tail + b"".join(strips)


def write_geotiff(r: Raster, path: str) -> int:
    """Write the raster as tiles of TILE cells a side under the folder ``path``; the number of tiles."""
    m = r.meta
    tile = lambda c: F.floor(F.col(c) / TILE).cast("int")
    bands = (r.cells.agg(F.max("band")).first()[0] or 0) + 1

    def save(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf.tile_row.iloc[0]), int(pdf.tile_col.iloc[0])
        values = np.full((bands, min(TILE, m.nrows - i * TILE), min(TILE, m.ncols - j * TILE)), m.nodata)
        known = pdf[pdf.value.notna()]
        values[known.band, known.row - i * TILE, known.col - j * TILE] = known.value
        write_file(f"{path}/tile-{i}-{j}.tif", _file(values, m.minx + j * TILE * m.dx, m.maxy - i * TILE * m.dy, m))
        return pd.DataFrame({"n": [1]})

    dealt = r.cells.withColumn("tile_row", tile("row")).withColumn("tile_col", tile("col"))
    return dealt.groupBy("tile_row", "tile_col").applyInPandas(save, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
