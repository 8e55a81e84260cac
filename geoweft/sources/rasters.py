"""Reading and writing rasters: Parquet cells with metadata, and ESRI ASCII grids."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.raster import Meta, Raster

#: Cells along a side of the tiles that a written raster is partitioned by.
TILE = 4096


def write_raster(r: Raster, path: str) -> None:
    tile = lambda c: F.floor(F.col(c) / TILE).cast("int")
    r.cells.withColumn("tile_row", tile("row")).withColumn("tile_col", tile("col")).write.mode("overwrite").partitionBy("tile_row", "tile_col").parquet(f"{path}/cells")
    r.cells.sparkSession.createDataFrame([tuple(asdict(r.meta).values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string' if isinstance(v, str) else 'double'}" for k, v in asdict(r.meta).items())).write.mode("overwrite").parquet(f"{path}/meta")


def read_raster(spark: SparkSession, path: str) -> Raster:
    meta = Meta(**spark.read.parquet(f"{path}/meta").first().asDict())
    return Raster(spark.read.parquet(f"{path}/cells").select("band", "row", "col", "value"), meta)


def read_ascii_grid(spark: SparkSession, path: str) -> Raster:
    """One grid file: six header lines, then rows of numbers from the top."""
    lines = spark.read.text(path, wholetext=False)
    head = {}
    for (t,) in lines.limit(6).collect():  # the header
        k, v = t.split()
        head[k.lower()] = float(v)
    cols, nodata = int(head["ncols"]), head.get("nodata_value", -9999.0)
    half = head["cellsize"] / 2
    x, y = head.get("xllcorner", head.get("xllcenter", 0.0) - half), head.get("yllcorner", head.get("yllcenter", 0.0) - half)
    whole = spark.read.text(path, wholetext=True).select(F.slice(F.split(F.regexp_replace("value", r"(?is)^\s*(?:[a-z_]+\s+\S+\s+)+", ""), r"\s+"), 1, cols * int(head["nrows"])).alias("v"))
    cells = whole.select(F.posexplode("v").alias("i", "v")).select(F.lit(0).alias("band"), F.floor(F.col("i") / cols).cast("int").alias("row"), (F.col("i") % cols).cast("int").alias("col"), F.col("v").cast("double").alias("value"))
    cells = cells.withColumn("value", F.when(F.col("value") != nodata, F.col("value")))
    return Raster(cells, Meta(cols, int(head["nrows"]), x, y, head["cellsize"], head["cellsize"], "", nodata))


def write_ascii_grid(r: Raster, path: str) -> None:
    """Lines in order, one a row of cells, after a header line."""
    m = r.meta
    rows = r.band().groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda c: F.coalesce(c.value, F.lit(m.nodata)).cast("string")), " ").alias("value"))
    head = f"ncols {m.ncols}\nnrows {m.nrows}\nxllcorner {m.minx}\nyllcorner {m.miny}\ncellsize {m.dx}\nNODATA_value {m.nodata}"
    first = r.cells.sparkSession.range(1).select(F.lit(-1).alias("row"), F.lit(head).alias("value"))
    first.unionByName(rows).orderBy("row").select("value").write.mode("overwrite").text(path)
