"""Binning of a stream of points in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_binning(stream: DataFrame, width: float, height: float, origin: tuple[float, float] = (0.0, 0.0), time: str = "ts", window: str = "1 day", delay: str = "1 hour", weight: str | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """Sum of weight a cell and window; rows later than ``delay`` are left out.  Works on batches too."""
    w = F.expr(weight).cast("double") if weight else F.lit(1.0)
    d = stream.withColumn(time, F.col(time).cast("timestamp")).withColumn("_w", w).where("_w is not null")
    if stream.isStreaming:
        d = d.withWatermark(time, delay)
    col, row = F.floor((F.col(x) - origin[0]) / width).alias("col"), F.floor((F.col(y) - origin[1]) / height).alias("row")
    return d.groupBy(F.window(time, window).alias("w"), col, row).agg(F.sum("_w").alias("val"), F.count("*").alias("count")).select(F.col("w.start").alias("start"), "col", "row", "val", "count")
