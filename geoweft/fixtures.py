"""Point, zone, line and raster views derived from the driver's tables, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expr import rectangle
from .operators.raster import Meta, Raster

EXTENT = (0.0, 0.0, 1020.0, 1020.0)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _xy(k: str) -> list:
    return [((F.col(k) * 7919) % 1009).cast("double").alias("x"), ((F.col(k) * 7907) % 1013).cast("double").alias("y")]


def customers(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").alias("fid"), *_xy("c_custkey"), F.col("c_acctbal").alias("w"), F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nk"))


def suppliers(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("fid"), *_xy("s_suppkey"), F.col("s_acctbal").alias("v"), (F.abs(F.col("s_acctbal")) + 1).alias("pop"), ((F.col("s_suppkey") * 13) % 97 + 1).cast("double").alias("cas"), F.col("s_nationkey").alias("nk"))


def lineitems(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(((F.col("l_partkey") * 31 + F.col("l_linenumber")) % 1009).cast("double").alias("x"), ((F.col("l_suppkey") * 37 + F.col("l_orderkey")) % 1013).cast("double").alias("y"), F.col("l_quantity").alias("w"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("flag"))


def tracks(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("event_id").alias("fid"), "user_id", "ts", *_xy("event_id"), "value", "event_type")


def zones(spark, n: int = 10, side: float = 102.0) -> DataFrame:
    z = spark.range(n * n).select((F.col("id") + 1).alias("fid"), (F.col("id") % n).alias("c"), F.floor(F.col("id") / n).alias("r"))
    z = z.withColumn("xmin", F.col("c") * side).withColumn("ymin", F.col("r") * side).withColumn("xmax", (F.col("c") + 1) * side).withColumn("ymax", (F.col("r") + 1) * side).withColumn("v", ((F.col("fid") * 37) % 101).cast("double"))
    return z.withColumn("geom", rectangle(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")))


def lines(spark, d) -> DataFrame:
    """A segment from each supplier 50 to the right and fid mod 40 up."""
    s = suppliers(spark, d)
    end = F.struct((F.col("x") + 50).alias("x"), (F.col("y") + F.col("fid") % 40).alias("y"))
    return s.withColumn("geom", F.array(F.array(F.array(F.struct("x", "y"), end)))).drop("x", "y")


def raster(spark, n: int = 120, kind: str = "a") -> Raster:
    row, col = F.floor(F.col("id") / n).cast("int"), (F.col("id") % n).cast("int")
    a, b, c = {"a": (3, 7, 5), "b": (5, 2, 9)}[kind]
    cells = spark.range(n * n).select(F.lit(0).alias("band"), row.alias("row"), col.alias("col"), F.when(F.col("id") % 97 != 0, ((row * row * a + col * col * b + row * col * c) % 101).cast("double")).alias("value"))
    return Raster(cells, Meta(n, n, 0.0, 0.0, 10.0, 10.0))


CUSTOMERS = "(SELECT c_custkey AS fid, ((c_custkey * 7919) % 1009)::double AS x, ((c_custkey * 7907) % 1013)::double AS y, c_acctbal AS w, c_mktsegment AS seg, c_nationkey AS nk FROM customer)"
SUPPLIERS = "(SELECT s_suppkey AS fid, ((s_suppkey * 7919) % 1009)::double AS x, ((s_suppkey * 7907) % 1013)::double AS y, s_acctbal AS v, abs(s_acctbal) + 1 AS pop, ((s_suppkey * 13) % 97 + 1)::double AS cas, s_nationkey AS nk FROM supplier)"
LINEITEMS = "(SELECT ((l_partkey * 31 + l_linenumber) % 1009)::double AS x, ((l_suppkey * 37 + l_orderkey) % 1013)::double AS y, l_quantity AS w, l_extendedprice AS price, l_returnflag AS flag FROM lineitem)"
TRACKS = "(SELECT event_id AS fid, user_id, ts, ((event_id * 7919) % 1009)::double AS x, ((event_id * 7907) % 1013)::double AS y, value, event_type FROM events)"
ZONES = "(SELECT i + 1 AS fid, i % 10 AS c, i // 10 AS r, (i % 10) * 102.0::double AS xmin, (i // 10) * 102.0::double AS ymin, (i % 10 + 1) * 102.0::double AS xmax, (i // 10 + 1) * 102.0::double AS ymax, (((i + 1) * 37) % 101)::double AS v FROM range(100) t(i))"


def raster_sql(kind: str = "a", n: int = 120) -> str:
    a, b, c = {"a": (3, 7, 5), "b": (5, 2, 9)}[kind]
    return f"(SELECT (i // {n})::int AS row, (i % {n})::int AS col, CASE WHEN i % 97 <> 0 THEN (((i // {n}) * (i // {n}) * {a} + (i % {n}) * (i % {n}) * {b} + (i // {n}) * (i % {n}) * {c}) % 101)::double END AS value FROM range({n * n}) t(i))"
