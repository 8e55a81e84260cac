"""Shared folder for intermediate tables.

Lineage is cut by writing a table to the folder named in ``spark.checkpoint.dir`` and reading it
back, so a lost executor never costs more than the stage it ran.  A folder of our own is used only
where the setting is absent, which is the case in local tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder seen by the driver and by every executor; only a session on one machine may go without the setting."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not jsc.isLocal():
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="geoweft-"))
        found = jsc.getCheckpointDir().get()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/geoweft/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a frame that reads it."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete a materialized table that nothing reads any more."""
    if path := getattr(df, "_stored_at", None):
        _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Delete every table this package has left in the shared folder; frames that read them end here."""
    _delete(spark, f"{shared_dir(spark)}/geoweft")
