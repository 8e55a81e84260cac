"""Spatial statistics and geoprocessing as functions over Spark DataFrames."""

from __future__ import annotations

import os
import tempfile
import zipfile

_shipped: set[str] = set()

#: Session settings that bound the Arrow batches of Python workers by bytes, as texts and shapes may be long; a session's own stay.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def ship(spark) -> None:
    """Make this package importable in the Python workers of ``spark``; once an application."""
    sc = spark.sparkContext
    for key, value in BATCHES.items():
        if not spark._jsparkSession.conf().contains(key):
            spark.conf.set(key, value)
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="geoweft-"), "geoweft.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)
