"""Removal of lines that many sites share, with DataFrame functions only.

Every line hash gets a HyperLogLog sketch of the sites it occurs on; sketches merge by aggregation
before the shuffle.  Lines whose estimate lies within ``band`` of the threshold get an exact distinct
count, the others are decided by the estimate.  The first occurrence of a boilerplate line, in the
order (doc_id, text hash, position), stays, so no content disappears from the corpus.

Defined results: null text stays null and has no lines; empty lines are never boilerplate; a null
site counts as no site; rows with equal doc_id and text are one document and are treated alike; an
empty table gives an empty result; extra columns, whatever their names, pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import materialize

#: Rows of the boilerplate table up to which it is broadcast (about 40 bytes a row).
BROADCAST_ROWS = 100_000
LG_K = 10


def _lines(docs: DataFrame, site: str) -> DataFrame:
    """One row a non-empty line: two hashes, where it is, and its site."""
    cut = docs.select(F.col("doc_id").alias("d"), F.xxhash64("text").alias("k"), F.col(site).cast("string").alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return cut.where("line <> ''").select(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("g"), "d", "k", "pos", "site")


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = 10) -> DataFrame:
    """h, g, first (doc, text hash, position) of each line on at least ``min_sites`` distinct sites."""
    band = max(1, math.ceil(4 * 1.04 / math.sqrt(1 << LG_K) * min_sites))
    lines = _lines(docs, site)
    seen = lines.groupBy("h", "g").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"), F.min(F.struct("d", "k", "pos")).alias("first"))
    rough = seen.withColumn("sites", F.hll_sketch_estimate("sketch")).where(F.col("sites") >= min_sites - band).select("h", "g", "first", "sites")
    rough = materialize(rough, "line-estimates")
    close = rough.where(F.col("sites") <= min_sites + band).select("h", "g")
    few = close.count() <= BROADCAST_ROWS
    exact = lines.select("h", "g", "site").join(F.broadcast(close) if few else close, ["h", "g"], "left_semi").distinct().groupBy("h", "g").agg(F.count("site").alias("exact"))
    return rough.join(exact, ["h", "g"], "left").where(F.coalesce("exact", "sites") >= min_sites).select("h", "g", "first")


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = 10) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, and the array ``removed_lines`` of their positions (null: none)."""
    found = materialize(boilerplate(docs, site, min_sites), "boilerplate")
    small = found.count() <= BROADCAST_ROWS
    hits = _lines(docs, site).join(F.broadcast(found) if small else found, ["h", "g"])
    hits = hits.where(~F.struct("d", "k", "pos").eqNullSafe(F.col("first")))
    cut = hits.groupBy("d", "k").agg(F.array_sort(F.collect_set("pos")).alias("removed_lines"))
    own = [c for c in docs.columns if c != "removed_lines"]
    joined = docs.select(*own).alias("a").join(cut.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.d")) & (F.xxhash64(F.col("a.text")) == F.col("b.k")), "left")
    kept = F.array_join(F.filter(F.split(F.col("a.text"), "\n"), lambda x, i: ~F.array_contains(F.col("b.removed_lines"), i)), "\n")
    text = F.when(F.col("b.removed_lines").isNull(), F.col("a.text")).otherwise(kept)
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"a.`{c}`") for c in own], F.col("b.removed_lines"))
