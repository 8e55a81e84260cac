"""Uniform shuffle into shards of exact size, with DataFrame functions only.

The number of rows that go from each input partition to each shard is drawn once from the
multivariate hypergeometric law, which is the law of those counts under a uniform shuffle.  Rows are
permuted inside their partition, dealt by those counts, and permuted again inside their shard.  The
second permutation orders random 64-bit keys in sub-buckets whose bases are prefix sums, so no task
holds a shard.

Defined results: null text has size 1 and checksum 0; equal texts and repeated rows are dealt one by
one; shards differ by at most one row; an empty table gives an empty result; extra columns, whatever
their names, pass through (``shard`` and ``slot`` are replaced).
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import materialize

BUCKET_ROWS = 100_000


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n)) if n and good else 0
    # ratio of uniforms (Stadlober 1990), exact for any size
    total = good + bad
    low, m = min(good, bad), min(n, total - n)
    p, q = low / total, 1 - low / total
    mean = m * p + 0.5
    width = math.sqrt((total - m) * m * p * q / (total - 1) + 0.5)
    h = 1.7155277699214135 * width + 0.8989161620588988
    mode = (m + 1) * (low + 1) // (total + 2)
    lg = lambda k: math.lgamma(k + 1) + math.lgamma(low - k + 1) + math.lgamma(m - k + 1) + math.lgamma(total - low - m + k + 1)
    top, last = lg(mode), min(m, low)
    while True:
        u, v = rng.random(), rng.random()
        w = mean + h * (v - 0.5) / u if u else -1
        if 0 <= w < last + 1:
            k = int(w)
            if 2 * math.log(u) <= top - lg(k):
                break
    k = k if good <= bad else m - k
    return k if m == n else good - k


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Counts from each partition to each shard; row sums ``rows``, column sums equal but for one."""
    rng, total = np.random.default_rng(seed), sum(rows)
    left = [total // shards + (i < total % shards) for i in range(shards)]
    out = np.zeros((len(rows), shards), dtype=np.int64)
    for i, n in enumerate(rows):
        rest = sum(left)
        for j in range(shards):
            out[i, j] = min(n, left[j]) if rest == left[j] else _hypergeometric(rng, left[j], rest - left[j], n)
            rest -= left[j]
            n -= out[i, j]
            left[j] -= int(out[i, j])
    return out


def shuffle_into_shards(df: DataFrame, shards: int = 8, seed: int = 17) -> DataFrame:
    """``df`` with shard (int) and slot (long, gapless from 0 in each shard)."""
    spark = df.sparkSession
    own = [F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")]
    # the row travels as one column, so none of its names can clash with those used here
    body = F.struct(*own) if own else F.struct(F.lit(None).alias("nothing"))
    fixed = materialize(df.select(body.alias("body"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row")), "shuffle")
    parts = fixed.groupBy("part").count().orderBy("part").collect()  # one row an input split
    total = sum(r[1] for r in parts)
    cuts = communication_matrix([r[1] for r in parts], shards, seed).cumsum(axis=1)
    table = json.dumps([{"part": r[0], "cuts": c.tolist()} for r, c in zip(parts, cuts)])
    cuts_df = spark.range(1).select(F.inline(F.from_json(F.lit(table), "array<struct<part:int,cuts:array<bigint>>>")))
    first = Window.partitionBy("part").orderBy(F.xxhash64(F.lit(seed), F.lit(1), "row"), "row")
    dealt = fixed.withColumn("rank", F.row_number().over(first) - 1).join(cuts_df, "part")
    dealt = dealt.withColumn("shard", F.size(F.filter("cuts", lambda c: c <= F.col("rank"))))
    buckets = max(1, -(-total // (shards * BUCKET_ROWS)))
    dealt = dealt.withColumn("key", F.xxhash64(F.lit(seed), F.lit(2), "row")).withColumn("bucket", F.pmod(F.shiftrightunsigned("key", 24), F.lit(buckets)))
    dealt = materialize(dealt.select("body", "shard", "key", "bucket", "row"), "dealt")
    sizes = dealt.groupBy("shard", "bucket").count()
    base = sizes.withColumn("base", F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).drop("count")
    second = Window.partitionBy("shard", "bucket").orderBy("key", "row")
    placed = dealt.withColumn("rank", F.row_number().over(second) - 1).join(base, ["shard", "bucket"])
    return placed.select(*(["body.*"] if own else []), "shard", (F.col("base") + F.col("rank")).alias("slot"))
