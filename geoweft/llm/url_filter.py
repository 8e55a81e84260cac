"""URL filters over dated lists: validity intervals and an as-of join, with DataFrame functions only.

A list entry adds or removes a pattern at a time.  The entries of a pattern, in time order, become
intervals during which the pattern is active; a capture is judged by the intervals that hold at its
fetch time.  Patterns are an exact ``host``, a ``domain`` (itself and its subdomains) or a
``prefix`` (host and leading path segments).  Case, dots after a host and slashes after a pattern are no
difference.

Captures are reduced to distinct (url, fetch time) before anything is joined, and a capture becomes
one row for each host suffix and path prefix, so the join is by equality whatever the list's size.

Defined results: a null or unparsable url, or a null fetch time, is never blocked; entries with null
fields are ignored; of entries at the same time ``remove`` wins; repeated entries and captures are
harmless; several active rules give the least (kind, pattern); an empty list blocks nothing; extra
columns pass through (``blocked``, ``rule_kind``, ``rule`` and ``rule_since`` are replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import materialize

#: Intervals (about 60 bytes each) up to which the list is broadcast.
BROADCAST_INTERVALS = 100_000
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """kind, pattern, since, until (null: still active) from entries kind, pattern, action, at."""
    known = entries.where("kind is not null and pattern is not null and action in ('add', 'remove') and at is not null")
    plain = F.regexp_replace(F.lower("pattern"), r"[./]+$", "")
    states = known.groupBy("kind", plain.alias("pattern"), "at").agg((F.max("action") == "add").alias("active"))
    order = Window.partitionBy("kind", "pattern").orderBy("at")
    changes = states.withColumn("before", F.lag("active").over(order)).where(F.col("active") != F.coalesce("before", F.lit(False)))
    return changes.withColumn("until", F.lead("at").over(order)).where("active").select("kind", "pattern", F.col("at").alias("since"), "until")


def keys(host, path):
    """Array of (kind, pattern) that can match a capture."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("pattern")))
    segments = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda s: s != "")
    below = F.when(F.size(segments) > 0, F.sequence(F.lit(1), F.size(segments))).otherwise(F.array().cast("array<int>"))
    prefixes = F.transform(below, lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.lower(F.array_join(F.slice(segments, 1, i), "/"))).alias("pattern")))
    return F.concat(F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern"))), suffixes, prefixes)


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """``captures`` with blocked, and the active rule (rule_kind, rule, rule_since) that blocks it."""
    active = materialize(intervals(entries), "intervals")
    small = active.count() <= BROADCAST_INTERVALS
    seen = captures.select(F.col(url).alias("u"), F.col(fetched).alias("t")).where("u is not null and t is not null").distinct()
    host = F.rtrim(F.lower(F.regexp_extract("u", HOST, 1)), F.lit("."))
    seen = seen.withColumn("h", host).where("h <> ''").withColumn("k", F.explode(keys(F.col("h"), F.regexp_extract("u", PATH, 1))))
    seen = seen.select("u", "t", F.col("k.kind").alias("kind"), F.col("k.pattern").alias("pattern"))
    hits = seen.join(F.broadcast(active) if small else active, ["kind", "pattern"]).where("since <= t and (until is null or t < until)")
    rules = hits.groupBy("u", "t").agg(F.min(F.struct("kind", "pattern", "since")).alias("rule_found"))
    own = [c for c in captures.columns if c not in ("blocked", "rule_kind", "rule", "rule_since")]
    out = captures.select(*own).alias("c").join(rules.alias("r"), (F.col(f"c.`{url}`") == F.col("r.u")) & (F.col(f"c.`{fetched}`") == F.col("r.t")), "left")
    found = F.col("r.rule_found")
    return out.select(*[F.col(f"c.`{c}`") for c in own], found.isNotNull().alias("blocked"), found["kind"].alias("rule_kind"), found["pattern"].alias("rule"), found["since"].alias("rule_since"))
