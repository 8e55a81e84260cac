"""The STAT.field summary language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: str | None, order: str | None = None) -> list[Column]:
    """"SUM.pop,MEAN.x" as aggregates sum_pop, avg_x, ...; FIRST and LAST follow ``order``."""
    out = []
    for item in filter(None, (t.strip() for t in (text or "").split(","))):
        stat, _, field = item.partition(".")
        c, s = F.col(field), stat.upper()
        by = F.col(order) if order else c
        made = {
            "FIRST": lambda: F.min_by(c, by).alias(f"fst_{field}"),
            "LAST": lambda: F.max_by(c, by).alias(f"lst_{field}"),
            "SUM": lambda: F.sum(c).alias(f"sum_{field}"),
            "MEAN": lambda: F.avg(c).alias(f"avg_{field}"),
            "AVG": lambda: F.avg(c).alias(f"avg_{field}"),
            "MIN": lambda: F.min(c).alias(f"min_{field}"),
            "MAX": lambda: F.max(c).alias(f"max_{field}"),
            "RANGE": lambda: (F.max(c) - F.min(c)).alias(f"rng_{field}"),
            "STD": lambda: F.stddev_pop(c).alias(f"std_{field}"),
            "VAR": lambda: F.var_pop(c).alias(f"var_{field}"),
            "COUNT": lambda: F.count(c).alias(f"cnt_{field}"),
        }
        if s not in made:
            raise ValueError(f"unknown statistic {stat}")
        out.append(made[s]())
    return out
