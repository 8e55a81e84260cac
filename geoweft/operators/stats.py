"""Descriptive statistics, correlation, regression, point patterns and clusters."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import circle, finite, zprob
from ..plans import cells
from ..plans import weights as W


def _number(name: str) -> Column:
    c = F.expr(name).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def statistics(df: DataFrame, fields: list[str], case: str | None = None) -> DataFrame:
    """One row a field (and case value, null as "Null"): count, invalid, sum, min, max, mean, population variance and deviation, CV, range."""
    d = df.select(F.coalesce(F.col(case).cast("string"), F.lit("Null")).alias("case") if case else F.lit("ALL").alias("case"), *[_number(f).alias(f) for f in fields])
    long = d.select("case", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields])).alias("e")).select("case", "e.field", "e.v")
    s = long.groupBy("case", "field").agg(F.count("v").alias("count"), F.sum(F.expr("int(v is null)")).alias("invalid"), F.sum("v").alias("sum"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.var_pop("v").alias("variance"), F.stddev_pop("v").alias("std_dev"))
    return s.withColumn("range", F.col("max") - F.col("min")).withColumn("cv", F.when(F.col("mean") != 0, F.col("std_dev") / F.col("mean")).otherwise(0.0))


def histogram(df: DataFrame, field: str) -> DataFrame:
    return df.select(_number(field).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("frequency"))


def pearson(df: DataFrame, fields: list[str]) -> DataFrame:
    """Pairwise correlation in one pass; a pair drops rows where either is missing, degenerate pairs give 0."""
    d = df.select(*[_number(f).alias(f) for f in fields])
    aggs = [F.corr(F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))).alias(f"c_{i}_{j}") for i, a in enumerate(fields) for j, b in enumerate(fields) if i <= j]
    row = d.agg(*aggs)
    cells_ = [F.struct(F.lit(a).alias("field_a"), F.lit(b).alias("field_b"), finite(F.col(f"c_{min(i, j)}_{max(i, j)}")).alias("r")) for i, a in enumerate(fields) for j, b in enumerate(fields)]
    return row.select(F.inline(F.array(*cells_)))


def f_tail(f: float, df1: float, df2: float) -> float:
    """Upper tail of the F distribution by the regularized incomplete beta function."""
    return _betainc(df2 / 2, df1 / 2, df2 / (df2 + df1 * f)) if f > 0 else 1.0


def t_tail(t: float, df: float) -> float:
    """Two-sided tail of Student's t."""
    return _betainc(df / 2, 0.5, df / (df + t * t))


def _betainc(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _betainc(b, a, 1 - x)
    c, d = 1.0, 1 / max(1e-300, abs(1 - (a + b) * x / (a + 1))) * math.copysign(1, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d)
            c = 1 + num / c
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * h / a


def ols(df: DataFrame, dependent: str, explanatory: list[str]) -> dict[str, DataFrame]:
    """report (one row a coefficient, with model figures) and features (Estimated, Residual, StdResid)."""
    names = ["Intercept", *explanatory]
    d = df.withColumn("_y", _number(dependent))
    for i, e in enumerate(explanatory):
        d = d.withColumn(f"_x{i + 1}", _number(e))
    known = d.where(" and ".join(["_y is not null", *[f"_x{i + 1} is not null" for i in range(len(explanatory))]]))
    k = len(names)
    means = known.agg(F.count("*"), F.avg("_y"), *[F.avg(f"_x{i}") for i in range(1, k)]).first()  # centred sums keep the Gram matrix well conditioned
    n, center = means[0], [0.0, *means[2:]]
    z = [F.lit(1.0), *[F.col(f"_x{i}") - F.lit(center[i]) for i in range(1, k)]]
    yc = F.col("_y") - F.lit(means[1])
    sums = known.agg(*[F.sum(z[i] * z[j]) for i in range(k) for j in range(i, k)], *[F.sum(z[i] * yc) for i in range(k)], F.sum(yc * yc)).first()
    gram, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            gram[i, j] = gram[j, i] = sums[at]
            at += 1
    xty, tss = np.array(sums[at : at + k]), sums[at + k]
    inv = np.linalg.inv(gram)
    b = inv @ xty
    rss = max(0.0, tss - b @ xty)
    df2 = n - k
    s2 = rss / df2
    cov = inv * s2
    shift = np.eye(k)
    shift[0, 1:] = [-c for c in center[1:]]
    beta, cov = shift @ b, shift @ cov @ shift.T
    beta[0] += means[1]
    r2 = 1 - rss / tss if tss else 0.0
    fv = (tss - rss) / (k - 1) / s2 if s2 > 0 else math.inf
    aic = n * (math.log(2 * math.pi) + math.log(rss / n) + 1) + 2 * (k + 1) if rss > 0 else -math.inf
    spark = df.sparkSession
    rows = []
    for i, name in enumerate(names):
        se = math.sqrt(cov[i, i])
        t = float(beta[i] / se) if se > 0 else math.inf
        rows.append((name, float(beta[i]), se, t, float(t_tail(t, df2)) if math.isfinite(t) else 0.0, int(n), float(r2), float(1 - (1 - r2) * (n - 1) / df2), float(fv), float(f_tail(fv, k - 1, df2)) if math.isfinite(fv) else 0.0, float(math.sqrt(s2)), float(aic), float(aic + 2 * (k + 1) * (k + 2) / (n - k - 2))))
    report = spark.createDataFrame(rows, "variable string, coefficient double, std_error double, t double, p double, n long, r2 double, adj_r2 double, f double, f_p double, sigma double, aic double, aicc double")
    est = F.lit(float(beta[0]))
    for i in range(1, k):
        est = est + F.lit(float(beta[i])) * F.col(f"_x{i}")
    feats = known.withColumn("Estimated", est).withColumn("Residual", F.col("_y") - F.col("Estimated")).withColumn("StdResid", F.col("Residual") / F.lit(math.sqrt(s2) or 1.0))
    return {"report": report, "features": feats.drop("_y", *[f"_x{i}" for i in range(1, k)])}


def hull_area(df: DataFrame, x="x", y="y") -> float:
    from .. import kernels

    return abs(kernels.ring_area(kernels.convex_hull(kernels.hull_candidates(df, x, y))))


def nearest_neighbor_index(df: DataFrame, method: str = "Euclidean", area: float = 0.0, fid="id", x="x", y="y") -> DataFrame:
    """Observed mean nearest-neighbour distance against 0.5 sqrt(A / n); A is the hull's area by default."""
    p = df.select(F.col(fid).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    o = p.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    area = area or hull_area(p)
    near = cells.nearest(p, o, 1, "id", "id2", exclude_self=True)
    if method != "Euclidean":
        near = near.join(p, "id").join(o, "id2").withColumn("d", W.distance(method))
    t = near.agg(F.count("*").cast("double").alias("n"), F.avg("d").alias("observed"), F.min("d").alias("nearest"), F.max("d").alias("farthest")).withColumn("area", F.lit(float(area)))
    t = t.withColumn("expected", F.when(F.col("area") > 0, 0.5 * F.sqrt(F.col("area") / F.col("n"))).otherwise(0.0)).withColumn("std_error", F.when(F.col("area") > 0, F.sqrt(((4 - math.pi) * F.col("area")) / (4 * math.pi * F.col("n") * F.col("n")))).otherwise(0.0))
    t = t.withColumn("index", F.coalesce(F.try_divide("observed", "expected"), F.lit(0.0))).withColumn("z_score", F.coalesce(F.try_divide(F.col("observed") - F.col("expected"), F.col("std_error")), F.lit(0.0)))
    return t.withColumn("p_value", zprob("z_score"))


def quadrat(df: DataFrame, cell_size: float = 0.0, x="x", y="y") -> DataFrame:
    """Counts a quadrat against the Poisson law; a point on the far edge belongs to the last cell."""
    e = cells.extent(df, x, y)
    w, h = e.xmax - e.xmin, e.ymax - e.ymin
    size = cell_size or math.sqrt(2 * (w * h / e.n))
    cols, rows = max(1, math.ceil(w / size)), max(1, math.ceil(h / size))
    k = cols * rows
    c = F.least(F.floor((F.col(x) - F.lit(e.xmin)) / size), F.lit(cols - 1))
    r = F.least(F.floor((F.col(y) - F.lit(e.ymin)) / size), F.lit(rows - 1))
    used = df.groupBy(c.alias("c"), r.alias("r")).agg(F.count("*").alias("k"))
    freq = used.groupBy("k").agg(F.count("*").alias("f"))
    filled = freq.agg(F.sum("f")).first()[0] or 0
    freq = freq.unionByName(df.sparkSession.range(1).select(F.lit(0).cast("long").alias("k"), F.lit(k - filled).cast("long").alias("f")))
    mean = e.n / k
    order = Window.orderBy("k")  # one row a distinct count
    obs = F.sum("f").over(order) / k
    upto = F.aggregate(F.sequence(F.lit(0), F.col("k").cast("int")), F.struct(F.lit(math.exp(-mean)).alias("t"), F.lit(0.0).alias("s")), lambda a, i: F.struct((a.t * F.lit(mean) / (i + 1)).alias("t"), (a.s + a.t).alias("s")))["s"]
    q = freq.withColumn("d", F.abs(obs - upto))
    return q.agg(F.lit(e.n).cast("long").alias("points"), F.lit(k).cast("long").alias("cells"), F.lit(float(size)).alias("cell_size"), F.lit(mean).alias("mean"), (F.sum(F.col("f") * F.pow(F.col("k") - mean, F.lit(2))) / k).alias("variance"), F.max("d").alias("ks"), F.lit(1.36 / math.sqrt(k)).alias("critical")).withColumn("vmr", F.col("variance") / F.col("mean"))


def k_means(df: DataFrame, target: str = "cluster", k: int = 5, as_circle: bool = False, seed: int = 1, x="x", y="y") -> DataFrame:
    """Seeded k-means; cluster numbers follow the centres from left to right."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    d = VectorAssembler(inputCols=[x, y], outputCol="_v", handleInvalid="skip").transform(df)
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c", maxIter=200).fit(d.select("_v"))
    centers = [c.tolist() for c in model.clusterCenters()]
    order = sorted(range(len(centers)), key=lambda i: centers[i])
    rank = {old: new for new, old in enumerate(order)}
    mapping = F.create_map(*[F.lit(v) for kv in rank.items() for v in kv])
    out = model.transform(d).withColumn(target, mapping[F.col("_c")])
    if not as_circle:
        return out.drop("_v", "_c")
    cx = F.create_map(*[F.lit(v) for old in order for v in (rank[old], centers[old][0])])
    cy = F.create_map(*[F.lit(v) for old in order for v in (rank[old], centers[old][1])])
    out = out.withColumn("_x", cx[F.col(target)]).withColumn("_y", cy[F.col(target)])
    g = out.groupBy(target).agg(F.first("_x").alias("x"), F.first("_y").alias("y"), F.count("*").alias("count"), F.max(F.hypot(F.col(x) - F.col("_x"), F.col(y) - F.col("_y"))).alias("radius"))
    return g.withColumn("geom", circle(F.col("x"), F.col("y"), F.col("radius")))


def fitness(expected: Column, cases: Column, threshold: float, kind: str = "Poisson") -> tuple[Column, Column]:
    """(passes, statistic): 1 - Poisson CDF of the cases at the expectation, within the threshold."""
    term = F.aggregate(F.sequence(F.lit(0), F.greatest(cases.cast("int") - 1, F.lit(0))), F.struct(F.exp(-expected).alias("t"), F.lit(0.0).alias("s")), lambda a, i: F.struct((a.t * expected / (i + 1)).alias("t"), (a.s + a.t).alias("s")))["s"]
    p = 1 - term
    worth = (expected <= cases) & (expected >= 1) & (cases >= 1) & (p <= threshold)
    stat = {"Poisson": 1 - p, "Relative": cases - expected, "RelativePercent": (cases - expected) / expected}[kind]
    return worth, stat


def _circle_counts(circles: DataFrame, points: DataFrame, size: float, names: tuple[str, str]) -> DataFrame:
    """Sums of pop and cas in each circle (cid, cx, cy, r)."""
    b = circles.select("cid", "cx", "cy", "r", (F.col("cx") - F.col("r")).alias("xmin"), (F.col("cy") - F.col("r")).alias("ymin"), (F.col("cx") + F.col("r")).alias("xmax"), (F.col("cy") + F.col("r")).alias("ymax"))
    hit = cells.box_points(b, points, size).where(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) <= F.col("r"))
    return hit.groupBy("cid").agg(F.sum("pop").alias(names[0]), F.sum("cas").alias(names[1]))


def cluster_gam(population: DataFrame, pop_field: str, cases: DataFrame, case_field: str, min_radius: float, max_radius: float, increment: float, overlap: float = 0.5, kind: str = "Poisson", threshold: float = 0.01) -> DataFrame:
    """Circles on lattices of step radius x overlap whose cases exceed expectation."""
    spark = population.sparkSession
    p = population.select("x", "y", F.coalesce(_number(pop_field), F.lit(0.0)).alias("pop"), F.lit(0.0).alias("cas")).unionByName(cases.select("x", "y", F.lit(0.0).alias("pop"), F.coalesce(_number(case_field), F.lit(0.0)).alias("cas")))
    e = p.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y"), F.sum("pop"), F.sum("cas")).first()
    found, radius = None, min_radius
    while radius <= max_radius + 1e-9:
        step = radius * overlap
        nx, ny = int((e[2] - e[0]) / step) + 1, int((e[3] - e[1]) / step) + 1
        lattice = spark.range(nx * ny).select(F.col("id").alias("cid"), (F.lit(e[0]) + (F.col("id") % nx) * step).alias("cx"), (F.lit(e[1]) + F.floor(F.col("id") / nx) * step).alias("cy"), F.lit(float(radius)).alias("r"))
        s = lattice.join(_circle_counts(lattice, p, 2 * radius, ("population", "cases")), "cid").withColumn("expected", F.col("population") * F.lit(e[5] / e[4]))
        ok, stat = fitness(F.col("expected"), F.col("cases"), threshold, kind)
        s = s.where(ok).select(F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("r").alias("radius"), "population", "cases", "expected", stat.alias("fitness"))
        found = s if found is None else found.unionByName(s)
        radius += increment
    return found.withColumn("geom", circle(F.col("x"), F.col("y"), F.col("radius")))


def besag_newell(population: DataFrame, pop_field: str, cases: DataFrame, case_field: str, neighbours: int = 10, kind: str = "Poisson", threshold: float = 0.01, fid="id") -> DataFrame:
    """Circles from each case to its k-th nearest case, with those k cases; the population field is read from the population."""
    c = cases.select(F.col(fid).alias("id"), "x", "y", F.coalesce(_number(case_field), F.lit(0.0)).alias("cas"))
    near = cells.nearest(c, c.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2")), neighbours, "id", "id2", exclude_self=True)
    near = near.join(c.select(F.col("id").alias("id2"), "cas"), "id2")
    circles = near.groupBy("id").agg(F.max("d").alias("r"), F.sum("cas").alias("cases")).where("r > 0").join(c.drop("cas"), "id")
    circles = circles.select(F.col("id").alias("cid"), F.col("x").alias("cx"), F.col("y").alias("cy"), "r", "cases")
    p = population.select("x", "y", F.coalesce(_number(pop_field), F.lit(0.0)).alias("pop"), F.lit(0.0).alias("cas")).unionByName(c.select("x", "y", F.lit(0.0).alias("pop"), "cas"))
    t = p.agg((F.sum("cas") / F.sum("pop")).alias("_rate"))
    size = circles.agg(F.max("r")).first()[0] or 1.0
    s = circles.join(_circle_counts(circles, p, size, ("population", "_all")), "cid").crossJoin(F.broadcast(t)).withColumn("expected", F.col("population") * F.col("_rate"))
    ok, stat = fitness(F.col("expected"), F.col("cases"), threshold, kind)
    return s.where(ok).select(F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("r").alias("radius"), "population", "cases", "expected", stat.alias("fitness")).withColumn("geom", circle(F.col("x"), F.col("y"), F.col("radius")))
