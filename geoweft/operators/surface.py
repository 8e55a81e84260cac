"""Density, interpolation and distance surfaces."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import cells as C
from ..plans import dense
from .raster import Meta, Raster, at, blank, center, meta_for

#: Sample points up to which a spline's dense matrix is solved; more take steps.
MAX_SPLINE_POINTS = 4000
#: Of the solution by steps: near samples of a Lagrange function, samples solved for exactly, steps, and the largest error in parts of the largest value.
NEAR, COARSE, MAX_SPLINE_STEPS, SPLINE_ERROR = 40, 500, 100, 1e-10


def _meta(points: DataFrame, cell: float, extent) -> Meta:
    if extent is None:
        e = C.extent(points)
        extent = (e.xmin, e.ymin, e.xmax, e.ymax)
    return meta_for(extent, cell)


def kernel(kind: str, radius: int) -> list[tuple[int, int, float]]:
    """(dcol, drow, weight) of the cells within ``radius`` cells."""
    out = []
    for dy in range(-radius, radius + 1):
        for dx in range(-radius, radius + 1):
            d2 = dx * dx + dy * dy
            if d2 > radius * radius:
                continue
            d = math.sqrt(d2)
            u = d / radius if radius else 0.0
            # The kernel functions.
            v = {
                "Binary": 1.0,
                "Cosine": math.pi / 4 * math.cos(math.pi * u / 2),
                "Distance": d,
                "Epanechnikov": 3 * (1 - u * u) / 4,
                "Gaussian": math.exp(-0.5 * u * u) / math.sqrt(2 * math.pi),
                "InverseDistance": 0.0 if d == 0 else 1 / d,
                "Quadratic": 3 * (1 - u * u) ** 2,
                "Quartic": 15 / 16 * (1 - u * u) ** 2,
                "Triangular": 1 - u,
                "Triweight": 35 / 32 * (1 - u * u) ** 3,
                "Tricube": 70 / 81 * (1 - u**3) ** 3,
            }[kind]
            if v > 0:
                out.append((dx, dy, v))
    return out


def _spread(points: DataFrame, meta: Meta, weights: list[tuple[int, int, float]], scale: float) -> Raster:
    """Sum of weight x kernel about each point's cell; points are summed a cell before they spread."""
    c, r = at(meta, F.col("x"), F.col("y"))
    own = points.select(c.cast("int").alias("c"), r.cast("int").alias("r"), "w").groupBy("c", "r").agg(F.sum("w").alias("w"))
    offsets = F.array(*[F.struct(F.lit(a).alias("dc"), F.lit(b).alias("dr"), F.lit(v).alias("k")) for a, b, v in weights]) if len(weights) <= 200 else None
    spark = points.sparkSession
    if offsets is not None:
        d = own.withColumn("o", F.explode(offsets)).select((F.col("c") + F.col("o.dc")).alias("col"), (F.col("r") + F.col("o.dr")).alias("row"), (F.col("w") * F.col("o.k")).alias("v"))
    else:
        k = spark.createDataFrame(weights, "dc int, dr int, k double")
        d = own.crossJoin(F.broadcast(k)).select((F.col("c") + F.col("dc")).alias("col"), (F.col("r") + F.col("dr")).alias("row"), (F.col("w") * F.col("k")).alias("v"))
    d = d.where(F.col("col").between(0, meta.ncols - 1) & F.col("row").between(0, meta.nrows - 1)).groupBy("row", "col").agg((F.sum("v") / scale).alias("value"))
    full = blank(spark, meta).join(d, ["row", "col"], "left").na.fill(0.0, ["value"])
    return Raster(full.select("band", "row", "col", "value"), meta)


def _points(df: DataFrame, field: str | None) -> DataFrame:
    w = F.expr(field).cast("double") if field else F.lit(1.0)
    return df.select(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), w.alias("w")).where("w is not null")


def kernel_density(df: DataFrame, kind: str = "Quadratic", population: str | None = None, radius: float = 0.0, cell: float = 0.0, extent=None, projected: bool = True) -> Raster:
    meta = _meta(df, cell, extent)
    radius = radius or min(meta.ncols * meta.dx, meta.nrows * meta.dy) / 30
    k = kernel(kind, int(radius // max(meta.dx, meta.dy)))
    scale = len(k) * meta.dx * meta.dy / (1e6 if projected else 1.0)
    return _spread(_points(df, population), meta, k, scale)


def point_density(df: DataFrame, population: str | None = None, neighborhood: tuple = ("circle", 5), cell: float = 0.0, extent=None, projected: bool = True) -> Raster:
    """Sum over a circle (radius in cells) or a rectangle (width, height in cells) by its area."""
    meta = _meta(df, cell, extent)
    if neighborhood[0] == "circle":
        k = kernel("Binary", int(neighborhood[1]))
    else:
        w, h = int(neighborhood[1]), int(neighborhood[2])
        k = [(i - w // 2, j - h // 2, 1.0) for i in range(w) for j in range(h)]
    return _spread(_points(df, population), meta, k, len(k) * meta.dx * meta.dy / (1e6 if projected else 1.0))


def line_density(lines: DataFrame, population: str | None = None, radius: float = 0.0, cell: float = 0.0, extent=None, projected: bool = True) -> Raster:
    """Cells on lines, weighted, convolved with a disc of elements cell size by the disc's area; a null weight skips the line."""
    from ..functions.expr import bounds, pairs

    if extent is None:
        b = lines.select(*[c.alias(n) for n, c in bounds(F.col("geom")).items()]).agg(F.min("xmin"), F.min("ymin"), F.max("xmax"), F.max("ymax")).first()
        extent = tuple(b)
    meta = meta_for(extent, cell)
    radius = radius or min(meta.ncols * meta.dx, meta.nrows * meta.dy) / 30
    n = int(radius // max(meta.dx, meta.dy))
    k = [(a, b, float(meta.dx)) for a, b, _ in kernel("Binary", n)]
    seg = lines.select((F.expr(population).cast("double") if population else F.lit(1.0)).alias("w"), F.monotonically_increasing_id().alias("l"), F.explode(F.flatten("geom")).alias("p")).where("w is not null")
    seg = seg.select("w", "l", F.explode(pairs(F.col("p"))).alias("e"))
    steps = F.ceil(F.hypot(F.col("e.b.x") - F.col("e.a.x"), F.col("e.b.y") - F.col("e.a.y")) / (min(meta.dx, meta.dy) / 2)).cast("int")
    seg = seg.withColumn("n", F.greatest(steps, F.lit(1))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n"))))
    pts = seg.select("w", "l", (F.col("e.a.x") + (F.col("e.b.x") - F.col("e.a.x")) * F.col("i") / F.col("n")).alias("x"), (F.col("e.a.y") + (F.col("e.b.y") - F.col("e.a.y")) * F.col("i") / F.col("n")).alias("y"))
    c, r = at(meta, F.col("x"), F.col("y"))
    once = pts.withColumn("c", c).withColumn("r", r).groupBy("l", "c", "r").agg(F.first("w").alias("w"), F.min("x").alias("x"), F.min("y").alias("y"))
    cx, cy = center(meta, "c", "r")
    once = once.select("w", cx.alias("x"), cy.alias("y"))
    return _spread(once, meta, k, math.pi * radius * radius / (1000.0 if projected else 1.0))


def _cells_xy(spark, meta: Meta) -> DataFrame:
    x, y = center(meta)
    return blank(spark, meta).select((F.col("row").cast("long") * meta.ncols + F.col("col")).alias("id"), "row", "col", x.alias("x"), y.alias("y"))


def euclidean_distance(df: DataFrame, maximum: float | None = None, cell: float = 0.0, extent=None) -> Raster:
    """Exact distance of each cell centre to the nearest source point."""
    meta = _meta(df, cell, extent)
    g = _cells_xy(df.sparkSession, meta)
    src = df.select(F.col("x").cast("double").alias("x2"), F.col("y").cast("double").alias("y2")).distinct().withColumn("id2", F.xxhash64("x2", "y2"))
    near = C.nearest(g.select("id", "x", "y"), src, 1, "id", "id2", within=maximum)
    d = g.join(near.select("id", F.col("d").alias("value")), "id", "left")
    return Raster(d.select(F.lit(0).alias("band"), "row", "col", "value"), meta)


def idw(df: DataFrame, field: str, power: float = 2.0, radius_type: str = "Variable", points: int = 12, distance: float = 0.0, cell: float = 0.0, extent=None) -> Raster:
    """Inverse distance weighting; a cell on a sample takes its value, equal distances are separate samples."""
    meta = _meta(df, cell, extent)
    g = _cells_xy(df.sparkSession, meta)
    s = df.select(F.col("x").cast("double").alias("x2"), F.col("y").cast("double").alias("y2"), F.expr(field).cast("double").alias("z")).where("z is not null")
    s = s.groupBy("x2", "y2").agg(F.avg("z").alias("z")).withColumn("id2", F.xxhash64("x2", "y2"))
    if radius_type == "Fixed":
        near = C.point_pairs(g.select("id", "x", "y"), s.select("id2", "x2", "y2"), distance).select("id", "id2", "d")
    else:
        near = C.nearest(g.select("id", "x", "y"), s.select("id2", "x2", "y2"), points, "id", "id2", within=distance or None)
    near = near.join(s.select("id2", "z"), "id2")
    w = F.when(F.col("d") > 0, 1 / F.pow("d", F.lit(power)))
    v = near.groupBy("id").agg(F.avg(F.when(F.col("d") == 0, F.col("z"))).alias("here"), (F.sum(w * F.col("z")) / F.sum(w)).alias("far"))
    d = g.join(v, "id", "left").select(F.lit(0).alias("band"), "row", "col", F.coalesce("here", "far").alias("value"))
    return Raster(d, meta)


def _basis(x, y, px, py) -> np.ndarray:
    q2 = (x[:, None] - px) ** 2 + (y[:, None] - py) ** 2
    return 0.5 * q2 * np.log(np.where(q2 > 0, q2, 1))


def _dense_spline(p: np.ndarray) -> np.ndarray:
    """Weights of the samples (x, y, z), and the three terms of the plane."""
    n = len(p)
    m = np.zeros((n + 3, n + 3))
    for a in range(0, n, 500):
        m[a : min(a + 500, n), :n] = _basis(p[a : a + 500, 0], p[a : a + 500, 1], p[:, 0], p[:, 1])
    m[:n, n], m[:n, n + 1 :], m[n, :n], m[n + 1 :, :n] = 1, p[:, :2], 1, p[:, :2].T
    right = np.concatenate([p[:, 2], [0, 0, 0]])
    try:
        return np.linalg.solve(m, right)
    except np.linalg.LinAlgError:  # fewer than three points, or all on a line
        return np.linalg.lstsq(m, right, rcond=None)[0]


def _large_spline(spark, p: np.ndarray) -> np.ndarray:
    """The same weights by conjugate gradients, without the matrix: each step multiplies by it in blocks, in tasks.

    Preconditioned by approximate Lagrange functions (Faul, Goodsell and Powell 2005): in a random order each sample has a spline that
    is 1 there and 0 at its ``NEAR`` nearest later ones; the last ``COARSE`` are solved for exactly.  Samples of a plane take no step.
    """
    n, order = len(p), np.random.default_rng(0).permutation(len(p))
    p = p[order]
    plane = np.column_stack([np.ones(n), p[:, :2]])
    size = max(float(np.abs(p[:, 2]).max()), 1e-300)
    fit = lambda v: np.linalg.lstsq(plane, v, rcond=None)[0]
    c = fit(p[:, 2])
    rest, w, xy, first = p[:, 2] - plane @ c, np.zeros(n), np.ascontiguousarray(p[:, :2]), n - COARSE
    if np.abs(rest).max() > SPLINE_ERROR * size:
        tasks = max(1, n * n // dense.PAIRS)

        def mapped(block, width, data=None):
            """block(rows) for all rows, in tasks, as an array of ``width`` columns."""
            sent = spark.sparkContext.broadcast((xy, data))

            def run(batches):
                for pdf in batches:
                    for at in range(0, len(pdf), 64):
                        i = pdf["id"].to_numpy()[at : at + 64]
                        yield pd.DataFrame({"id": i, "v": list(block(i, *sent.value))})

            got = spark.range(0, n, 1, tasks).mapInPandas(run, "id long, v array<double>").toPandas()
            sent.unpersist()
            out = np.empty((n, width))
            out[got["id"].to_numpy()] = np.stack(got["v"].to_numpy())
            return out

        def times(i, xy, v):
            out = np.zeros(len(i))
            for a in range(0, len(xy), 4096):
                out += _basis(xy[i, 0], xy[i, 1], *xy[a : a + 4096].T) @ v[a : a + 4096]
            return out[:, None]

        def lagrange(i, xy, _):
            """Numbers of the samples near each, itself first, and its function's weights on them."""
            out = np.zeros((len(i), 2 * (NEAR + 1)))
            for row, k in enumerate(i):
                if k < first:
                    d = np.hypot(*(xy[k + 1 :] - xy[k]).T)
                    near = np.concatenate([[k], k + 1 + np.argpartition(d, NEAR)[:NEAR]])
                    u = (xy[near] - xy[k]) / max(d[near[1:] - k - 1].max(), 1e-300)  # weights of a spline with such conditions only scale
                    zeta = _dense_spline(np.column_stack([u, np.arange(NEAR + 1) == 0]))[: NEAR + 1]
                    out[row] = np.concatenate([near, zeta])
            return out

        made = mapped(lagrange, 2 * (NEAR + 1))[:first]
        near, zeta = made[:, : NEAR + 1].astype(int), made[:, NEAR + 1 :]
        keep = zeta[:, 0] > 0  # not where all of them are on a line
        near, zeta = near[keep], zeta[keep] / np.sqrt(zeta[keep, :1])

        def better(r):
            z = np.zeros(n)
            np.add.at(z, near, zeta * (zeta * r[near]).sum(axis=1, keepdims=True))
            z[first:] += _dense_spline(np.column_stack([xy[first:], r[first:]]))[:-3]
            return z - plane @ fit(z)  # the weights stay at right angles to planes

        r, d, before = rest, None, 1.0
        for step in range(MAX_SPLINE_STEPS):
            z = better(r)
            now = float(r @ z)
            d = z if d is None else z + now / before * d
            image, before = mapped(times, 1, d)[:, 0], now
            alpha = now / float(d @ image)
            w, r = w + alpha * d, r - alpha * image
            off = r - plane @ fit(r)
            if np.abs(off).max() <= SPLINE_ERROR * size:
                break
        else:
            raise ValueError(f"the spline of {n} samples is off by {np.abs(off).max():.3g} after {MAX_SPLINE_STEPS} steps")
        c = c + fit(r)
    out = np.empty(n)
    out[order] = w
    return np.concatenate([out, c])


def thin_plate_spline(df: DataFrame, field: str, cell: float = 0.0, extent=None) -> Raster:
    """Solved on the samples, by a dense matrix up to MAX_SPLINE_POINTS and by steps beyond, evaluated cell by cell in vectorised batches."""
    meta = _meta(df, cell, extent)
    s = df.select("x", "y", F.expr(field).cast("double").alias("z")).where("z is not null").groupBy("x", "y").agg(F.avg("z").alias("z"))
    p = s.toPandas().to_numpy(float)
    n = len(p)
    low, span = p[:, :2].min(axis=0), max(float(np.ptp(p[:, :2], axis=0).max()), 1e-12)
    p[:, :2] = (p[:, :2] - low) / span  # the spline does not depend on scale; the solve does
    w = _dense_spline(p) if n <= MAX_SPLINE_POINTS else _large_spline(df.sparkSession, p)
    sent = df.sparkSession.sparkContext.broadcast((p, w))

    @F.pandas_udf("double")
    def value(x: pd.Series, y: pd.Series) -> pd.Series:
        p, w = sent.value
        out = np.empty(len(x))
        X, Y = (x.to_numpy() - low[0]) / span, (y.to_numpy() - low[1]) / span
        rows = max(1, min(2000, 8_000_000 // n))
        for a in range(0, len(X), rows):
            u, v = X[a : a + rows], Y[a : a + rows]
            out[a : a + rows] = _basis(u, v, p[:, 0], p[:, 1]) @ w[:n] + w[n] + w[n + 1] * u + w[n + 2] * v
        return pd.Series(out)

    g = _cells_xy(df.sparkSession, meta)
    return Raster(g.select(F.lit(0).alias("band"), "row", "col", value("x", "y").alias("value")), meta)


def tin(df: DataFrame, field: str, cell: float = 0.0, extent=None) -> Raster:
    """Delaunay triangles joined to the cells whose centres they hold, with barycentric values."""
    from .construct import delaunay

    meta = _meta(df, cell, extent)
    p = df.select("x", "y", F.expr(field).cast("double").alias("z")).where("z is not null").groupBy("x", "y").agg(F.avg("z").alias("z")).withColumn("fid", F.xxhash64("x", "y"))
    t = delaunay(p.select("fid", "x", "y")).withColumn("tid", F.monotonically_increasing_id())
    for k in range(3):
        t = t.join(p.select(F.col("fid").alias(f"node{k}"), F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"), F.col("z").alias(f"z{k}")), f"node{k}")
    box = t.select("tid", *[f"{a}{k}" for a in "xyz" for k in range(3)], F.least("x0", "x1", "x2").alias("xmin"), F.least("y0", "y1", "y2").alias("ymin"), F.greatest("x0", "x1", "x2").alias("xmax"), F.greatest("y0", "y1", "y2").alias("ymax"))
    size = box.agg(F.avg(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")))).first()[0] or 1.0
    hit = C.box_points(box, _cells_xy(df.sparkSession, meta), size)
    det = (F.col("y1") - F.col("y2")) * (F.col("x0") - F.col("x2")) + (F.col("x2") - F.col("x1")) * (F.col("y0") - F.col("y2"))
    a = ((F.col("y1") - F.col("y2")) * (F.col("x") - F.col("x2")) + (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y2"))) / det
    b = ((F.col("y2") - F.col("y0")) * (F.col("x") - F.col("x2")) + (F.col("x0") - F.col("x2")) * (F.col("y") - F.col("y2"))) / det
    hit = hit.withColumn("a", a).withColumn("b", b).withColumn("c", 1 - F.col("a") - F.col("b")).where("a >= -1e-9 and b >= -1e-9 and c >= -1e-9")
    v = hit.groupBy("row", "col").agg(F.min_by(F.col("a") * F.col("z0") + F.col("b") * F.col("z1") + F.col("c") * F.col("z2"), "tid").alias("value"))
    d = blank(df.sparkSession, meta).join(v, ["row", "col"], "left")
    return Raster(d.select("band", "row", "col", "value"), meta)
