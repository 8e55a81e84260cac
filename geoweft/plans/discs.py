"""Unions of regular polygons of one orientation about points, by tiles: a tile finds what the others leave of its own boundaries and how its
points hang together, so that the one row of a union gathers its boundary only, and no pair of points becomes a row."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import kernels as K
from ..functions import expr as E
from .components import components
from .store import materialize

#: About how many points a tile has, how many pairs of points are looked at together, and how many groups of clumps are put together.
TILE, PAIRS, GROUPS = 1000, 500_000, 256
PIECE = "fid long, v long, ax double, ay double, bx double, by double"


def _ranges(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """low[0], low[0] + 1, ... (size[0] numbers), low[1], ..."""
    return np.arange(size.sum()) + np.repeat(low - (np.cumsum(size) - size), size)


def _near(x, y, r, own, top):
    """Blocks of pairs (own point, other point) whose circles may meet; all pairs of an own point are in one block."""
    if not len(own):
        return
    small = np.flatnonzero(r <= top)
    cx, cy = (np.floor((v - v.min()) / (2 * top * (1 + 1e-9))).astype(np.int64) + 1 for v in (x, y))
    wide = int(cx.max()) + 2
    code = cy * wide + cx
    small = small[np.argsort(code[small], kind="stable")]
    sorted_code, large = code[small], np.flatnonzero(r > top)
    at = code[own][:, None] + np.arange(-1, 2) * wide
    low, high = np.searchsorted(sorted_code, at - 1), np.searchsorted(sorted_code, at + 1, side="right")
    size = high - low
    block = (np.cumsum(size.sum(axis=1) + len(large)) - 1) // PAIRS
    for first, last in zip(np.searchsorted(block, np.unique(block)), np.searchsorted(block, np.unique(block), side="right")):
        a = np.concatenate([np.repeat(np.repeat(own[first:last], 3), size[first:last].ravel()), np.repeat(own[first:last], len(large))])
        b = np.concatenate([small[_ranges(low[first:last].ravel(), size[first:last].ravel())], np.tile(large, last - first)])
        d = np.hypot(x[a] - x[b], y[a] - y[b])
        met = (d <= r[a] + r[b]) & (a != b)
        yield a[met], b[met], d[met]


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (the least number of each one's set) after the sets of the pairs a, b are made one."""
    while True:
        u, v = root[a], root[b]
        apart = u != v
        if not apart.any():
            return root
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]


def _left(who, other, x, y, r, segments: int, eps: float):
    """What the polygons of ``other`` leave of the edges of the polygons of ``who``, pair by pair: point, edge, and the share of it from s to e.

    Pairs of a point stand together, the best first.  Where edges lie on one another, one of the same direction stays (that of the
    smaller number), and none of opposite directions.
    """
    step = 2 * math.pi / segments
    points, start, count = np.unique(who, return_index=True, return_counts=True)
    at = np.repeat(np.arange(len(points)), segments)
    edge = np.tile(np.arange(segments), len(points))
    s, e = np.zeros(len(at)), np.ones(len(at))
    sides = np.arange(segments)
    nx, ny = np.cos((sides + 0.5) * step), np.sin((sides + 0.5) * step)
    ux, uy = np.cos(sides * step), np.sin(sides * step)
    done, k = [], 0
    while len(at):
        over = count[at] <= k
        if over.any():
            done.append((points[at[over]], edge[over], s[over], e[over]))
            at, edge, s, e = at[~over], edge[~over], s[~over], e[~over]
        parts = []
        for first in range(0, len(at), 20_000):
            pick = slice(first, first + 20_000)
            i, g, s0, e0 = at[pick], edge[pick], s[pick], e[pick]
            a, b = points[i], other[start[i] + k]
            dx, dy = (x[a] - x[b])[:, None], (y[a] - y[b])[:, None]
            base = (r[b] * math.cos(step / 2))[:, None] - dx * nx - dy * ny  # how far inside of each side of b the centre of a is
            inside = lambda h: base - r[a][:, None] * (ux[h % segments][:, None] * nx + uy[h % segments][:, None] * ny)  # noqa: E731, B023
            p, q = inside(g), inside(g + 1)
            turn = (sides - g[:, None]) % segments
            along, against = turn == 0, turn == segments // 2
            with np.errstate(all="ignore"):
                t = p / (p - q)
            rising = (q > p) & ~along & ~against
            falling = (q < p) & ~along & ~against
            low, high = np.where(rising, t, -np.inf).max(axis=1), np.where(falling, t, np.inf).min(axis=1)
            on = ((p + q) / 2)[along]
            off = np.where(b < a, on < -eps, on <= eps) | (((p + q) / 2)[against] < -eps)
            low, high = np.maximum(low, s0), np.minimum(high, e0)
            least = eps / (2 * r[a] * math.sin(step / 2))
            none = off | (high - low <= least)
            low, high = np.where(none, e0, low), np.where(none, e0, high)
            before, after = low - s0 > least, e0 - high > least
            parts += [(i[before], g[before], s0[before], low[before]), (i[after], g[after], high[after], e0[after])]
        if parts:
            at, edge, s, e = (np.concatenate(c) for c in zip(*parts))
        k += 1
    return tuple(np.concatenate(c) for c in zip(*done)) if done else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0))


def tile(pdf: pd.DataFrame, segments: int, eps: float) -> pd.DataFrame:
    """Links (fid, v: one for each point but the first of a set) and, of own points that have links or share their fid, the pieces of boundary that are left."""
    pdf = pdf.sort_values(["fid", "x", "y", "r"], kind="stable")
    x, y, r, fid = (pdf[c].to_numpy() for c in ("x", "y", "r", "fid"))
    own, bare, root, step, out = np.flatnonzero(pdf["own"]), pdf["own"].to_numpy(bool) & (pdf["shared"].to_numpy() > 0), np.arange(len(pdf)), 2 * math.pi / segments, []

    def add(point, edge, s, e):
        ends = [[v[point] + r[point] * of(k % segments * step) for v, of in ((x, np.cos), (y, np.sin))] for k in (edge, edge + 1)]
        at = [np.where(t <= 0, v, np.where(t >= 1, w, v + t * (w - v))) for t in (s, e) for v, w in zip(*ends)]
        out.append(pd.DataFrame({"fid": fid[point], "v": pd.array([None] * len(point), "Int64"), **dict(zip(("ax", "ay", "bx", "by"), at))}))

    for a, b, d in _near(x, y, r, own, pdf["top"].iat[0]):
        root, bare[a] = _join(root, a, b), False
        best = np.lexsort((d - r[b], a))
        add(*_left(a[best], b[best], x, y, r, segments, eps))
    bare = np.flatnonzero(bare)
    add(np.repeat(bare, segments), np.tile(np.arange(segments), len(bare)), np.zeros(len(bare) * segments), np.ones(len(bare) * segments))
    tied = root != np.arange(len(root))
    out.append(pd.DataFrame({"fid": fid[tied], "v": pd.array(fid[root[tied]], "Int64"), **{c: np.full(tied.sum(), np.nan) for c in ("ax", "ay", "bx", "by")}}))
    return pd.concat(out)


def _welded(x: np.ndarray, y: np.ndarray, group: np.ndarray, tolerance: float) -> np.ndarray:
    """Numbers of the points, equal for those of a group that are within the tolerance of one another (in both axes), or joined by such."""
    root = np.arange(len(x))
    for by, of in ((0.0, 0.0), (0.5, 0.0), (0.0, 0.5), (0.5, 0.5)):  # four shifted grids of twice the tolerance
        keys = np.stack([group, np.floor(x / (2 * tolerance) + by).astype(np.int64), np.floor(y / (2 * tolerance) + of).astype(np.int64)])
        order = np.lexsort(keys)
        same = (np.diff(keys[:, order], axis=1) == 0).all(axis=0)
        root = _join(root, order[:-1][same], order[1:][same])
    return root


def rings(ax, ay, bx, by, group, tolerance: float) -> list[tuple[int, np.ndarray]]:
    """Closed rings (group, vertices) from directed pieces with the inside on the left; at a branch the sharpest left turn is taken."""
    n = len(ax)
    node = _welded(np.concatenate([ax, bx]), np.concatenate([ay, by]), np.concatenate([group, group]), tolerance)
    px, py = np.concatenate([ax, bx])[node], np.concatenate([ay, by])[node]
    a, b = node[:n], node[n:]
    keep = a != b
    a, b, group = a[keep], b[keep], group[keep]
    order = np.argsort(a, kind="stable")
    a, b, group = a[order], b[order], group[order]
    low, high = np.searchsorted(a, b), np.searchsorted(a, b, side="right")
    if (low == high).any():
        raise ValueError("the boundary of a union is not closed")
    used, ends, lows, highs, out = np.zeros(len(a), bool), b.tolist(), low.tolist(), high.tolist(), []
    starts = a.tolist()
    for begin in range(len(a)):
        if used[begin]:
            continue
        ring, here = [], begin
        while True:
            used[here] = True
            ring.append(starts[here])
            if ends[here] == starts[begin]:
                break
            options = [o for o in range(lows[here], highs[here]) if not used[o]]
            if not options:
                raise ValueError("the boundary of a union is not closed")
            if len(options) > 1:
                x, y = px[ends[here]], py[ends[here]]
                back = math.atan2(py[starts[here]] - y, px[starts[here]] - x)
                options.sort(key=lambda o: (back - math.atan2(py[ends[o]] - y, px[ends[o]] - x)) % (2 * math.pi) or 2 * math.pi)  # noqa: B023
            here = options[0]
        vertices = np.array([*ring, ring[0]])
        shape = K.drop_collinear(np.column_stack([px[vertices], py[vertices]]))
        if len(shape) > 3 and abs(K.ring_area(shape)) > tolerance * tolerance:
            out.append((group[begin], shape))
    return out


def nest(found: list[np.ndarray]) -> K.Geometry:
    """Shells are counter-clockwise; a hole goes to the smallest shell around it."""
    areas = [K.ring_area(r) for r in found]
    shells = sorted((i for i, a in enumerate(areas) if a > 0), key=lambda i: areas[i])
    parts = {i: [found[i]] for i in shells}
    box = np.array([[*found[i].min(axis=0), *found[i].max(axis=0)] for i in shells]).reshape(-1, 4)
    for i, a in enumerate(areas):
        if a < 0:
            (x0, y0), (x1, y1) = found[i].min(axis=0), found[i].max(axis=0)
            fits = np.flatnonzero((box[:, 0] <= x0) & (box[:, 1] <= y0) & (box[:, 2] >= x1) & (box[:, 3] >= y1))
            probe = np.array([K.interior_point([[found[i]]])]) if len(fits) > 1 else None
            for k in fits:
                if k == fits[-1] or K.contains([[found[shells[k]]]], probe)[0]:
                    parts[shells[k]].append(found[i])
                    break
    return sorted(parts.values(), key=lambda p: (p[0][:, 0].min(), p[0][:, 1].min()))


def assembled(pdf: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    by: dict[int, list] = {}
    for clump, ring in rings(*(pdf[c].to_numpy() for c in ("ax", "ay", "bx", "by", "clump")), tolerance):
        by.setdefault(int(clump), []).append(ring)
    shapes = {c: nest(found) for c, found in by.items()}
    side = lambda k: [[[r[:, k] for r in part] for part in g] for g in shapes.values()]
    return pd.DataFrame({"clump": list(shapes), "xs": side(0), "ys": side(1)})


def clumps(df: DataFrame, segments: int) -> DataFrame:
    """uid, geom, count of the clumps of points (fid long; x, y, r double) whose circles meet, each point as a polygon of ``segments`` sides.

    Points of like radii have their own grid of tiles, and a tile also sees the points of any radius that may meet its own.  Points of
    one fid are in one clump; those without a finite place and radius have no shape and meet none.
    """
    df = df.where("fid is not null")
    finite = " and ".join(f"{c} is not null and not isnan({c}) and abs({c}) < double('inf')" for c in ("x", "y", "r"))
    known, unknown = df.where(finite), df.where(f"not ({finite})")
    several = known.select("fid", "x", "y", "r").distinct().groupBy("fid").count().where("count > 1").select("fid")
    discs = known.groupBy("x", "y", "r").agg(F.min("fid").alias("fid"), F.count("*").alias("n"))
    same = None
    if several.head(1):  # a fid at several places: links between its discs
        places = known.join(several, "fid", "left_semi").select("x", "y", "r", F.col("fid").alias("v")).distinct()
        discs = discs.join(places.select("x", "y", "r", F.lit(1).alias("shared")).distinct(), ["x", "y", "r"], "left").na.fill(0, ["shared"])
        discs = materialize(discs, "discs")
        same = discs.join(places, ["x", "y", "r"]).select(F.col("fid").alias("u"), "v").where("u <> v")
    else:
        discs = materialize(discs.withColumn("shared", F.lit(0)), "discs")
    e = discs.agg(*[f(c).alias(f"{c}{k}") for c in ("x", "y", "r") for k, f in (("0", F.min), ("1", F.max))]).first()
    least = e.r0 or 1.0
    eps = 1e-11 * least + 1e-15 * max(abs(v or 0.0) for v in e)
    tolerance = 20 * eps / math.sin(2 * math.pi / segments)
    discs = discs.withColumn("level", F.floor(F.log(4.0, F.col("r") / F.lit(least)) + 1e-9).cast("int"))
    # how full blocks of four radii are, as seen from the points in them
    block = F.lit(4 * least) * F.pow(F.lit(4.0), F.col("level") + 1)
    blocks = discs.groupBy("level", F.floor(F.col("x") / block), F.floor(F.col("y") / block)).agg(F.count("*").cast("double").alias("c"), F.max("r").alias("top"))
    tiles = []
    for row in blocks.groupBy("level").agg(F.max("top").alias("top"), (F.sum(F.col("c") * F.col("c")) / F.sum("c")).alias("full")).collect():  # some tens
        side = 4 * least * 4.0 ** (row.level + 1) * math.sqrt(TILE / row.full)
        tiles.append((row.level, row.top, max(row.top, side, (e.x1 - e.x0) / 256, (e.y1 - e.y0) / 256)))
    grids = df.sparkSession.createDataFrame(tiles, "grid int, top double, side double")
    at = lambda c, by: F.floor((F.greatest(F.lit(e[f"{c}0"]), F.least(F.lit(e[f"{c}1"]), F.col(c) + by)) - F.lit(e[f"{c}0"])) / F.col("side"))
    reach = (F.col("r") + F.col("top")) * (1 + 1e-9)
    seen = discs.crossJoin(F.broadcast(grids))
    for c in ("x", "y"):
        seen = seen.withColumn(f"_t{c}", F.explode(F.sequence(at(c, -reach), at(c, reach)))).withColumn(f"_o{c}", F.col(f"_t{c}") == at(c, F.lit(0.0)))
    seen = seen.select("fid", "x", "y", "r", "shared", "grid", "top", "_tx", "_ty", ((F.col("level") == F.col("grid")) & F.col("_ox") & F.col("_oy")).alias("own"))
    found = materialize(seen.groupBy("grid", "_tx", "_ty").applyInPandas(lambda pdf: tile(pdf, segments, eps), PIECE), "boundaries")
    links = found.where("v is not null").select(F.col("fid").alias("u"), "v")
    named = materialize(components(links.unionByName(same) if same else links), "clumps").select(F.col("node").alias("fid"), "component")
    in_clump = lambda d: d.join(named, "fid", "left").withColumn("clump", F.coalesce("component", "fid"))
    counts = in_clump(discs.select("fid", "n").unionByName(unknown.select("fid", F.lit(1).cast("long").alias("n")))).groupBy("clump").agg(F.sum("n").alias("count"))
    alone = discs.where("shared = 0").join(links.select(F.col("u").alias("fid")).union(links.select("v")).distinct(), "fid", "left_anti")
    pieces = in_clump(found.where("v is null").drop("v"))
    shapes = pieces.groupBy(F.pmod(F.xxhash64("clump"), F.lit(GROUPS))).applyInPandas(lambda pdf: assembled(pdf, tolerance), "clump long, xs array<array<array<double>>>, ys array<array<array<double>>>")
    geom = F.transform("xs", lambda p, i: F.transform(p, lambda r, j: F.zip_with(r, F.col("ys")[i][j], lambda a, b: F.struct(a.alias("x"), b.alias("y")))))
    shapes = shapes.select("clump", geom.alias("geom")).unionByName(alone.select(F.col("fid").alias("clump"), E.circle(F.col("x"), F.col("y"), F.col("r"), segments).alias("geom")))
    return counts.join(shapes, "clump", "left").select(F.col("clump").alias("uid"), F.coalesce("geom", F.array().cast(E.GEOMETRY)).alias("geom"), "count")
