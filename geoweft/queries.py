"""Registered queries over the derived views, each with the same result in SQL where SQL can say it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fixtures as X
from .functions import expr as E
from .operators import aggregate, autocorr, buffers, construct, distribution, edit, grids, joins, overlay, raster, rastervec, stats, surface, vector

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that sums in another order compare equal."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, digits: int = 6):
    def add(fn):
        name = fn.__name__
        QUERIES[name] = lambda spark, d: rounded(fn(spark, d), digits)
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return add


def shape(df: DataFrame, *keys: str) -> DataFrame:
    """Area, length and box of a geometry beside its keys."""
    b = E.bounds(F.col("geom"))
    return df.select(*keys, E.area(F.col("geom")).alias("area"), E.length(F.col("geom")).alias("perimeter"), *[b[n].alias(n) for n in ("xmin", "ymin", "xmax", "ymax")])


C, S, L, T, Z = X.CUSTOMERS, X.SUPPLIERS, X.LINEITEMS, X.TRACKS, X.ZONES
r6 = lambda e, a: f"round({e}, 6) + 0.0 AS {a}"

# ---- A


@query(f"SELECT count(*) AS count FROM {C} WHERE w > 0 AND seg = 'BUILDING'")
def count_features(s, d):
    return vector.count_features(X.customers(s, d), "w > 0 and seg = 'BUILDING'")


@query(f"SELECT round(sum((xmax - xmin) * (ymax - ymin)) / 10000.0, 6) AS area FROM {Z} WHERE v > 20")
def sum_areas(s, d):
    return vector.sum_areas(X.zones(s), "v > 20", "Hectare")


@query(f"SELECT fid, seg FROM {C} WHERE w BETWEEN 1000 AND 5000")
def select_features(s, d):
    return vector.select_features(X.customers(s, d), "w between 1000 and 5000", ["fid", "seg"])


@query(f"SELECT fid, round(w * 2 + x, 6) AS evaluated FROM {C}")
def calculate_field(s, d):
    return vector.calculate_field(X.customers(s, d), "w * 2 + x").select("fid", "evaluated")


@query(f"SELECT fid, (xmax - xmin) * (ymax - ymin) / 1000000.0 AS geom_area, 2 * (xmax - xmin + ymax - ymin) AS per FROM {Z}")
def calculate_area(s, d):
    return vector.calculate_area(X.zones(s), unit="SquareKilometers", perimeter="per").select("fid", "geom_area", "per")


@query(f"SELECT fid, round(sqrt(2500 + (fid % 40) * (fid % 40)) / 1000.0, 6) AS geom_len FROM {S}")
def calculate_length(s, d):
    return vector.calculate_length(X.lines(s, d), unit="Kilometers").select("fid", "geom_len")


@query(f"SELECT fid, (xmin + xmax) / 2 AS x_coord, (ymin + ymax) / 2 AS y_coord FROM {Z}")
def calculate_xy(s, d):
    return vector.calculate_xy(X.zones(s)).select("fid", "x_coord", "y_coord")


@query(f"SELECT fid, x, y FROM {C} UNION ALL SELECT fid, x, y FROM {S}")
def merge_features(s, d):
    return vector.merge_features(X.customers(s, d).select("fid", "x", "y"), X.suppliers(s, d))


@query(f"SELECT fid, round(6378137.0 * radians(x / 10), 4) AS px, round(6378137.0 * ln(tan(pi() / 4 + radians(y / 20) / 2)), 4) + 0.0 AS py FROM {S}", 4)
def reproject(s, d):
    g = X.suppliers(s, d).withColumn("geom", F.array(F.array(F.array(F.struct((F.col("x") / 10).alias("x"), (F.col("y") / 20).alias("y"))))))
    return vector.reproject(g, "EPSG:3857", "EPSG:4326").select("fid", F.col("geom")[0][0][0].x.alias("px"), F.col("geom")[0][0][0].y.alias("py"))


@query(f"SELECT fid, x + 1 AS vx, y AS vy, v AS vz FROM {S}")
def force_dimension(s, d):
    g = vector.force_dimension(X.lines(s, d), "XYZ", "v").withColumn("p", F.col("geom")[0][0][0])
    return g.select("fid", (F.col("p.x") + 1).alias("vx"), F.col("p.y").alias("vy"), F.col("p.z").alias("vz"))


@query("SELECT i + 1 AS fid, 1.0 AS area FROM range(2) t(i)")
def geometry_to_features(s, d):
    square = lambda x: [[(x, 0), (x + 1, 0), (x + 1, 1), (x, 1), (x, 0)]]
    return vector.geometry_to_features(s, [square(0), square(3)], True).select("fid", E.area(F.col("geom")).alias("area"))


@query(f"SELECT v AS value, count(*) AS frequency FROM {Z} GROUP BY v")
def histogram_features(s, d):
    return vector.histogram_features(X.zones(s), "v")


# ---- B

_NEAR = f"SELECT c.fid, s.fid AS sid, sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)) AS d, row_number() OVER (PARTITION BY c.fid ORDER BY sqrt((c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y)), s.fid) AS rn, s.v, s.nk, s.x AS sx, s.y AS sy, c.x, c.y FROM {C} c, {S} s"
_SELF = f"SELECT a.fid, b.fid AS sid, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, row_number() OVER (PARTITION BY a.fid ORDER BY sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.fid) AS rn FROM {S} a, {S} b WHERE a.fid <> b.fid"


@query(f"SELECT c.fid, n.n_name AS n_name FROM {C} c LEFT JOIN nation n ON c.nk = n.n_nationkey")
def attribute_join(s, d):
    return joins.attribute_join(X.customers(s, d), "nk", X.table(s, d, "nation"), "n_nationkey", "OUTER").select("fid", "n_name")


@query(f"SELECT fid, CASE WHEN d <= 60 THEN sid END AS sid, CASE WHEN d <= 60 THEN round(v, 6) END AS v FROM ({_NEAR}) WHERE rn = 1")
def spatial_join(s, d):
    return joins.spatial_join(X.customers(s, d), X.suppliers(s, d).select(F.col("fid"), "x", "y", "v"), True, 60.0).select("fid", F.col("fid_1").alias("sid"), "v")


@query(f"SELECT fid, sid AS near_id, CASE WHEN d <= 40 THEN {'round(d, 6)'} END AS near_dist FROM ({_NEAR}) WHERE rn = 1")
def near(s, d):
    return joins.near(X.customers(s, d), X.suppliers(s, d), maximum=40.0).select("fid", "near_id", "near_dist")


@query(f"SELECT s.fid, count(n.fid) AS count FROM {S} s LEFT JOIN (SELECT * FROM ({_NEAR}) WHERE rn = 1) n ON n.sid = s.fid GROUP BY s.fid")
def nearest_neighbor_count(s, d):
    return joins.nearest_neighbor_count(X.suppliers(s, d), X.customers(s, d)).select("fid", "count")


@query(f"SELECT fid AS from_id, sid AS to_id, round(d, 6) AS distance, rn::int AS rank FROM ({_SELF}) WHERE rn <= 3 AND d > 0")
def knn_map(s, d):
    return joins.knn_map(X.suppliers(s, d), 3).drop("geom")


@query(f"SELECT fid, round(max(d), 6) AS radius, count(*) AS neighbors FROM ({_NEAR}) WHERE rn <= 3 GROUP BY fid HAVING max(d) > 0")
def knn_circle(s, d):
    return joins.knn_circle(X.customers(s, d), X.suppliers(s, d), 3).select("fid", "radius", "neighbors")


@query(f"SELECT fid AS spoke_id, sid AS hub_id, round(d, 6) AS hub_dist FROM ({_NEAR}) WHERE rn = 1 AND d > 0 AND d <= 80")
def hub_lines_by_distance(s, d):
    return joins.hub_lines_by_distance(X.suppliers(s, d), X.customers(s, d), 80.0).drop("geom")


@query(f"SELECT c.fid, round(sqrt((c.x - h.x) ** 2 + (c.y - h.y) ** 2), 6) AS hub_dist FROM {C} c JOIN {S} h ON c.nk + 1 = h.fid WHERE sqrt((c.x - h.x) ** 2 + (c.y - h.y) ** 2) BETWEEN 1e-12 AND 500")
def hub_lines_by_id(s, d):
    return joins.hub_lines_by_id(X.suppliers(s, d), "fid", X.customers(s, d).withColumn("hub", F.col("nk") + 1), "hub", 500.0).select("fid", "hub_dist")


@query(f"SELECT z.fid, count(c.fid) AS count, round(sum(c.w), 4) AS sum_w, round(avg(c.w), 4) AS avg_w FROM {Z} z LEFT JOIN {C} c ON c.x BETWEEN z.xmin AND z.xmax AND c.y BETWEEN z.ymin AND z.ymax GROUP BY z.fid", 4)
def point_statistics(s, d):
    return joins.point_statistics(X.zones(s), X.customers(s, d).select("x", "y", "w"), "SUM.w,MEAN.w").select("fid", "count", "sum_w", "avg_w")


@query(f"SELECT s.fid, count(c.fid) AS count, round(max(c.w), 6) AS max_w FROM {S} s LEFT JOIN {C} c ON (c.x - s.x) * (c.x - s.x) + (c.y - s.y) * (c.y - s.y) <= 900 GROUP BY s.fid")
def buffer_point_statistics(s, d):
    return joins.buffer_point_statistics(X.suppliers(s, d), 30.0, X.customers(s, d).select("x", "y", "w"), "MAX.w").select("fid", "count", "max_w")


_PROJ = f"""SELECT c.fid, l.fid AS lid, l.x + greatest(0, least(1, ((c.x - l.x) * 50 + (c.y - l.y) * (l.fid % 40)) / (2500 + (l.fid % 40) * (l.fid % 40)))) * 50 AS px,
 l.y + greatest(0, least(1, ((c.x - l.x) * 50 + (c.y - l.y) * (l.fid % 40)) / (2500 + (l.fid % 40) * (l.fid % 40)))) * (l.fid % 40) AS py, c.x, c.y FROM {C} c, {S} l"""


@query(f"SELECT fid, round(min(sqrt((x - px) ** 2 + (y - py) ** 2)), 6) AS snap_dist FROM ({_PROJ}) GROUP BY fid")
def snap_points_to_lines(s, d):
    return joins.snap_points_to_lines(X.customers(s, d), X.lines(s, d)).select("fid", "snap_dist")


@query(f"SELECT round(sum(sqrt(2500 + (fid % 40) * (fid % 40)) * least(1, (1020 - y) / greatest(fid % 40, 1e-9), (1020 - x) / 50.0)), 3) AS sum_len FROM {S}", 3)
def sum_line_length(s, d):
    return joins.sum_line_length(X.zones(s), X.lines(s, d)).agg(F.sum("sum_len").alias("sum_len"))


# ---- C


@query(f"SELECT seg AS \"case\", 'w' AS field, count(w) AS count, 0::bigint AS invalid, round(sum(w), 4) AS sum, min(w) AS min, max(w) AS max, round(avg(w), 4) AS mean, round(var_pop(w), 4) AS variance, round(stddev_pop(w), 4) AS std_dev, round(max(w) - min(w), 4) AS range, round(stddev_pop(w) / avg(w), 4) AS cv FROM {C} GROUP BY seg", 4)
def statistics_features(s, d):
    return stats.statistics(X.customers(s, d), ["w"], "seg")


@query(f"SELECT r AS r, count(*) AS count, sum(v) AS sum_v, sum((xmax - xmin) * (ymax - ymin)) AS area FROM {Z} GROUP BY r")
def dissolve(s, d):
    return aggregate.dissolve(X.zones(s), "r", "SUM.v").select("r", "count", "sum_v", E.area(F.col("geom")).alias("area"))


@query("SELECT 1040400.0 AS area, 4080.0 AS perimeter")
def union_polygon(s, d):
    return aggregate.union_polygon(X.zones(s)).select(E.area(F.col("geom")).alias("area"), E.length(F.col("geom")).alias("perimeter"))


@query(f"SELECT c, count(*) AS parts, min(v) FILTER (r = 0) AS v FROM {Z} GROUP BY c")
def singlepart_to_multipart(s, d):
    return aggregate.singlepart_to_multipart(X.zones(s), "c").select("c", F.size("geom").cast("long").alias("parts"), "v")


@query(f"SELECT x, y, count(*) AS icount FROM {L} GROUP BY x, y")
def collect_events(s, d):
    return aggregate.collect_events(X.lineitems(s, d).withColumn("fid", F.monotonically_increasing_id()), tolerance=0.0).select("x", "y", "icount")


@query(f"SELECT DISTINCT x, y FROM {L}")
def delete_duplicates(s, d):
    return aggregate.delete_duplicates(X.lineitems(s, d).withColumn("fid", F.monotonically_increasing_id())).select("x", "y")


@query(f"SELECT fid, 1::bigint AS icount FROM {Z}")
def collect_features(s, d):
    z = X.zones(s)
    return aggregate.collect_features(z).select("fid", "icount")


@query()
def collect_events_tolerance(s, d):
    return aggregate.collect_events(X.customers(s, d), tolerance=12.0).select("fid", "icount")


@query()
def spatial_clumps(s, d):
    return shape(aggregate.spatial_clumps(X.suppliers(s, d), "20.0"), "uid", "count")


# ---- D


@query(f"SELECT seg AS \"case\", round(sum((CASE WHEN w IS NULL THEN 1 ELSE w END) * x) / sum(w), 4) AS x, round(sum(w * y) / sum(w), 4) AS y, count(*) AS count FROM {C} GROUP BY seg", 4)
def mean_center(s, d):
    return distribution.mean_center(X.customers(s, d), "w", "seg")


@query()
def median_center(s, d):
    return distribution.median_center(X.customers(s, d), None, "seg", ["w"])


@query(f"SELECT 'ALL' AS \"case\", arg_min(fid, (round(c, 6), fid)) AS id, round(min(c), 3) AS cost FROM (SELECT a.fid, sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS c FROM {S} a, {S} b GROUP BY a.fid)", 3)
def central_feature(s, d):
    return distribution.central_feature(X.suppliers(s, d), fid="fid").select("case", "id", "cost")


@query(f"SELECT seg AS \"case\", round(x, 4) AS x, round(y, 4) AS y, round(sqrt(vx + vy), 4) AS std_dist, n AS count FROM (SELECT seg, avg(x) AS x, avg(y) AS y, var_pop(x) AS vx, var_pop(y) AS vy, count(*) AS n FROM {C} GROUP BY seg)", 4)
def standard_distance(s, d):
    return distribution.standard_distance(X.customers(s, d), case="seg").drop("geom")


_ELL = f"SELECT seg, n, x, y, CASE WHEN sxy = 0 THEN 0 ELSE atan((sxx - syy + sqrt((sxx - syy) ** 2 + 4 * sxy * sxy)) / (2 * sxy)) END AS t, sxx, syy, sxy FROM (SELECT seg, count(*) AS n, avg(x) AS x, avg(y) AS y, var_pop(x) * count(*) AS sxx, var_pop(y) * count(*) AS syy, covar_pop(x, y) * count(*) AS sxy FROM {C} GROUP BY seg)"


@query(f"SELECT seg AS \"case\", round(x, 4) AS x, round(y, 4) AS y, round(sqrt(2 * (sxx * cos(t) ** 2 - 2 * sxy * sin(t) * cos(t) + syy * sin(t) ** 2) / n), 4) AS x_std_dist, round(sqrt(2 * (sxx * sin(t) ** 2 + 2 * sxy * sin(t) * cos(t) + syy * cos(t) ** 2) / n), 4) AS y_std_dist, n AS count FROM ({_ELL})", 4)
def std_dev_ellipse(s, d):
    return distribution.std_dev_ellipse(X.customers(s, d), case="seg").drop("geom", "rotation")


@query(f"SELECT 'ALL' AS \"case\", round(degrees(atan2(sum(sin(a)), sum(cos(a)))), 6) AS dir_mean, round(1 - sqrt(sum(sin(a)) ** 2 + sum(cos(a)) ** 2) / count(*), 6) AS cir_var, round(avg(n), 6) AS ave_len, count(*) AS count FROM (SELECT atan2(fid % 40, 50) AS a, sqrt(2500 + (fid % 40) * (fid % 40)) AS n FROM {S})")
def linear_directional_mean(s, d):
    return distribution.linear_directional_mean(X.lines(s, d), False).select("case", "dir_mean", "cir_var", "ave_len", "count")


# ---- E

_EV = f"e AS (SELECT fid AS id, x, y, coalesce(v, 1) AS xv, cas AS yv FROM {S})"
_MO = "m AS (SELECT count(*)::double AS n, sum(xv) AS sx, sum(xv ** 2) AS sx2, sum(xv ** 3) AS sx3, sum(xv ** 4) AS sx4, avg(xv) AS mx, avg(yv) AS my, var_pop(xv) * count(*) AS z2, var_pop(yv) * count(*) AS y2 FROM e), m4 AS (SELECT sum((xv - mx) ** 4) AS z4 FROM e, m)"


def _pairs_sql(weight: str, keep: str, own: bool = False) -> str:
    return f"p AS (SELECT * FROM (SELECT a.id, b.id AS id2, a.xv, b.xv AS xv2, a.yv, b.yv AS yv2, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d FROM e a, e b{'' if own else ' WHERE a.id <> b.id'}) WHERE {keep}), w AS (SELECT *, {weight} AS w FROM p), rs AS (SELECT id, sum(w) AS s FROM w GROUP BY id)"


def _sums_sql(row: bool) -> str:
    wij, wji = ("w.w / r1.s", "w.w / r2.s") if row else ("w.w", "w.w")
    return f"q AS (SELECT w.*, {wij} AS wij, {wji} AS wji FROM w JOIN rs r1 ON w.id = r1.id JOIN rs r2 ON w.id2 = r2.id), i AS (SELECT id, sum(wij) AS sw, sum(wji) AS swji, sum(wij * wij) AS sw2, sum((wij + wji) ** 2) AS s1, sum(wij * xv2) AS swx, sum(wij * yv2) AS swy, sum(wij * (xv - xv2) ** 2) AS swd, count(*) AS nn, sum(w) AS raw FROM q GROUP BY id), g AS (SELECT e.id, xv, yv, coalesce(sw, 0) AS sw, coalesce(swji, 0) AS swji, coalesce(sw2, 0) AS sw2, coalesce(s1, 0) AS s1, coalesce(swx, 0) AS swx, coalesce(swy, 0) AS swy, coalesce(swd, 0) AS swd, coalesce(raw, 0) AS raw, coalesce(nn, 0) AS nn FROM e LEFT JOIN i ON e.id = i.id)"


_TOT = "t AS (SELECT sum(sw) AS w, 0.5 * sum(s1) AS S1, sum((sw + swji) ** 2) AS S2, sum((xv - mx) * (swx - mx * sw)) AS zw, sum(xv * swx) AS np, sum(swd) AS cw, sum(sw ** 2) AS w2, sum((swx - mx * sw) ** 2) AS zx2, sum(abs((swx - mx * sw) * (swy - my * sw))) AS zxy FROM g, m)"
_INV, _FIX = ("CASE WHEN d <= 1 THEN 1 ELSE 1 / d END", "true"), ("1.0", "d <= 150")


def _global(concept, row, observed, expected, variance, own=False):
    return f"WITH {_EV}, {_MO}, {_pairs_sql(*concept, own)}, {_sums_sql(row)}, {_TOT}, o AS (SELECT CASE WHEN w <> 0 THEN {observed} ELSE 0 END AS o, coalesce({expected}, 0) AS e, CASE WHEN w <> 0 THEN {variance} ELSE 0 END AS v FROM t, m, m4), z AS (SELECT o, e, v, CASE WHEN v > 0 THEN (o - e) / sqrt(v) ELSE 0 END AS z FROM o) SELECT {r6('o', 'observed')}, {r6('e', 'expected')}, {r6('v', 'variance')}, {r6('z', 'z_score')}, {r6(E.zprob_sql('z'), 'p_value')} FROM z"


@query(_global(_INV, True, "zw / ((z2 / n) * w)", "-1.0 / (n - 1)", "(n * ((n * n - 3 * n + 3) * S1 - n * S2 + 3 * w * w) - (z4 / n) / (z2 / n) ** 2 * ((n * n - n) * S1 - 2 * n * S2 + 6 * w * w)) / ((n - 1) * (n - 2) * (n - 3) * w * w) - 1 / (n - 1) ** 2"))
def global_morans_i(s, d):
    return autocorr.global_morans_i(X.suppliers(s, d), "v", standardization="Row", fid="fid")


@query(_global(_FIX, False, "zw / ((z2 / n) * w)", "-1.0 / (n - 1)", "(n * ((n * n - 3 * n + 3) * S1 - n * S2 + 3 * w * w) - (z4 / n) / (z2 / n) ** 2 * ((n * n - n) * S1 - 2 * n * S2 + 6 * w * w)) / ((n - 1) * (n - 2) * (n - 3) * w * w) - 1 / (n - 1) ** 2"))
def global_morans_i_band(s, d):
    return autocorr.global_morans_i(X.suppliers(s, d), "v", "FixedDistance", band=150.0, fid="fid")


_G = "(((n * n - 3 * n + 3) * S1 - n * S2 + 3 * w * w) * sx2 ** 2 - ((n * n - n) * S1 - 2 * n * S2 + 6 * w * w) * sx4 - (2 * n * S1 - (n + 3) * S2 + 6 * w * w) * sx ** 2 * sx2 + (4 * (n - 1) * S1 - 2 * (n + 1) * S2 + 8 * w * w) * sx * sx3 + (S1 - S2 + w * w) * sx ** 4) / ((sx ** 2 - sx2) ** 2 * n * (n - 1) * (n - 2) * (n - 3)) - (w / (n * (n - 1))) ** 2"


@query(_global(_FIX, False, "np / (sx * sx - sx2)", "w / (n * (n - 1))", _G))
def global_g_statistics(s, d):
    return autocorr.global_g(X.suppliers(s, d), "v", "FixedDistance", band=150.0, fid="fid")


_GC = "(n - 1) * S1 * (n * n - 3 * n + 3 - (n - 1) * b2) / (dv * w * w) - (n - 1) * S2 * (n * n + 3 * n - 6 - (n * n - n + 2) * b2) / (4 * dv * w * w) + (n * n - 3 - (n - 1) ** 2 * b2) / dv".replace("b2", "((z4 / (n - 1)) / (z2 / (n - 1)) ** 2)").replace("dv", "(n * (n - 2) * (n - 3))")


@query(_global(_INV, False, "cw / (2 * (z2 / (n - 1)) * w)", "1.0", _GC))
def global_gearys_c(s, d):
    return autocorr.global_gearys_c(X.suppliers(s, d), "v", fid="fid")


@query(_global(_INV, False, "(n / w2) * (zx2 / z2)", "0.0", "0.0"))
def global_lees_s(s, d):
    return autocorr.global_lees_s(X.suppliers(s, d), "v", fid="fid")


@query(_global(_INV, False, "(n / w2) * (zxy / (sqrt(z2) * sqrt(y2)))", "0.0", "0.0", True))
def global_lees_l(s, d):
    return autocorr.global_lees_l(X.suppliers(s, d), "v", "cas", fid="fid")


_SH = f"sh AS (SELECT fid AS id, x, y, cas / (SELECT sum(cas) FROM {S}) AS r, pop / (SELECT sum(pop) FROM {S}) AS p, (SELECT sum(cas) FROM {S}) AS sx FROM {S}), pp AS (SELECT a.id, b.id AS j, a.r, a.p, b.r AS r2, b.p AS p2, CASE WHEN sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 1 THEN 1.0 ELSE 1 / sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) END AS a FROM sh a, sh b)"


@query(f"WITH {_SH}, k AS (SELECT id, sum(a * sqrt(p2)) AS k FROM pp WHERE id <> j GROUP BY id), c AS (SELECT pp.id, sum(a / sqrt(p * p2) * (r - p) * (r2 - p2)) AS sa, sum(CASE WHEN j < pp.id THEN a * sqrt(p * p2) ELSE 0 END) AS aj, sum((1 - p2) * a * sqrt(p2 / p) - p2 * k2.k / sqrt(p)) AS yij, sum((1 - p) * a * sqrt(p / p2) - p * k1.k / sqrt(p2)) AS yji FROM pp JOIN k k1 ON pp.id = k1.id JOIN k k2 ON pp.j = k2.id WHERE pp.id <> j GROUP BY pp.id), o AS (SELECT sum((r - p) ** 2 / p) + sum(sa) AS o, (count(*) - 1 - 2 * sum(aj)) / any_value(sx) AS e, 2 / any_value(sx) ** 2 * sum(yij * yji) AS v FROM sh JOIN c ON sh.id = c.id), z AS (SELECT o, e, v, CASE WHEN v > 0 THEN (o - e) / sqrt(v) ELSE 0 END AS z FROM o) SELECT round(o, 4) + 0.0 AS observed, round(e, 4) + 0.0 AS expected, round(v, 4) + 0.0 AS variance, round(z, 4) + 0.0 AS z_score, round({E.zprob_sql('z')}, 4) AS p_value FROM z", 4)
def global_rogersons_r(s, d):
    return autocorr.global_rogersons_r(X.suppliers(s, d), "cas", "pop", fid="fid")


_TOUCH = f"SELECT a.fid AS id, b.fid AS id2, a.v > 50 AS b1, b.v > 50 AS b2 FROM {Z} a, {Z} b WHERE a.fid <> b.fid AND abs(a.c - b.c) + abs(a.r - b.r) = 1"


@query(f"WITH t AS ({_TOUCH}), k AS (SELECT count(*)::double AS k, sum((b1 AND b2)::int) AS bb, sum((NOT b1 AND NOT b2)::int) AS ww, sum((b1 <> b2)::int) AS bw FROM t), m AS (SELECT sum(c * (c - 1)) / 2.0 AS m FROM (SELECT id, count(*) AS c FROM t GROUP BY id)), n AS (SELECT count(*)::double AS n, sum((v > 50)::int) / count(*)::double AS pb FROM {Z}), a AS (SELECT *, 1 - pb AS pw FROM k, m, n) SELECT n::bigint AS n, bb::bigint AS bb, ww::bigint AS ww, bw::bigint AS bw, round((bb - k * pb * pb) / sqrt(k * pb ** 2 + 2 * m * pb ** 3 - (k + 2 * m) * pb ** 4), 6) AS z_bb, round((bw - 2 * k * pb * pw) / sqrt(2 * (k + m) * pb * pw - 4 * (k + 2 * m) * pb ** 2 * pw ** 2), 6) AS z_bw FROM a")
def join_count(s, d):
    from .plans.weights import rectangle_contiguity

    z = X.zones(s)
    return autocorr.join_count(z, "v > 50", rectangle_contiguity(z.withColumn("id", F.col("fid")), "Rook"), "fid").select("n", "bb", "ww", "bw", "z_bb", "z_bw")


def _local(concept, row, index, z, names, extra="", own=False):
    cols = ([f"{r6('CASE WHEN ok THEN i ELSE 0 END', names[0])}"] if names[0] else []) + [r6("CASE WHEN ok THEN z ELSE 0 END", names[1]), r6(f"CASE WHEN ok THEN {E.zprob_sql('z')} ELSE 1 END", names[2])]
    return f"WITH {_EV}, {_MO}, {_pairs_sql(*concept, own)}, {_sums_sql(row)}, rr AS (SELECT sum(raw ** 2) AS raw2 FROM g), o AS (SELECT id, xv, sw, swx, nn, mx, {index} AS i, {z} AS z, sw2, n FROM g, m, m4, rr), oo AS (SELECT *, z IS NOT NULL AND NOT isnan(z) AND NOT isinf(z) AS ok FROM o) SELECT id AS fid, {', '.join(cols)}{extra} FROM oo"


_B2 = "((z4 / (n - 1)) / (z2 / (n - 1)) ** 2)"


@query(_local(_INV, True, "(xv - mx) / (z2 / (n - 1)) * (swx - mx * sw)", f"((xv - mx) / (z2 / (n - 1)) * (swx - mx * sw) + sw / (n - 1)) / sqrt(sw2 * (n - {_B2}) / (n - 1) + (sw ** 2 - sw2) * (2 * {_B2} - n) / ((n - 1) * (n - 2)) - sw ** 2 / (n - 1) ** 2)", ("LMiIndex", "LMiZScore", "LMiPValue"), ", CASE WHEN NOT ok OR abs(z) < 1.96 THEN '' WHEN z > 1.96 THEN CASE WHEN swx / sw >= mx THEN 'HH' ELSE 'LL' END WHEN xv >= mx AND swx / sw <= mx THEN 'HL' WHEN xv <= mx AND swx / sw >= mx THEN 'LH' ELSE '' END AS COType"))
def local_morans_i(s, d):
    return autocorr.local_morans_i(X.suppliers(s, d), "v", standardization="Row", fid="fid").select("fid", "LMiIndex", "LMiZScore", "LMiPValue", "COType")


@query(_local(_FIX, False, "0", "CASE WHEN n * sw2 - sw ** 2 > 0 THEN (swx - sw * mx) / (sqrt(sx2 / n - mx ** 2) * sqrt((n * sw2 - sw ** 2) / (n - 1))) END", ("", "GiZScore", "GiPValue"), f", {r6('sw / (n * (n - 1))', 'GiMean')}"))
def local_g_statistics(s, d):
    return autocorr.local_g(X.suppliers(s, d), "v", "FixedDistance", band=150.0, fid="fid").select("fid", "GiZScore", "GiPValue", "GiMean")


@query(_local(_INV, True, "swd / (z2 / (n - 1))", f"(swd / (z2 / (n - 1)) - 2 * n * sw / (n - 1)) / CASE WHEN n / (n - 1) * (sw ** 2 + sw2) * (3 + {_B2}) - (2 * n * sw / (n - 1)) ** 2 > 0 THEN sqrt(n / (n - 1) * (sw ** 2 + sw2) * (3 + {_B2}) - (2 * n * sw / (n - 1)) ** 2) END", ("LGcIndex", "LGcZScore", "LGcPValue")))
def local_gearys_c(s, d):
    return autocorr.local_gearys_c(X.suppliers(s, d), "v", standardization="Row", fid="fid").select("fid", "LGcIndex", "LGcZScore", "LGcPValue")


@query(_local(_INV, False, "(n * n / raw2) * ((swx - mx * sw) ** 2 / z2)", "0.0", ("LLsIndex", "LLsZScore", "LLsPValue"), own=True))
def local_lees_s(s, d):
    return autocorr.local_lees_s(X.suppliers(s, d), "v", fid="fid").select("fid", "LLsIndex", "LLsZScore", "LLsPValue")


@query(_local(_INV, False, "(n * n / raw2) * ((swx - mx * sw) * (swy - my * sw) / (sqrt(z2) * sqrt(y2)))", "0.0", ("LLlIndex", "LLlZScore", "LLlPValue"), own=True))
def local_lees_l(s, d):
    return autocorr.local_lees_l(X.suppliers(s, d), "v", "cas", fid="fid").select("fid", "LLlIndex", "LLlZScore", "LLlPValue")


@query(f"WITH {_SH}, k AS (SELECT id, sum(CASE WHEN id = j THEN 1.0 ELSE a END * (r2 - p2) / sqrt(p2)) AS k FROM pp GROUP BY id), o AS (SELECT sh.id, (r - p) / sqrt(p) * k AS i, (r - p) / sqrt(p) * k / ((1 - p) / sx) AS z FROM sh JOIN k ON sh.id = k.id) SELECT id AS fid, {r6('i', 'LRrIndex')}, round(z, 4) AS LRrZScore FROM o", 6)
def local_rogersons_r(s, d):
    return autocorr.local_rogersons_r(X.suppliers(s, d), "cas", "pop", fid="fid").select("fid", "LRrIndex", F.round("LRrZScore", 4).alias("LRrZScore"))


@query(f"WITH p AS (SELECT a.fid, a.cas AS xv, a.pop AS yv, b.cas AS x2, b.pop AS y2 FROM {S} a, {S} b WHERE (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 22500), t AS (SELECT sum(cas) / sum(pop) AS g FROM {S}) SELECT fid, {r6('any_value(yv) / any_value(xv) / any_value(g)', 'flq')}, {r6('sum(x2) / sum(y2) / any_value(g)', 'flqd')}, {r6('(sum(y2) - sum(x2) * any_value(g)) / sqrt(sum(x2) * any_value(g))', 'fz')} FROM p, t GROUP BY fid", 6)
def focal_lq(s, d):
    return autocorr.focal_lq(X.suppliers(s, d), "cas", "pop", band=150.0, fid="fid").select("fid", "flq", "flqd", "fz")


@query(f"WITH t AS (SELECT sum(cas) AS a, sum(pop) AS b FROM {S}), q AS (SELECT fid, cas / a - pop / b AS q FROM {S}, t) SELECT fid, {r6('q / (SELECT sqrt(sum(q * q) / count(*)) FROM q)', 'std_scr')} FROM q")
def standardized_scores(s, d):
    return autocorr.standardized_scores(X.suppliers(s, d), "cas", "pop").select("fid", "std_scr")


@query(
    f"SELECT a.fid AS id, b.fid AS id2 FROM {Z} a, {Z} b"
    " WHERE (a.xmin = b.xmin AND (a.ymax = b.ymin OR a.ymin = b.ymax)) OR (a.ymin = b.ymin AND (a.xmax = b.xmin OR a.xmin = b.xmax))"
)
def polygon_contiguity(s, d):
    from .plans.weights import polygon_contiguity

    return polygon_contiguity(X.zones(s), "Rook")


@query()
def local_sa_binning(s, d):
    b = grids.rectangular_binning(X.customers(s, d), 102, 102, bbox=X.EXTENT, valid_grid=False, geometry=False).withColumn("x", F.col("col") * 102 + 51.0).withColumn("y", F.col("row") * 102 + 51.0)
    return autocorr.local_sa(b, "val", "GetisOrdGiStar", fid="uid").drop("x", "y")


@query()
def local_sa_overlay(s, d):
    z = joins.point_statistics(X.zones(s), X.customers(s, d).select("x", "y")).withColumn("x", F.col("xmin") + 51).withColumn("y", F.col("ymin") + 51).drop("geom")
    return autocorr.local_sa(z, "count", "MoranI", fid="fid").select("fid", "count", "LMiIndex", "LMiZScore", "COType")


# ---- F


@query(f"WITH n AS (SELECT * FROM ({_SELF}) WHERE rn = 1), t AS (SELECT count(*)::double AS n, avg(d) AS o, min(d) AS lo, max(d) AS hi FROM n), u AS (SELECT *, 0.5 * sqrt(1000000.0 / n) AS e, sqrt((4 - pi()) * 1000000.0 / (4 * pi() * n * n)) AS se FROM t), z AS (SELECT *, (o - e) / se AS z FROM u) SELECT {r6('o', 'observed')}, {r6('e', 'expected')}, {r6('o / e', 'index')}, {r6('z', 'z_score')}, {r6(E.zprob_sql('z'), 'p_value')} FROM z")
def nearest_neighbor_index(s, d):
    return stats.nearest_neighbor_index(X.suppliers(s, d), area=1e6, fid="fid").select("observed", "expected", "index", "z_score", "p_value")


@query(f"WITH e AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS n FROM {C}), k AS (SELECT ceil((x1 - x0) / 100.0) AS c, ceil((y1 - y0) / 100.0) AS r FROM e), q AS (SELECT least(floor((x - x0) / 100), c - 1) AS a, least(floor((y - y0) / 100), r - 1) AS b, count(*) AS k FROM {C}, e, k GROUP BY ALL) SELECT (SELECT n FROM e) AS points, (SELECT (c * r)::bigint FROM k) AS cells, {r6('(SELECT n / (c * r) FROM e, k)', 'mean')}, {r6('((SELECT sum(k * k) FROM q) - (SELECT n * n / (c * r) FROM e, k)) / (SELECT c * r FROM k)', 'variance')}")
def quadrat_analysis(s, d):
    return stats.quadrat(X.customers(s, d), 100.0).select("points", "cells", "mean", "variance")


@query()
def k_means(s, d):
    return stats.k_means(X.customers(s, d).orderBy("fid").coalesce(1), k=5).select("fid", "cluster")


@query()
def cluster_gam(s, d):
    return stats.cluster_gam(X.customers(s, d), "1.0", X.suppliers(s, d), "cas / 40", 60, 100, 20).drop("geom")


@query()
def cluster_besag_newell(s, d):
    return stats.besag_newell(X.customers(s, d), "1.0", X.suppliers(s, d), "cas / 40", 5, fid="fid").drop("geom")


@query(f"SELECT a.f AS field_a, b.f AS field_b, CASE WHEN a.f = b.f THEN 1.0 WHEN a.f || b.f IN ('wx', 'xw') THEN (SELECT round(corr(w, x), 6) FROM {C}) WHEN a.f || b.f IN ('wy', 'yw') THEN (SELECT round(corr(w, y), 6) FROM {C}) ELSE (SELECT round(corr(x, y), 6) FROM {C}) END + 0.0 AS r FROM (VALUES ('w'), ('x'), ('y')) a(f), (VALUES ('w'), ('x'), ('y')) b(f)")
def pearson(s, d):
    return stats.pearson(X.customers(s, d), ["w", "x", "y"])


@query(f"SELECT 'Intercept' AS variable, round(regr_intercept(price, w), 4) AS coefficient, round(regr_r2(price, w), 4) AS r2 FROM {L} UNION ALL SELECT 'w', round(regr_slope(price, w), 4), round(regr_r2(price, w), 4) FROM {L}", 4)
def ordinary_least_squares(s, d):
    return stats.ols(X.lineitems(s, d), "price", ["w"])["report"].select("variable", "coefficient", "r2")


# ---- G


@query(f"SELECT floor(x / 25)::bigint AS col, floor(y / 25)::bigint AS row, round(sum(w), 4) AS val FROM {L} WHERE x < 1025 AND y < 1025 GROUP BY ALL", 4)
def rectangular_binning(s, d):
    return grids.rectangular_binning(X.lineitems(s, d), 25, 25, "w", (0.0, 0.0, 1025.0, 1025.0), geometry=False).select("col", "row", "val")


_HX = math.sqrt(3) * 20


@query(f"""WITH p AS (SELECT x / {_HX!r} AS px, y / 30.0 AS py FROM {L}), c AS (SELECT px, py, k, k % 2 * 0.5 AS sh FROM p, (VALUES (0), (1)) o(j), LATERAL (SELECT CASE WHEN j = 0 THEN round(py) ELSE round(py) + CASE WHEN py - round(py) < 0 THEN -1 ELSE 1 END END AS k)),
 e AS (SELECT px, py, k, abs(k % 2) * 0.5 AS sh FROM c), f AS (SELECT px, py, k, round(px - sh) AS cc, ((px - sh - round(px - sh)) * {_HX!r}) ** 2 + ((py - k) * 30.0) ** 2 AS d2, CASE WHEN k = round(py) THEN 0 ELSE 1 END AS j FROM e),
 g AS (SELECT px, py, arg_min(k, (d2, j)) AS k, arg_min(cc, (d2, j)) AS cc FROM f GROUP BY px, py), n AS (SELECT px, py, count(*) AS n FROM p GROUP BY px, py) SELECT cc::bigint AS col, k::bigint AS row, sum(n)::double AS val FROM g JOIN n USING (px, py) GROUP BY ALL""")
def hexagonal_binning(s, d):
    return grids.hexagonal_binning(X.lineitems(s, d), 20, bbox=(0.0, 0.0, 1025.0, 1025.0), geometry=False).select("col", "row", "val")


@query(f"SELECT floor(x / 40)::bigint AS col, floor(y / 40)::bigint AS row, count(*)::double AS val FROM {C} GROUP BY ALL")
def circular_binning(s, d):
    return grids.circular_binning(X.customers(s, d), 20, bbox=(0.0, 0.0, 1040.0, 1040.0), geometry=False).select("col", "row", "val")


@query("SELECT i + 1 AS uid, (i % 8) * 127.5 AS xmin, (i // 8) * 204.0 AS ymin, 26010.0 AS area FROM range(40) t(i)")
def fishnet_count(s, d):
    return shape(grids.fishnet(s, X.EXTENT, 8, 5), "uid").select("uid", "xmin", "ymin", "area")


@query("SELECT i + 1 AS uid, (i % 11) * 100.0 AS xmin, (i // 11) * 100.0 AS ymin, 10000.0 AS area FROM range(121) t(i)")
def fishnet_size(s, d):
    return shape(grids.fishnet_by_size(s, X.EXTENT, 100, 100), "uid").select("uid", "xmin", "ymin", "area")


@query("SELECT round(1.5 * sqrt(3) * 2500, 4) AS area, 300.0 AS perimeter, ((ceil(1120 / 75.0) + 1) * (ceil(1120 / (sqrt(3) * 50)) + 1))::int AS n", 4)
def hexagon_grid(s, d):
    return shape(grids.hexagon_grid(s, X.EXTENT, 50), "uid").withColumn("perimeter", F.round("perimeter", 6)).groupBy(F.round("area", 4).alias("area"), "perimeter").agg(F.count("*").cast("int").alias("n"))


@query("SELECT round(sqrt(3) / 4 * 10000, 4) AS area, 300.0 AS perimeter", 4)
def triangular_grid(s, d):
    return shape(grids.triangular_grid(s, X.EXTENT, 100), "uid").select(F.round("area", 4).alias("area"), F.round("perimeter", 6).alias("perimeter")).distinct()


@query("SELECT i + 1 AS uid, (i % 11) * 100.0 AS xmin, (i // 11) * 100.0 AS ymin FROM range(121) t(i)")
def circular_grid(s, d):
    return shape(grids.circular_grid(s, X.EXTENT, 50), "uid").select("uid", "xmin", "ymin")


@query()
def polar_grids(s, d):
    return shape(grids.polar_grids(X.suppliers(s, d), [10, 20, 30]), "fid", "angle", "radius", "azimuth")


_NAMES = "(VALUES (0, 'N'), (1, 'NE'), (2, 'E'), (3, 'SE'), (4, 'S'), (5, 'SW'), (6, 'W'), (7, 'NW')) AS t(i, azimuth)"


@query(f"SELECT i * 45.0 AS angle, r::double AS radius, azimuth FROM {_NAMES}, (VALUES (100), (250)) AS u(r)")
def polar_grids_from_geometry(s, d):
    return grids.polar_grids_from_point(s, (500.0, 400.0), [100.0, 250.0]).select("angle", "radius", "azimuth")


@query("SELECT 1000::bigint AS n, true AS inside")
def random_points(s, d):
    return grids.random_points(s, X.EXTENT, 1000).agg(F.count("*").alias("n"), F.min(F.col("x").between(0, 1020) & F.col("y").between(0, 1020)).alias("inside"))


@query(f"SELECT fid, v::bigint AS n FROM {Z} WHERE v > 0")
def random_points_per_feature(s, d):
    return grids.random_points_per_feature(X.zones(s), "v").groupBy("fid").agg(F.count("*").alias("n"))


@query("SELECT i + 1 AS uid, (i % 20 + 0.5) * 51.0 AS x, (i // 20 + 0.5) * 102.0 AS y FROM range(200) t(i)")
def regular_points(s, d):
    return grids.regular_points(s, X.EXTENT, 20, 10).select("uid", "x", "y")


@query(f"SELECT s.sector, coalesce(q.n, 0) AS count, coalesce(round(q.w, 4), 0) AS sum FROM range(36) s(sector) LEFT JOIN (SELECT floor((((degrees(atan2(x - 500, y - 500)) + 360 + 5) % 360 + 360) % 360) / 10)::bigint AS sector, count(*) AS n, sum(w) AS w FROM {C} GROUP BY 1) q ON s.sector = q.sector", 4)
def wind_rose(s, d):
    return grids.wind_rose(X.customers(s, d), "w", (500.0, 500.0))["wind_rose"].select("sector", "count", "sum")


@query()
def multi_wind_rose(s, d):
    c = s.createDataFrame([(1, 300.0, 300.0), (2, 700.0, 600.0)], "cid int, x double, y double")
    return grids.multi_wind_rose([X.customers(s, d), X.suppliers(s, d)], None, c, 250.0)["wind_rose"].drop("geom")


@query()
def ring_map(s, d):
    return grids.ring_map(X.suppliers(s, d), ["v", "pop"])["ringmap"].drop("geom")


@query(f"SELECT fid, (row_number() OVER (ORDER BY (degrees(atan2(x - (SELECT (min(x) + max(x)) / 2 FROM {S}), y - (SELECT (min(y) + max(y)) / 2 FROM {S}))) + 360) % 360, fid) - 1)::int AS slot, v AS value FROM {S}")
def circle_map(s, d):
    return grids.circle_map(X.suppliers(s, d), "v")["circles"].select("fid", "slot", "value")


@query(f"SELECT date_trunc('day', ts)::varchar AS start, floor(x / 100)::bigint AS col, floor(y / 100)::bigint AS row, round(sum(value), 4) AS val, count(*) AS count FROM {T} WHERE value IS NOT NULL GROUP BY ALL", 4)
def stream_binning_batch(s, d):
    from .streaming.binning import stream_binning

    return stream_binning(X.tracks(s, d), 100, 100, weight="value").withColumn("start", F.col("start").cast("string"))


@query(f"SELECT count(*) AS n FROM {C} WHERE w > 100 AND seg LIKE 'B%' AND x BETWEEN 10 AND 500 AND y BETWEEN 20 AND 600")
def ecql_filter(s, d):
    from .functions.ecql import to_sql

    return X.customers(s, d).where(to_sql("w > 100 AND seg LIKE 'B%' AND BBOX(geom, 10, 20, 500, 600)")).agg(F.count("*").alias("n"))


@query(f"SELECT k AS \"class\", round((SELECT min(w) + (max(w) - min(w)) * k / 5 FROM {C}), 4) AS break FROM range(6) t(k)", 4)
def class_breaks(s, d):
    b = vector.class_breaks(X.customers(s, d), "w", "EqualInterval", 5)
    return s.createDataFrame(list(enumerate(map(float, b))), "class long, break double")


# ---- H


@query(f"SELECT fid, round(96 / 2 * (fid % 9 + 1) ** 2 * sin(2 * pi() / 96), 6) AS area FROM {S}")
def buffer_features(s, d):
    return shape(buffers.buffer_features(X.suppliers(s, d), "fid % 9 + 1"), "fid").select("fid", "area")


@query(f"SELECT fid, q AS distance, round(96 / 2 * sin(2 * pi() / 96) * (q * q - p * p), 6) AS area FROM {S}, (VALUES (0.0, 5.0), (5.0, 12.0)) r(p, q)")
def multiple_ring_buffer(s, d):
    return shape(buffers.multiple_ring_buffer(X.suppliers(s, d), [5, 12]), "fid", "distance").select("fid", "distance", "area")


@query(f"SELECT fid, round(sqrt(2500 + (fid % 40) ** 2) * 4, 4) AS area FROM {S}", 4)
def single_sided_buffer(s, d):
    return shape(buffers.single_sided_buffer(X.lines(s, d), "4"), "fid").select("fid", "area")


@query(f"SELECT fid, round(64 * 0.5 * (400 - 100) * sin(radians(60.0 / 64)), 4) AS area FROM {S}", 4)
def wedge_buffer(s, d):
    return shape(buffers.wedge_buffer(X.suppliers(s, d), "30", "60", "20", "10"), "fid").select("fid", "area")


@query()
def variable_buffer(s, d):
    return shape(buffers.variable_buffer(X.lines(s, d), "6", "2"), "fid")


# ---- I, J, K


@query(f"SELECT fid, (xmin + xmax) / 2 AS x, (ymin + ymax) / 2 AS y FROM {Z}")
def feature_to_point(s, d):
    return construct.feature_to_point(X.zones(s)).select("fid", "x", "y")


def _line_shape(sql_cols: str) -> str:
    return f"SELECT fid, {sql_cols} FROM {S}"


@query(_line_shape("(50 * (fid % 40))::double AS area, x AS xmin, y AS ymin"))
def envelope_to_polygon(s, d):
    return shape(construct.envelope_to_polygon(X.lines(s, d)), "fid").select("fid", "area", "xmin", "ymin")


@query(f"SELECT fid, 10404.0 AS area FROM {Z}")
def convex_hull(s, d):
    return shape(construct.convex_hull(X.zones(s)), "fid").select("fid", "area")


@query(f"SELECT fid, round(96 / 2 * 5202.0 * sin(2 * pi() / 96), 4) AS area FROM {Z}", 4)
def minimum_bounding_circle(s, d):
    return shape(construct.bounding_circle(X.zones(s)), "fid").select("fid", "area")


@query(f"SELECT fid, 10404.0 AS area FROM {Z}")
def minimum_rectangle(s, d):
    return shape(construct.minimum_rectangle(edit.rotate(X.zones(s), "0")), "fid").select("fid", "area")


@query(f"SELECT fid, 10404.0 AS area FROM {Z}")
def octagonal_envelope(s, d):
    return shape(construct.octagonal_envelope(X.zones(s)), "fid").select("fid", "area")


@query(f"SELECT fid, 102.0 AS width FROM {Z}", 1)
def maximum_inscribed_circle(s, d):
    return shape(construct.inscribed_circle(X.zones(s), tolerance=0.001), "fid").select("fid", (F.col("xmax") - F.col("xmin")).alias("width"))


@query(f"SELECT fid, 10404.0 AS area FROM {Z}")
def maximum_inscribed_rectangle(s, d):
    return shape(construct.inscribed_rectangle(X.zones(s)), "fid").select("fid", "area")


@query(f"SELECT c, (r + 1)::int AS part, 10404.0 AS area FROM {Z}")
def multipart_to_singlepart(s, d):
    m = aggregate.singlepart_to_multipart(X.zones(s), "c")
    return shape(construct.multipart_to_singlepart(m), "c", "part").select("c", "part", "area")


@query(f"WITH o AS (SELECT user_id, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM {T} WINDOW w AS (PARTITION BY user_id ORDER BY ts, fid)) SELECT user_id AS line, round(sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)), 4) AS geom_len FROM o GROUP BY user_id HAVING count(*) > 1", 4)
def points_to_line(s, d):
    return construct.points_to_line(X.tracks(s, d), "user_id", "ts").select("line", "geom_len")


@query(f"SELECT fid, 1 AS vertex, x, y FROM {S} UNION ALL SELECT fid, 2, x + 50, y + fid % 40 FROM {S}")
def vertices_to_points(s, d):
    return construct.vertices_to_points(X.lines(s, d)).select("fid", "vertex", "x", "y")


@query(f"SELECT fid, count(*) AS n FROM (SELECT fid, unnest(range(ceil(sqrt(2500 + (fid % 40) ** 2) / 7)::int + 1)) FROM {S}) GROUP BY fid")
def points_along_lines(s, d):
    return construct.points_along_lines(X.lines(s, d), "7").groupBy("fid").agg(F.count("*").alias("n"))


@query(f"SELECT fid, round(sqrt(2500 + (fid % 40) ** 2) * 4, 4) AS area FROM {S}", 4)
def polygons_along_lines(s, d):
    return shape(construct.polygons_along_lines(X.lines(s, d), "20", "4"), "fid").groupBy("fid").agg(F.sum("area").alias("area"))


@query()
def flow_map(s, d):
    return shape(construct.flow_map(X.lines(s, d), "v", "pop"), "fid", "direction", "value")


@query()
def concave_hull(s, d):
    return shape(construct.concave_hull(X.suppliers(s, d), alpha=0.5), "case")


@query("SELECT 1040400.0 AS area", 3)
def thiessen_polygon(s, d):
    square = [[[(0, 0), (1020, 0), (1020, 1020), (0, 1020), (0, 0)]]]
    return construct.thiessen(X.suppliers(s, d), clip=square).agg(F.sum(E.area(F.col("geom"))).alias("area"))


@query()
def delaunay_triangulation(s, d):
    return shape(construct.delaunay(X.suppliers(s, d)), "node0", "node1", "node2")


@query()
def feature_to_line(s, d):
    return construct.feature_to_line(X.zones(s)).groupBy("fid").agg(F.sum(E.length(F.col("geom"))).alias("len"), F.count("*").alias("n"))


@query("SELECT count(*) AS n, round(sum(10404.0), 3) AS area FROM range(100)", 3)
def feature_to_polygon(s, d):
    return construct.feature_to_polygon(X.zones(s)).agg(F.count("*").alias("n"), F.sum(E.area(F.col("geom"))).alias("area"))


@query()
def split_polygon_by_count(s, d):
    return shape(edit.split_polygon_by_count(X.zones(s), "4"), "fid", "part")


@query(f"SELECT fid, ceil(sqrt(2500 + (fid % 40) ** 2) / 20)::bigint AS n, round(sqrt(2500 + (fid % 40) ** 2), 6) AS len FROM {S}")
def split_line_by_distance(s, d):
    return edit.split_line_by_distance(X.lines(s, d), "20").groupBy("fid").agg(F.count("*").alias("n"), F.sum(E.length(F.col("geom"))).alias("len"))


@query(f"SELECT fid, k AS se_order, 102.0 AS len FROM {Z}, (VALUES (1), (2), (3), (4)) t(k)")
def split_line_at_vertices(s, d):
    return edit.split_line_at_vertices(X.zones(s)).select("fid", "se_order", E.length(F.col("geom")).alias("len"))


@query(f"SELECT fid, 2::bigint AS n FROM {S}")
def split_line_at_point(s, d):
    lines = X.lines(s, d).withColumn("geom", F.transform("geom", lambda p: F.transform(p, lambda r: F.transform(r, lambda v: F.struct(v.x.alias("x"), (v.y + F.col("fid") * 10000).alias("y"))))))
    mid = lines.select("fid", ((F.col("geom")[0][0][0].x + F.col("geom")[0][0][1].x) / 2).alias("x"), ((F.col("geom")[0][0][0].y + F.col("geom")[0][0][1].y) / 2).alias("y"))
    return edit.split_line_at_point(lines, mid, 0.01).groupBy("fid").agg(F.count("*").alias("n"))


@query(f"SELECT fid, x + fid AS x, y + 2 AS y FROM {S}")
def offset_features(s, d):
    return edit.offset(X.suppliers(s, d), "fid", "2").select("fid", "x", "y")


@query(f"SELECT fid, round(cos(radians(30)) * xmin + sin(radians(30)) * ymin, 6) AS x, round(cos(radians(30)) * ymin - sin(radians(30)) * xmin, 6) AS y FROM {Z}")
def rotate_features(s, d):
    p = F.col("geom")[0][0][0]
    return edit.rotate(X.zones(s), "30", (0.0, 0.0)).select("fid", p.x.alias("x"), p.y.alias("y"))


@query(f"SELECT fid, 10404.0 * 6 AS area FROM {Z}")
def scale_features(s, d):
    return shape(edit.scale(X.zones(s), "2", "3"), "fid").select("fid", "area")


@query()
def trim_line(s, d):
    return edit.trim_line(X.lines(s, d), 10.0).select("fid", E.length(F.col("geom")).alias("len"))


@query()
def extend_line(s, d):
    return edit.extend_line(X.lines(s, d), 15.0).select("fid", E.length(F.col("geom")).alias("len"))


@query("SELECT (i % 10 + 1) * 102.0 AS x, i // 10 * 102.0 + 51 AS y FROM range(90) t(i) WHERE i % 10 < 9 UNION ALL SELECT 918.0, 969.0 WHERE false", 6)
def intersection_points(s, d):
    across = s.range(10).select((F.col("id") + 1).alias("fid"), F.array(F.array(F.array(F.struct(F.lit(50.0).alias("x"), (F.col("id") * 102.0 + 51).alias("y")), F.struct(F.lit(970.0).alias("x"), (F.col("id") * 102.0 + 51).alias("y"))))).alias("geom"))
    return edit.intersection_points(across, X.zones(s)).select("x", "y").where("y < 918")


@query(f"SELECT fid, 3::bigint AS n FROM {S}")
def simplify(s, d):
    lines = X.lines(s, d)
    bent = edit.densify(lines.withColumn("geom", F.array(F.array(F.concat(F.col("geom")[0][0], F.array(F.struct((F.col("geom")[0][0][1].x).alias("x"), (F.col("geom")[0][0][1].y + 500).alias("y"))))))), "10")
    return edit.simplify(bent, "1.0").select("fid", F.size(F.col("geom")[0][0]).cast("long").alias("n"))


@query(f"SELECT fid, 10404.0 AS area FROM {Z}")
def simplify_polygon(s, d):
    return shape(edit.simplify_polygon(edit.densify(X.zones(s), "20"), 1.0), "fid").select("fid", "area")


@query(f"SELECT fid, 4 * 11 + 1 AS n FROM {Z}")
def densify(s, d):
    return edit.densify(X.zones(s), "10").select("fid", F.size(F.col("geom")[0][0]).alias("n"))


@query()
def smooth(s, d):
    return shape(edit.smooth(X.zones(s)), "fid")


def _holed(s):
    hole = lambda k: F.array(*[F.struct((F.col("xmin") + a).alias("x"), (F.col("ymin") + b).alias("y")) for a, b in ((10, 10), (10, 10 + k), (10 + k, 10 + k), (10 + k, 10), (10, 10))])
    return X.zones(s).withColumn("geom", F.array(F.array(F.col("geom")[0][0], hole(20))))


@query(f"SELECT fid, 10404.0 - CASE WHEN fid % 2 = 0 THEN 400 ELSE 0 END AS area FROM {Z}")
def remove_holes(s, d):
    return shape(edit.remove_holes(_holed(s), "if(fid % 2 = 0, 100, 500)"), "fid").select("fid", "area")


@query(f"SELECT fid, CASE WHEN fid % 2 = 0 THEN 10404.0 + 25 ELSE 10404.0 END AS area FROM {Z}")
def remove_parts(s, d):
    two = X.zones(s).withColumn("geom", F.concat("geom", E.rectangle(F.col("xmin") + 5000, F.col("ymin"), F.col("xmin") + 5005, F.col("ymin") + 5)))
    return shape(edit.remove_parts(two, "if(fid % 2 = 0, 10, 50)"), "fid").select("fid", "area")


@query(f"SELECT fid, x + 50 AS x, y + fid % 40 AS y FROM {S}")
def flip_line(s, d):
    p = F.col("geom")[0][0][0]
    return edit.flip_line(X.lines(s, d)).select("fid", p.x.alias("x"), p.y.alias("y"))


@query("SELECT 1040400.0 AS area", 3)
def eliminate(s, d):
    z = X.zones(s).where("fid <> 45")
    return edit.eliminate(z, "Length").agg(F.sum(E.area(F.col("geom"))).alias("area"))


@query(f"SELECT fid, 10404.0 AS area FROM {Z}")
def repair_geometry(s, d):
    twice = X.zones(s).withColumn("geom", F.transform("geom", lambda p: F.transform(p, lambda r: F.flatten(F.transform(r, lambda v: F.array(v, v))))))
    return shape(edit.repair(twice), "fid").select("fid", "area")


_SHIFT = 30.0


def _moved(s):
    return edit.offset(X.zones(s).select("fid", (F.col("v") * 2).alias("v2"), "geom"), str(_SHIFT), str(_SHIFT))


_IX = f"SELECT a.fid, b.fid AS fid_1, (least(a.xmax, b.xmax + 30) - greatest(a.xmin, b.xmin + 30)) * (least(a.ymax, b.ymax + 30) - greatest(a.ymin, b.ymin + 30)) AS area FROM {Z} a, {Z} b WHERE least(a.xmax, b.xmax + 30) > greatest(a.xmin, b.xmin + 30) AND least(a.ymax, b.ymax + 30) > greatest(a.ymin, b.ymin + 30)"
_DIFF = f"SELECT fid, 10404.0 - (SELECT sum(area) FROM ({_IX}) i WHERE i.fid = z.fid) AS area FROM {Z} z WHERE c = 0 OR r = 0"


@query(_IX)
def intersect(s, d):
    return shape(overlay.intersect(X.zones(s), _moved(s)), "fid", "fid_1").select("fid", "fid_1", "area")


@query(_DIFF)
def difference(s, d):
    return shape(overlay.difference(X.zones(s), _moved(s)), "fid").select("fid", "area")


@query(f"SELECT round(2 * (1040400.0 - 990.0 * 990.0), 3) AS area", 3)
def sym_difference(s, d):
    return overlay.sym_difference(X.zones(s), _moved(s)).agg(F.sum(E.area(F.col("geom"))).alias("area"))


@query("SELECT 1040400.0 * 2 - 990.0 * 990.0 AS area", 3)
def update(s, d):
    return overlay.update(X.zones(s), _moved(s)).agg(F.sum(E.area(F.col("geom"))).alias("area"))


@query("SELECT 1040400.0 * 2 - 990.0 * 990.0 AS area", 3)
def union_overlay(s, d):
    return overlay.union(X.zones(s), _moved(s)).agg(F.sum(E.area(F.col("geom"))).alias("area"))


@query("SELECT 1040400.0 AS area", 3)
def identity(s, d):
    return overlay.identity(X.zones(s), _moved(s)).agg(F.sum(E.area(F.col("geom"))).alias("area"))


_SQ = [[[(50, 50), (555, 50), (555, 555), (50, 555), (50, 50)]]]


@query(f"SELECT fid, (least(xmax, 555) - greatest(xmin, 50)) * (least(ymax, 555) - greatest(ymin, 50)) AS area FROM {Z} WHERE xmin < 555 AND xmax > 50 AND ymin < 555 AND ymax > 50")
def clip_with_geometry(s, d):
    return shape(overlay.clip_with_geometry(X.zones(s), _SQ), "fid").select("fid", "area")


@query(f"SELECT fid, area FROM ({_IX})")
def clip_with_features(s, d):
    return shape(overlay.clip_with_features(X.zones(s), _moved(s)), "fid").select("fid", "area")


# ---- L to P

RA, RB = X.raster_sql("a"), X.raster_sql("b")


def _cells(r) -> DataFrame:
    return r.cells.select("row", "col", "value")


def _window_sql(value: str, z: str = "1") -> str:
    names = {"a": (-1, -1), "b": (-1, 0), "c": (-1, 1), "d": (0, -1), "f": (0, 1), "g": (1, -1), "h": (1, 0), "i": (1, 1)}
    joins_ = " ".join(f"LEFT JOIN q n{k} ON n{k}.row = q.row + {dr} AND n{k}.col = q.col + {dc}" for k, (dr, dc) in names.items())
    cols = ", ".join(f"coalesce(n{k}.value, q.value) AS {k}" for k in names)
    return f"WITH q AS (SELECT * FROM {RA}), w AS (SELECT q.row, q.col, q.value AS e, {cols} FROM q {joins_}), gr AS (SELECT *, ((c + 2 * f + i) - (a + 2 * d + g)) / 80.0 AS gx, ((g + 2 * h + i) - (a + 2 * b + c)) / 80.0 AS gy FROM w) SELECT row, col, CASE WHEN e IS NOT NULL THEN round({value}, 6) + 0.0 END AS value FROM gr"


@query(_window_sql("CASE WHEN degrees(atan(sqrt(gx * gx + gy * gy))) <= 100 THEN degrees(atan(sqrt(gx * gx + gy * gy))) END"))
def raster_slope(s, d):
    return _cells(raster.slope(X.raster(s)))


@query(_window_sql("CASE WHEN gx = 0 AND gy = 0 THEN -1 WHEN degrees(atan2(gy, -gx)) > 90 THEN 450 - degrees(atan2(gy, -gx)) ELSE 90 - degrees(atan2(gy, -gx)) END"))
def raster_aspect(s, d):
    return _cells(raster.aspect(X.raster(s)))


@query(_window_sql("least(greatest(255.0 * (cos(radians(45)) * cos(atan(sqrt(gx * gx + gy * gy))) + sin(radians(45)) * sin(atan(sqrt(gx * gx + gy * gy))) * cos(radians(135) - atan2(gy, -gx))), 0), 255)"))
def raster_hillshade(s, d):
    return _cells(raster.hillshade(X.raster(s)))


@query(_window_sql("e - (a + b + c + d + f + g + h + i) / 8.0"))
def raster_tpi(s, d):
    return _cells(raster.tpi(X.raster(s)))


@query(_window_sql("(abs(a - e) + abs(b - e) + abs(c - e) + abs(d - e) + abs(f - e) + abs(g - e) + abs(h - e) + abs(i - e)) / 8.0"))
def raster_tri(s, d):
    return _cells(raster.tri(X.raster(s)))


@query(_window_sql("greatest(a, b, c, d, e, f, g, h, i) - least(a, b, c, d, e, f, g, h, i)"))
def raster_roughness(s, d):
    return _cells(raster.roughness(X.raster(s)))


@query(_window_sql("CASE WHEN f = d AND b = h THEN 0 ELSE -2 * (((d + f) / 2 - e) / 100.0 + ((b + h) / 2 - e) / 100.0) * 100 END"))
def raster_curvature(s, d):
    return _cells(raster.curvature(X.raster(s)))


@query(_window_sql("list_extract([32, 64, 128, 16, 1, 8, 4, 2], list_position([(e - a) / (100 * sqrt(2)), (e - b) / 100, (e - c) / (100 * sqrt(2)), (e - d) / 100, (e - f) / 100, (e - g) / (100 * sqrt(2)), (e - h) / 100, (e - i) / (100 * sqrt(2))], greatest((e - a) / (100 * sqrt(2)), (e - b) / 100, (e - c) / (100 * sqrt(2)), (e - d) / 100, (e - f) / 100, (e - g) / (100 * sqrt(2)), (e - h) / 100, (e - i) / (100 * sqrt(2)))))"))
def raster_flow_direction(s, d):
    return _cells(raster.flow_direction(X.raster(s)))


@query(f"SELECT row, col, CASE WHEN value IS NOT NULL THEN CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END END AS value FROM {RA}")
def raster_con(s, d):
    return _cells(raster.con(X.raster(s), "value > 50", 1, 0))


@query(f"SELECT row, col, CASE WHEN value IS NULL THEN -1 WHEN value < 10 THEN NULL ELSE value END AS value FROM {RA}")
def raster_set_null(s, d):
    return _cells(raster.set_null(X.raster(s), "value < 10", True, -1.0))


@query(f"SELECT row, col, CASE WHEN value >= 0 AND value < 30 + 1e-8 THEN 1.0 WHEN value >= 30 AND value < 60 + 1e-8 THEN 2.0 END AS value FROM {RA}")
def raster_reclass(s, d):
    return _cells(raster.reclass(X.raster(s), "0 30 1; 30 60 2", False))


@query(f"SELECT row, col, CASE WHEN value = 50 THEN NULL ELSE round(value * 2 / (value - 50), 6) + 0.0 END AS value FROM {RA}")
def raster_math(s, d):
    return _cells(raster.calculate(X.raster(s), "try_divide(value * 2, value - 50)"))


@query(f"SELECT row, col, CASE WHEN value BETWEEN 20 AND 40 THEN value END AS value FROM {RA}")
def raster_extraction(s, d):
    return _cells(raster.extract(X.raster(s), "value between 20 and 40"))


@query(f"SELECT row, col, CASE WHEN col * 10 + 5 BETWEEN 100 AND 300 AND 1200 - row * 10 - 5 BETWEEN 200 AND 500 THEN 7.0 ELSE value END AS value FROM {RA}")
def raster_replace_values(s, d):
    return _cells(raster.replace_values(X.raster(s), (100.0, 200.0, 300.0, 500.0), 7.0))


@query(f"SELECT a.row, a.col, CASE WHEN a.value + b.value <> 0 THEN round((a.value - b.value) / (a.value + b.value), 6) + 0.0 END AS value FROM {RA} a JOIN {RB} b ON a.row = b.row AND a.col = b.col")
def raster_ndvi(s, d):
    return _cells(raster.ndvi(X.raster(s), X.raster(s, kind="b")))


@query(f"SELECT value, count(*) AS frequency FROM {RA} WHERE value IS NOT NULL GROUP BY value")
def raster_histogram(s, d):
    return raster.histogram(X.raster(s))


@query(f"SELECT count(value) AS count, sum(value) AS sum, round(var_pop(value), 6) AS variance FROM {RA}")
def raster_statistics(s, d):
    return raster.statistics(X.raster(s)).select("count", "sum", "variance")


@query(f"SELECT 0 AS band, count(value) AS count, min(value) AS min, max(value) AS max, 120 AS ncols, 1200.0 AS maxx FROM {RA}")
def raster_describe(s, d):
    return raster.describe(X.raster(s), True).select("band", "count", "min", "max", "ncols", "maxx")


@query(f"SELECT row - 20 AS row, col - 10 AS col, value FROM {RA} WHERE row BETWEEN 20 AND 69 AND col BETWEEN 10 AND 39")
def raster_clip_extent(s, d):
    return _cells(raster.clip(X.raster(s), (100.0, 500.0, 400.0, 1000.0)))


@query(f"SELECT row, col, CASE WHEN col * 10 + 5 BETWEEN 50 AND 555 AND 1200 - row * 10 - 5 BETWEEN 50 AND 555 THEN value END AS value FROM {RA}")
def raster_clip_geometry(s, d):
    return _cells(raster.clip(X.raster(s), _SQ))


@query(f"SELECT row, col, CASE WHEN sqrt((col * 10 + 5 - 600) ** 2 + (1200 - row * 10 - 5 - 600) ** 2) <= 300 THEN value END AS value FROM {RA}")
def raster_clip_circle(s, d):
    return _cells(raster.clip_circle(X.raster(s), 600, 600, 300))


@query(f"SELECT row, col, CASE WHEN col * 10 + 5 < 1020 AND 1200 - row * 10 - 5 < 1020 THEN value END AS value FROM {RA}")
def raster_clip_features(s, d):
    return _cells(raster.clip_features(X.raster(s), X.zones(s)))


@query(f"WITH q AS (SELECT value - (SELECT avg(value) FROM {RA}) AS diff FROM {RA}) SELECT sign(diff)::int AS flag, count(*) * 100.0 AS area, round(sum(abs(diff) * 100), 3) AS volume, count(*) AS count FROM q WHERE diff IS NOT NULL GROUP BY 1", 3)
def raster_cut_fill(s, d):
    return raster.cut_fill(X.raster(s))


@query(f"SELECT sign(a.value - b.value)::int AS flag, count(*) * 100.0 AS area, sum(abs(a.value - b.value) * 100) AS volume, count(*) AS count FROM {RA} a JOIN {RB} b ON a.row = b.row AND a.col = b.col WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1")
def raster_cut_fill_between(s, d):
    return raster.cut_fill_between(X.raster(s), X.raster(s, kind="b"))


@query(f"SELECT sign(a.value - b.value)::int AS flag, count(*) * 100.0 AS area, sum(abs(a.value - b.value) * 100) AS volume, count(*) AS count FROM {RA} a JOIN {RB} b ON a.row = b.row AND a.col = b.col WHERE a.value IS NOT NULL AND b.value IS NOT NULL AND (a.value > 50 OR b.value > 50) GROUP BY 1")
def raster_cut_fill_above(s, d):
    return raster.cut_fill_between(X.raster(s), X.raster(s, kind="b"), base_height=50.0)


@query(f"WITH q AS (SELECT * FROM {RA}), w AS (SELECT a.value AS a, b.value AS b, c.value AS c, e.value AS e FROM q a JOIN q b ON b.row = a.row AND b.col = a.col + 1 JOIN q c ON c.row = a.row + 1 AND c.col = a.col JOIN q e ON e.row = a.row + 1 AND e.col = a.col + 1) SELECT round(sum(0.5 * sqrt(((b - a) * 10) ** 2 + ((c - a) * 10) ** 2 + 10000) + 0.5 * sqrt(((e - c) * 10) ** 2 + ((e - b) * 10) ** 2 + 10000)), 2) AS surface_area, count(*) * 100.0 AS planar_area FROM w WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL AND e IS NOT NULL", 2)
def raster_surface_area(s, d):
    return raster.surface_area(X.raster(s))


@query(f"WITH p AS (SELECT i::int AS step, 15.0 + i * 11.0 AS x, 1195.0 - i * 9.5 AS y FROM range(101) t(i)) SELECT step, value AS z FROM p JOIN {RA} r ON r.col = floor(x / 10) AND r.row = floor((1200 - y) / 10) WHERE value IS NOT NULL")
def raster_profile(s, d):
    n = math.hypot(1100, 950) / 100
    return raster.profile(X.raster(s), [(15.0, 1195.0), (1115.0, 245.0)], n * 1.0000001).select("step", "z")


@query()
def raster_radial_los(s, d):
    return raster.radial_line_of_sight(X.raster(s), (605.0, 605.0), 400.0, 36).groupBy("ray", "angle").agg(F.sum("visible").alias("visible"), F.count("*").alias("steps"))


@query()
def raster_linear_los(s, d):
    return raster.linear_line_of_sight(X.raster(s), (55.0, 55.0), (1105.0, 905.0)).select("step", "distance", "visible")


@query(f"SELECT row, col, value FROM (SELECT i::int // 60 AS row, i::int % 60 AS col FROM range(3600) t(i)) g JOIN (SELECT row AS r, col AS c, value FROM {RA}) q ON q.r = g.row * 2 + 1 AND q.c = g.col * 2 + 1")
def raster_resample(s, d):
    return _cells(raster.resample(X.raster(s), 20.0))


@query()
def raster_resample_bilinear(s, d):
    return _cells(raster.resample(X.raster(s), 7.0, "BILINEAR"))


@query(f"SELECT sign(value - 50)::int AS flag, count(*) * 100.0 AS area FROM {RA} WHERE value IS NOT NULL GROUP BY 1")
def raster_cut_fill_regions(s, d):
    found = raster.cut_fill_regions(X.raster(s), base_height=50.0)
    return found.groupBy("flag").agg(F.sum(E.area(F.col("geom"))).alias("area"))


@query()
def raster_reproject(s, d):
    from dataclasses import replace

    r = X.raster(s)
    r = replace(r, meta=replace(r.meta, minx=10.0, miny=40.0, dx=0.01, dy=0.01, crs="EPSG:4326"))
    return _cells(raster.reproject(r, "EPSG:3857"))


@query(f"SELECT row, col, value FROM {RA}")
def raster_force_crs(s, d):
    return _cells(raster.force_crs(X.raster(s), "EPSG:5186"))


@query(f"SELECT 119 - row AS row, col, value FROM {RA}")
def raster_flip(s, d):
    return _cells(raster.flip(X.raster(s)))


@query(f"SELECT row, 119 - col AS col, value FROM {RA}")
def raster_mirror(s, d):
    return _cells(raster.mirror(X.raster(s)))


@query("SELECT 0 AS band, 120 AS ncols, 20.0 AS dx, 30.0 AS dy")
def raster_rescale(s, d):
    return raster.describe(raster.rescale(X.raster(s), 2, 3)).select("band", "ncols", "dx", "dy")


@query(f"SELECT col AS row, 119 - row AS col, value FROM {RA}")
def raster_rotate(s, d):
    return _cells(raster.rotate(X.raster(s), 90.0))


@query("SELECT 0 AS band, 5.0 AS minx, -7.0 AS miny")
def raster_shift(s, d):
    return raster.describe(raster.shift(X.raster(s), 5, -7)).select("band", "minx", "miny")


@query(f"SELECT row, col, greatest(0.0, least(1.0, (value - 20) / 60.0)) AS value FROM {RA}")
def raster_fuzzy(s, d):
    return _cells(raster.fuzzy(X.raster(s), [20.0, 80.0]))


@query(f"SELECT a.row, a.col, CASE WHEN b.value IS NOT NULL THEN a.value END AS value FROM {RA} a JOIN (SELECT row, col, CASE WHEN value > 30 THEN value END AS value FROM {RB}) b ON a.row = b.row AND a.col = b.col")
def raster_extract_by_mask(s, d):
    return _cells(raster.extract_by_mask(X.raster(s), raster.extract(X.raster(s, kind="b"), "value > 30")))


@query(f"SELECT row, col, value FROM {RA} WHERE value = (SELECT max(value) FROM {RA})")
def raster_high_low_points(s, d):
    return raster.high_low_points(X.raster(s)).select("row", "col", "value")


@query(f"SELECT row::bigint * 120 + col + 1 AS fid, col * 10 + 5.0 AS x, 1200 - row * 10 - 5.0 AS y, value FROM {RA} WHERE value IS NOT NULL")
def raster_to_point(s, d):
    return rastervec.to_points(X.raster(s))


@query(f"SELECT row::bigint * 120 + col + 1 AS fid, 100.0 AS area, value FROM {RA} WHERE value IS NOT NULL")
def raster_to_grid_polygon(s, d):
    return rastervec.to_grid_polygons(X.raster(s)).select("fid", E.area(F.col("geom")).alias("area"), "value")


@query("SELECT value, sum(n) * 100.0 AS area FROM (SELECT floor(value / 50) AS value, count(*) AS n FROM " + X.raster_sql("a", 60) + " WHERE value IS NOT NULL GROUP BY 1) GROUP BY value")
def raster_to_polygon(s, d):
    r = raster.calculate(X.raster(s, 60), "floor(value / 50)")
    return rastervec.to_polygons(r).groupBy("value").agg(F.sum(E.area(F.col("geom"))).alias("area"))


@query(f"SELECT fid, value AS rasterval FROM {S} s LEFT JOIN {RA} r ON r.col = floor(x / 10) AND r.row = least(floor((1200 - y) / 10), 119)")
def extract_values_to_points(s, d):
    return rastervec.extract_values(X.suppliers(s, d), X.raster(s)).select("fid", "rasterval")


@query(f"SELECT row, col, (CASE WHEN (col + 0.5) * 17 < 1020 THEN (floor((119 - row + 0.5) * 8.5 / 102) * 10 + floor((col + 0.5) * 8.5 / 102)) END) + 1.0 AS value FROM (SELECT (i // 120)::int AS row, (i % 120)::int AS col FROM range(14400) t(i))".replace("CASE WHEN (col + 0.5) * 17 < 1020 THEN ", "").replace(" END) + 1.0", ") + 1.0"))
def features_to_raster(s, d):
    return _cells(rastervec.features_to_raster(X.zones(s), None, 8.5))


@query(f"SELECT g.row, g.col, round(q.value, 4) AS value FROM (SELECT (i // 102)::int AS row, (i % 102)::int AS col FROM range(10404) t(i)) g LEFT JOIN (SELECT floor((1020 - y) / 10)::int AS row, floor(x / 10)::int AS col, sum(w) AS value FROM (SELECT * FROM {C} WHERE y > 0) GROUP BY 1, 2) q ON g.row = q.row AND g.col = q.col", 4)
def points_to_raster(s, d):
    return _cells(rastervec.points_to_raster(X.customers(s, d).where("y > 0"), "w", "Sum", 10.0, X.EXTENT))


@query("SELECT row, col, CASE WHEN col * 10 + 5 BETWEEN 50 AND 550 AND 1000 - row * 10 - 5 BETWEEN 50 AND 550 THEN 3.0 END AS value FROM (SELECT (i // 100)::int AS row, (i % 100)::int AS col FROM range(10000) t(i))")
def geometry_to_raster(s, d):
    g = [[[(50, 50), (550, 50), (550, 550), (50, 550), (50, 50)]]]
    return _cells(rastervec.geometry_to_raster(s, g, 3.0, 10.0, (0.0, 0.0, 1000.0, 1000.0)))


@query(f"SELECT z.fid, {r6('avg(q.value)', 'val')}, count(q.value) * 100.0 AS area FROM {Z} z JOIN (SELECT col * 10 + 5 AS x, 1200 - row * 10 - 5 AS y, value FROM {RA}) q ON q.x > z.xmin AND q.x < z.xmax AND q.y > z.ymin AND q.y < z.ymax GROUP BY z.fid")
def zonal_statistics(s, d):
    return rastervec.zonal_statistics(X.zones(s), X.raster(s)).select("fid", "val", "area")


_KD = f"""WITH k AS (SELECT a.i AS dx, b.i AS dy, 3 * (1 - (a.i * a.i + b.i * b.i) / 16.0) ** 2 AS k FROM (SELECT unnest(range(-4, 5)) AS i) a, (SELECT unnest(range(-4, 5)) AS i) b WHERE a.i * a.i + b.i * b.i < 16),
 p AS (SELECT floor(x / 10)::int AS c, CASE WHEN y = 0 THEN 101 ELSE floor((1020 - y) / 10)::int END AS r, sum(w) AS w FROM {C} GROUP BY 1, 2), v AS (SELECT r + dy AS row, c + dx AS col, sum(w * k) / ((SELECT count(*) FROM k) * 100 / 1e6) AS value FROM p, k GROUP BY 1, 2)
 SELECT g.row, g.col, round(coalesce(v.value, 0), 6) + 0.0 AS value FROM (SELECT (i // 102)::int AS row, (i % 102)::int AS col FROM range(10404) t(i)) g LEFT JOIN v ON v.row = g.row AND v.col = g.col"""


@query(_KD)
def kernel_density(s, d):
    return _cells(surface.kernel_density(X.customers(s, d), population="w", radius=40.0, cell=10.0, extent=X.EXTENT))


@query(_KD.replace("3 * (1 - (a.i * a.i + b.i * b.i) / 16.0) ** 2", "1.0").replace("< 16)", "<= 16)"))
def point_density(s, d):
    return _cells(surface.point_density(X.customers(s, d), "w", ("circle", 4), 10.0, X.EXTENT))


@query()
def line_density(s, d):
    return _cells(surface.line_density(X.lines(s, d), radius=60.0, cell=20.0, extent=(0.0, 0.0, 1060.0, 1060.0)))


_GRID = "(SELECT (i // 51)::int AS row, (i % 51)::int AS col, (i % 51 + 0.5) * 20 AS x, 1020 - (i // 51 + 0.5) * 20 AS y FROM range(2601) t(i))"


@query(f"SELECT row, col, round(min(sqrt((g.x - s.x) ** 2 + (g.y - s.y) ** 2)), 6) AS value FROM {_GRID} g, {S} s GROUP BY row, col")
def euclidean_distance(s, d):
    return _cells(surface.euclidean_distance(X.suppliers(s, d), cell=20.0, extent=X.EXTENT))


@query(f"WITH p AS (SELECT row, col, s.v, (g.x - s.x) ** 2 + (g.y - s.y) ** 2 AS d2 FROM {_GRID} g, {S} s WHERE (g.x - s.x) ** 2 + (g.y - s.y) ** 2 <= 22500) SELECT g.row, g.col, q.value FROM {_GRID} g LEFT JOIN (SELECT row, col, round(coalesce(avg(v) FILTER (d2 = 0), sum(v / d2) FILTER (d2 > 0) / sum(1 / d2) FILTER (d2 > 0)), 4) AS value FROM p GROUP BY row, col) q ON g.row = q.row AND g.col = q.col", 4)
def idw(s, d):
    return _cells(surface.idw(X.suppliers(s, d), "v", 2.0, "Fixed", distance=150.0, cell=20.0, extent=X.EXTENT))


@query(f"SELECT row, col, round(3 * x - 2 * y + 5, 2) AS value FROM {_GRID}", 2)
def thin_plate_spline(s, d):
    return _cells(surface.thin_plate_spline(X.suppliers(s, d).withColumn("z", 3 * F.col("x") - 2 * F.col("y") + 5), "z", 20.0, X.EXTENT))


@query()
def tin_interpolation(s, d):
    return _cells(surface.tin(X.suppliers(s, d), "v", 20.0, X.EXTENT))
