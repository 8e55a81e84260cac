"""Global and local spatial autocorrelation over a table of weighted pairs.

Every statistic is a formula over sums per feature (one aggregation of the pairs) and one row of
moments.  Expectation and variance of Lee's S and L are 0 by definition here, local values are
rounded to 8 decimals, and an undefined z gives index 0, z 0 and p 1.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import finite, zprob
from ..plans import dense
from ..plans import weights as W


def safe(sql: str) -> str:
    """Every divisor as nullif(divisor, 0), so that ANSI mode gives null where a statistic is undefined."""
    out, i = "", 0
    while i < len(sql):
        if sql[i] != "/":
            out += sql[i]
            i += 1
            continue
        j = i + 1
        while sql[j] == " ":
            j += 1
        k = j
        while k < len(sql) and (sql[k].isalnum() or sql[k] in "_."):
            k += 1
        if k < len(sql) and sql[k] == "(":
            depth = 0
            while True:
                depth += {"(": 1, ")": -1}.get(sql[k], 0)
                k += 1
                if not depth:
                    break
        out += f"/ nullif({safe(sql[j:k])}, 0)"
        i = k
    return out


def _moments(ev: DataFrame) -> DataFrame:
    first = ev.agg(F.count("*").cast("double").alias("n"), F.sum("xv").alias("sx"), F.sum("yv").alias("sy"), F.sum(F.pow("xv", F.lit(2))).alias("sx2"), F.sum(F.pow("xv", F.lit(3))).alias("sx3"), F.sum(F.pow("xv", F.lit(4))).alias("sx4"))
    first = first.withColumn("mx", F.try_divide("sx", "n")).withColumn("my", F.try_divide("sy", "n"))
    z, y = F.col("xv") - F.col("mx"), F.col("yv") - F.col("my")
    second = ev.select("xv", "yv").crossJoin(F.broadcast(first.select("mx", "my"))).agg(F.sum(z * z).alias("z2"), F.sum(z * z * z * z).alias("z4"), F.sum(y * y).alias("y2"))
    return first.crossJoin(second)


def _sums(ev: DataFrame, p: DataFrame | dict, how: str) -> DataFrame:
    """Sums per feature; features without neighbours get zeros.  ``p``: pairs, or a concept that gives all pairs a weight."""
    s = W.dense_sums(ev, how, **p) if isinstance(p, dict) else _pair_sums(W.standardized(p, how))
    return ev.select("id", "xv", "yv").join(s, "id", "left").na.fill(0.0, ["sw", "swji", "sw2", "s1", "swx", "swy", "swd", "raw"]).na.fill(0, ["nn"])


def _pair_sums(p: DataFrame) -> DataFrame:
    d = F.col("xv") - F.col("xv2")
    return p.groupBy("id").agg(
        F.sum("wij").alias("sw"), F.sum("wji").alias("swji"), F.sum(F.col("wij") * F.col("wij")).alias("sw2"), F.sum(F.when(F.col("wij") != 0, F.pow(F.col("wij") + F.col("wji"), F.lit(2)))).alias("s1"),
        F.sum(F.col("wij") * F.col("xv2")).alias("swx"), F.sum(F.col("wij") * F.col("yv2")).alias("swy"), F.sum(F.col("wij") * d * d).alias("swd"), F.sum(F.when(F.col("wij") > 0, 1).otherwise(0)).alias("nn"), F.sum("w").alias("raw"),
    )


def _totals(ev: DataFrame, p: DataFrame | dict, how: str) -> DataFrame:
    s = _sums(ev, p, how).crossJoin(F.broadcast(_moments(ev)))
    zx, zy = F.col("swx") - F.col("mx") * F.col("sw"), F.col("swy") - F.col("my") * F.col("sw")
    first = [F.first(c).alias(c) for c in ("n", "sx", "sx2", "sx3", "sx4", "z2", "z4", "y2")]
    return s.agg(
        *first, F.sum("sw").alias("w"), (F.sum("s1") * 0.5).alias("S1"), F.sum(F.pow(F.col("sw") + F.col("swji"), F.lit(2))).alias("S2"), F.sum((F.col("xv") - F.col("mx")) * zx).alias("zw"), F.sum(F.col("xv") * F.col("swx")).alias("np"),
        F.sum("swd").alias("cw"), F.sum(F.col("sw") * F.col("sw")).alias("w2"), F.sum(zx * zx).alias("zx2"), F.sum(F.abs(zx * zy)).alias("zxy"),
    )


def _result(t: DataFrame, observed: str, expected: str, variance: str) -> DataFrame:
    out = t.select(F.coalesce(F.expr(safe(observed)).cast("double"), F.lit(0.0)).alias("observed"), F.coalesce(F.expr(safe(expected)).cast("double"), F.lit(0.0)).alias("expected"), F.coalesce(F.expr(safe(variance)).cast("double"), F.lit(0.0)).alias("variance"))
    out = out.withColumn("z_score", F.when(F.col("variance") > 0, (F.col("observed") - F.col("expected")) / F.sqrt("variance")).otherwise(0.0))
    return out.withColumn("p_value", zprob("z_score"))


def _pairs(df, field, y_field, concept, method, band, k, self_neighbors, contiguity, fid):
    ev = W.events(df, field, y_field, fid)
    if concept in W.WITHOUT_BAND:
        return ev, {"concept": concept, "method": method, "self_neighbors": self_neighbors}
    return ev, W.pairs(ev, concept, method, band, k, self_neighbors, contiguity)


def global_morans_i(df, field, concept="InverseDistance", method="Euclidean", standardization="None", band=0.0, k=8, contiguity=None, fid="id") -> DataFrame:
    ev, p = _pairs(df, field, None, concept, method, band, k, False, contiguity, fid)
    t = _totals(ev, p, standardization)
    b2 = "((z4 / n) / ((z2 / n) * (z2 / n)))"
    a = "n * ((n * n - 3 * n + 3) * S1 - n * S2 + 3 * w * w)"
    b = f"{b2} * ((n * n - n) * S1 - 2 * n * S2 + 6 * w * w)"
    c = "((n - 1) * (n - 2) * (n - 3) * w * w)"
    return _result(t, "CASE WHEN w > 0 THEN zw / ((z2 / n) * w) ELSE 0 END", "-1 / (n - 1)", f"CASE WHEN w > 0 THEN ({a} - {b}) / {c} - 1 / ((n - 1) * (n - 1)) ELSE 0 END")


def global_g(df, field, concept="InverseDistance", method="Euclidean", standardization="None", band=0.0, k=8, contiguity=None, fid="id") -> DataFrame:
    ev, p = _pairs(df, field, None, concept, method, band, k, False, contiguity, fid)
    b0 = "((n * n - 3 * n + 3) * S1 - n * S2 + 3 * w * w)"
    b1 = "(-1 * ((n * n - n) * S1 - 2 * n * S2 + 6 * w * w))"
    b2 = "(-1 * (2 * n * S1 - (n + 3) * S2 + 6 * w * w))"
    b3 = "(4 * (n - 1) * S1 - 2 * (n + 1) * S2 + 8 * w * w)"
    b4 = "(S1 - S2 + w * w)"
    e = "(w / (n * (n - 1)))"
    v = f"({b0} * sx2 * sx2 + {b1} * sx4 + {b2} * sx * sx * sx2 + {b3} * sx * sx3 + {b4} * power(sx, 4)) / (power(sx * sx - sx2, 2) * n * (n - 1) * (n - 2) * (n - 3)) - {e} * {e}"
    return _result(_totals(ev, p, standardization), "CASE WHEN sx * sx - sx2 > 0 THEN np / (sx * sx - sx2) ELSE 0 END", e, v)


def global_gearys_c(df, field, concept="InverseDistance", method="Euclidean", standardization="None", band=0.0, k=8, contiguity=None, fid="id") -> DataFrame:
    ev, p = _pairs(df, field, None, concept, method, band, k, False, contiguity, fid)
    m2, b2, div = "(z2 / (n - 1))", "((z4 / (n - 1)) / power(z2 / (n - 1), 2))", "(n * (n - 2) * (n - 3))"
    a = f"(n - 1) * S1 * (n * n - 3 * n + 3 - (n - 1) * {b2}) / ({div} * w * w)"
    b = f"(n - 1) * S2 * (n * n + 3 * n - 6 - (n * n - n + 2) * {b2}) / (4 * {div} * w * w)"
    c = f"(n * n - 3 - (n - 1) * (n - 1) * {b2}) / {div}"
    return _result(_totals(ev, p, standardization), f"CASE WHEN w > 0 THEN cw / (2 * {m2} * w) ELSE 0 END", "1.0", f"CASE WHEN w > 0 THEN {a} - {b} + {c} ELSE 0 END")


def global_lees_s(df, field, concept="InverseDistance", method="Euclidean", standardization="None", band=0.0, self_neighbors=False, k=8, contiguity=None, fid="id") -> DataFrame:
    ev, p = _pairs(df, field, None, concept, method, band, k, self_neighbors, contiguity, fid)
    return _result(_totals(ev, p, standardization), "CASE WHEN w > 0 THEN (n / w2) * (zx2 / z2) ELSE 0 END", "0.0", "0.0")


def global_lees_l(df, x_field, y_field, concept="InverseDistance", method="Euclidean", standardization="None", band=0.0, self_neighbors=True, k=8, contiguity=None, fid="id") -> DataFrame:
    ev, p = _pairs(df, x_field, y_field, concept, method, band, k, self_neighbors, contiguity, fid)
    return _result(_totals(ev, p, standardization), "CASE WHEN w <> 0 THEN (n / w2) * (zxy / (sqrt(z2) * sqrt(y2))) ELSE 0 END", "0.0", "0.0")


def _shares(ev: DataFrame) -> DataFrame:
    t = ev.agg(F.sum("xv").alias("_sx"), F.sum("yv").alias("_sy"))
    return ev.crossJoin(F.broadcast(t)).select("id", "x", "y", F.try_divide("xv", "_sx").alias("r"), F.try_divide("yv", "_sy").alias("p"), F.col("_sx").alias("sx"))


def _rogerson_pairs(s: DataFrame, method: str, kappa: float) -> DataFrame:
    o = s.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("r").alias("r2"), F.col("p").alias("p2"))
    d = W.distance(method)
    return s.crossJoin(o).withColumn("d", d).withColumn("a", F.when(F.col("d") <= 1, 1.0).otherwise(1 / F.pow("d", F.lit(kappa))))


def global_rogersons_r(df, x_field, y_field, method="Euclidean", kappa=1.0, fid="id") -> DataFrame:
    """Sums over pairs are products of a matrix of weights with columns of the features, so one pass over the pairs gives all.

    The variance's inner sum over k depends on one feature only: quadratic, not cubic.
    """
    s = _shares(W.events(df, x_field, y_field, fid))
    known = dense.gathered(s.where("r is not null and p is not null").select("id", "x", "y", "r", "p"))
    p, dev = known["p"].to_numpy(float), (known["r"] - known["p"]).to_numpy(float)
    with np.errstate(all="ignore"):
        root = np.sqrt(p)
        columns = known.drop(columns=["r", "p"]).assign(root=root, dev=dev / root, rest=(1 - p) * root, inverse=1 / root, p=p)

    def weigh(d):
        d = np.maximum(d, 1, out=d)
        return np.reciprocal(d if kappa == 1 else np.power(d, kappa, out=d), out=d)

    def add(w, a, b, earlier):
        k, dev, rest, inverse = (w @ np.column_stack([b["root"], b["dev"], b["rest"], b["inverse"]])).T[..., None]
        before = w if (earlier == w.shape[1]).all() else np.where(np.arange(w.shape[1]) < earlier, w, 0) if earlier.any() else w[:, :0]
        aj = before @ b["root"][: before.shape[1], None]
        return np.hstack([k, a["dev"] * dev, a["root"] * aj, rest / a["root"], (1 - a["p"]) * a["root"] * inverse])

    sums = dense.pair_sums(s, columns, method, weigh, add, ["k", "sa", "aj", "yij", "yji"]).toPandas()
    # the terms that have k: over all features but those of the same id
    found = columns.merge(sums, on="id")
    found["pk"] = found["p"] * found["k"]
    by = found.groupby("id", sort=False)
    pk, inverse, copies = by["pk"].transform("sum"), by["inverse"].transform("sum"), by["pk"].transform("size")
    found["yij"] = found["yij"] / copies - (found["pk"].sum() - pk) * found["inverse"]
    found["yji"] = found["yji"] / copies - found["pk"] * (found["inverse"].sum() - inverse)
    found["sa"], found["aj"] = found["sa"] / copies, found["aj"] / copies
    rows = found.groupby("id", as_index=False)[["sa", "aj", "yij", "yji"]].sum() if found["id"].nunique() > 1 else found[:0]
    kind = s.schema["id"].dataType.simpleString()
    rows = df.sparkSession.createDataFrame(rows[["id", "sa", "aj", "yij", "yji"]], f"id {kind}, sa double, aj double, yij double, yji double")
    t = s.join(rows, "id", "left").agg(F.count("*").alias("m"), F.first("sx").alias("sx"), F.sum(F.pow(F.col("r") - F.col("p"), F.lit(2)) / F.col("p")).alias("gof"), F.sum("sa").alias("sa"), F.sum("aj").alias("aj"), F.sum(F.col("yij") * F.col("yji")).alias("yy"))
    return _result(t, "gof + coalesce(sa, 0)", "(m - 1 - 2 * aj) / sx", "2 / (sx * sx) * yy")


def join_count(df: DataFrame, black: str, contiguity: DataFrame, fid: str = "id") -> DataFrame:
    """Directed join counts; ``contiguity`` has the pairs id, id2 of touching features."""
    f = df.select(F.col(fid).alias("id"), F.coalesce(F.expr(black), F.lit(False)).alias("b"))
    j = contiguity.select("id", "id2").join(f, "id").join(f.select(F.col("id").alias("id2"), F.col("b").alias("b2")), "id2")
    per = j.groupBy("id").agg(F.count("*").alias("k"), F.sum(F.expr("int(b and b2)")).alias("bb"), F.sum(F.expr("int(not b and not b2)")).alias("ww"), F.sum(F.expr("int(b <> b2)")).alias("bw"))
    t = f.join(per, "id", "left").na.fill(0).agg(F.count("*").alias("n"), F.sum(F.expr("int(b)")).alias("black"), F.sum("bb").alias("bb"), F.sum("ww").alias("ww"), F.sum("bw").alias("bw"), F.sum("k").alias("joins"), (F.sum(F.expr("k * (k - 1)")) / 2).alias("m"))
    t = t.withColumn("pb", F.col("black") / F.col("n")).withColumn("pw", 1 - F.col("black") / F.col("n")).withColumn("k", F.col("joins").cast("double"))
    sd = lambda q: f"sqrt(k * power({q}, 2) + 2 * m * power({q}, 3) - (k + 2 * m) * power({q}, 4))"
    out = t.select("n", "black", (F.col("n") - F.col("black")).alias("white"), "bb", "ww", "bw", *[F.expr(safe(e)).alias(a) for a, e in (("expected_bb", "k * pb * pb"), ("expected_ww", "k * pw * pw"), ("expected_bw", "2 * k * pb * pw"), ("sd_bb", sd("pb")), ("sd_ww", sd("pw")), ("sd_bw", "sqrt(2 * (k + m) * pb * pw - 4 * (k + 2 * m) * pb * pb * pw * pw)"))])
    for c in ("bb", "ww", "bw"):
        out = out.withColumn(f"z_{c}", F.try_divide(F.col(c) - F.col(f"expected_{c}"), F.col(f"sd_{c}")))
    return out


def _local(df: DataFrame, s: DataFrame, index: str, z: str, names: tuple[str, str, str], fid: str, extra: dict[str, str] | None = None) -> DataFrame:
    s = s.withColumn("_index", F.expr(safe(index)).cast("double")).withColumn("_z", F.expr(safe(z)).cast("double"))
    bad = F.col("_z").isNull() | F.isnan("_z") | (F.abs("_z") == float("inf"))
    s = s.withColumn("_bad", bad).withColumn("_index", F.when(bad, 0.0).otherwise(F.col("_index"))).withColumn("_z", F.when(bad, 0.0).otherwise(F.col("_z")))
    p = F.when(F.col("_bad"), 1.0).otherwise(zprob("_z"))
    cols = [F.col("_index").alias(names[0])] if names[0] else []
    cols += [F.col("_z").alias(names[1]), p.alias(names[2])]
    cols += [F.expr(safe(e)).alias(n) for n, e in (extra or {}).items()]
    r = s.select(F.col("id").alias("_id"), *cols)
    return df.join(r, df[fid] == r["_id"]).drop("_id")


def _scored(df, field, y_field, concept, method, standardization, band, k, self_neighbors, contiguity, fid):
    ev, p = _pairs(df, field, y_field, concept, method, band, k, self_neighbors, contiguity, fid)
    return _sums(ev, p, standardization).crossJoin(F.broadcast(_moments(ev)))


def local_morans_i(df, field, concept="InverseDistance", method="Euclidean", standardization="None", band=0.0, k=8, contiguity=None, fid="id") -> DataFrame:
    s = _scored(df, field, None, concept, method, standardization, band, k, False, contiguity, fid)
    b2 = "((z4 / (n - 1)) / power(z2 / (n - 1), 2))"
    index = "((xv - mx) / (z2 / (n - 1))) * (swx - mx * sw)"
    variance = f"(sw2 * (n - {b2}) / (n - 1) + (sw * sw - sw2) * (2 * {b2} - n) / ((n - 1) * (n - 2)) - sw * sw / ((n - 1) * (n - 1)))"
    z = f"({index} + sw / (n - 1)) / sqrt({variance})"
    kind = "CASE WHEN _bad OR nn = 0 OR abs(_z) < 1.96 THEN '' WHEN _z > 1.96 THEN CASE WHEN swx / sw >= mx THEN 'HH' ELSE 'LL' END WHEN xv >= mx AND swx / sw <= mx THEN 'HL' WHEN xv <= mx AND swx / sw >= mx THEN 'LH' ELSE '' END"
    return _local(df, s, index, z, ("LMiIndex", "LMiZScore", "LMiPValue"), fid, {"COType": kind})


def local_g(df, field, concept="InverseDistance", method="Euclidean", standardization="None", band=0.0, k=8, contiguity=None, self_neighbors=False, fid="id") -> DataFrame:
    s = _scored(df, field, None, concept, method, standardization, band, k, self_neighbors, contiguity, fid)
    sd = "sqrt(sx2 / n - mx * mx)"
    z = f"(swx - sw * mx) / ({sd} * sqrt((n * sw2 - sw * sw) / (n - 1)))"
    mean = "sw / (n * (n - 1))"
    return _local(df, s, "0.0", z, ("", "GiZScore", "GiPValue"), fid, {"GiMean": mean, "GiVar": f"sqrt(sw2 / n - power({mean}, 2))"})


def local_gearys_c(df, field, concept="InverseDistance", method="Euclidean", standardization="None", band=0.0, k=8, contiguity=None, fid="id") -> DataFrame:
    s = _scored(df, field, None, concept, method, standardization, band, k, False, contiguity, fid)
    e = "(2 * n * sw / (n - 1))"
    v = f"(n / (n - 1) * (sw * sw + sw2) * (3 + (z4 / (n - 1)) / power(z2 / (n - 1), 2)) - {e} * {e})"
    return _local(df, s, "swd / (z2 / (n - 1))", f"(swd / (z2 / (n - 1)) - {e}) / sqrt({v})", ("LGcIndex", "LGcZScore", "LGcPValue"), fid)


def _with_raw(s: DataFrame) -> DataFrame:
    return s.crossJoin(F.broadcast(s.agg(F.sum(F.col("raw") * F.col("raw")).alias("raw2"))))


def local_lees_s(df, field, concept="InverseDistance", method="Euclidean", standardization="None", band=0.0, self_neighbors=True, k=8, contiguity=None, fid="id") -> DataFrame:
    s = _with_raw(_scored(df, field, None, concept, method, standardization, band, k, self_neighbors, contiguity, fid))
    return _local(df, s, "(n * n / raw2) * (power(swx - mx * sw, 2) / z2)", "0.0", ("LLsIndex", "LLsZScore", "LLsPValue"), fid)


def local_lees_l(df, x_field, y_field, concept="InverseDistance", method="Euclidean", standardization="None", band=0.0, self_neighbors=True, k=8, contiguity=None, fid="id") -> DataFrame:
    s = _with_raw(_scored(df, x_field, y_field, concept, method, standardization, band, k, self_neighbors, contiguity, fid))
    return _local(df, s, "(n * n / raw2) * ((swx - mx * sw) * (swy - my * sw) / (sqrt(z2) * sqrt(y2)))", "0.0", ("LLlIndex", "LLlZScore", "LLlPValue"), fid)


def local_rogersons_r(df, x_field, y_field, method="Euclidean", kappa=1.0, fid="id") -> DataFrame:
    s = _shares(W.events(df, x_field, y_field, fid))
    p = _rogerson_pairs(s, method, kappa).withColumn("a", F.when(F.col("id") == F.col("id2"), 1.0).otherwise(F.col("a")))
    sums = s.join(p.groupBy("id").agg(F.sum(F.col("a") * (F.col("r2") - F.col("p2")) / F.sqrt("p2")).alias("k")), "id")
    return _local(df, sums, "((r - p) / sqrt(p)) * k", "((r - p) / sqrt(p)) * k / ((1 - p) / sx)", ("LRrIndex", "LRrZScore", "LRrPValue"), fid)


def focal_lq(df, x_field, y_field, concept="FixedDistance", method="Euclidean", band=0.0, fid="id") -> DataFrame:
    """Location quotient over neighbours including the feature itself, unweighted."""
    ev = W.events(df, x_field, y_field, fid)
    p = W.pairs(ev, concept, method, band, 8, True)
    per = p.where("w <> 0").groupBy("id").agg(F.sum("xv2").alias("lx"), F.sum("yv2").alias("ly"))
    t = ev.agg(F.try_divide(F.sum("xv"), F.sum("yv")).alias("g"))
    s = ev.join(per, "id", "left").crossJoin(F.broadcast(t))
    own = F.when(F.col("xv") != 0, F.try_divide(F.col("yv"), F.col("xv"))).otherwise(0.0)
    near = F.when(F.col("ly") != 0, F.try_divide(F.col("lx"), F.col("ly"))).otherwise(0.0)
    r = s.select(F.col("id").alias("_id"), finite(F.try_divide(own, F.col("g"))).alias("flq"), finite(F.try_divide(near, F.col("g"))).alias("flqd"), finite(F.try_divide(F.col("ly") - F.col("lx") * F.col("g"), F.sqrt(F.col("lx") * F.col("g")))).alias("fz"))
    return df.join(r, df[fid] == r["_id"]).drop("_id")


def standardized_scores(df: DataFrame, x_field: str, y_field: str, target: str = "std_scr") -> DataFrame:
    """(x/X - y/Y) / sqrt(mean squared difference); rows with a null input are skipped."""
    x, y = F.expr(x_field).cast("double"), F.expr(y_field).cast("double")
    known = df.withColumn("_x", x).withColumn("_y", y).where("_x is not null and _y is not null")
    t = known.agg(F.sum("_x").alias("_sx"), F.sum("_y").alias("_sy"))
    d = known.crossJoin(F.broadcast(t)).withColumn("_d", F.try_divide("_x", "_sx") - F.try_divide("_y", "_sy"))
    sd = d.agg(F.sqrt(F.sum(F.col("_d") * F.col("_d")) / F.count("*")).alias("_sd"))
    return d.crossJoin(F.broadcast(sd)).withColumn(target, F.try_divide("_d", "_sd")).drop("_x", "_y", "_sx", "_sy", "_d", "_sd")


LOCAL = {"MoranI": local_morans_i, "GetisOrdGiStar": local_g, "GearyC": local_gearys_c, "LeeS": local_lees_s}


def local_sa(cells: DataFrame, field: str, sa_method: str = "MoranI", concept="InverseDistance", method="Euclidean", standardization="Row", band=0.0, fid="id") -> DataFrame:
    """A local statistic on cells or polygons that already carry a value."""
    return LOCAL[sa_method](cells, field, concept=concept, method=method, standardization=standardization, band=band, fid=fid)
