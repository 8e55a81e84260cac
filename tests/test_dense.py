"""Statistics over all pairs of features: block sums against sums pair by pair, and no pair as a row."""

import math

import pytest

from geoweft.operators import autocorr
from geoweft.plans import dense
from geoweft.plans import weights as W

#: Two features of one id, two at one place, one without a place, one without an id, one without a value.
ODD = [(1, 0.0, 0.0, 4.0, 2.0), (2, 3.0, 4.0, 1.0, 5.0), (2, 6.0, 1.0, 7.0, 3.0), (3, 3.0, 4.0, 2.0, 1.0), (4, 0.5, 0.0, 9.0, 6.0), (5, None, 1.0, 3.0, 2.0), (None, 2.0, 2.0, 5.0, 4.0), (7, 8.0, 8.0, None, 3.0), (8, 20.0, -3.0, 6.0, 8.0)]


@pytest.fixture
def odd(spark, monkeypatch):
    monkeypatch.setattr(dense, "ROWS", 3)
    monkeypatch.setattr(dense, "COLUMNS", 2)
    return spark.createDataFrame(ODD, "fid long, x double, y double, v double, pop double").repartition(3)


def no_pairs(*_args, **_more):
    raise AssertionError("pairs of features became rows")


def test_rogersons_r_of_odd_features(odd, monkeypatch):
    monkeypatch.setattr(autocorr, "_rogerson_pairs", no_pairs)
    got = autocorr.global_rogersons_r(odd, "v", "pop", fid="fid").first()
    sx, sy = sum(1 if f[3] is None else f[3] for f in ODD), sum(f[4] for f in ODD)
    f = [(i, x, y, (1 if v is None else v) / sx, p / sy) for i, x, y, v, p in ODD]
    pairs = [(a, b, 1 / max(1, math.dist(a[1:3], b[1:3]))) for a in f for b in f if None not in (a[0], a[1], b[0], b[1]) and a[0] != b[0]]
    k = {}
    for a, b, w in pairs:
        k[a[0]] = k.get(a[0], 0) + w * math.sqrt(b[4])
    rows = {i: [0, 0, 0, 0] for i in k}
    for (i, _, _, r, p), (j, _, _, s, q), w in pairs:
        more = (w / math.sqrt(p * q) * (r - p) * (s - q), w * math.sqrt(p * q) if j < i else 0, (1 - q) * w * math.sqrt(q / p) - q * k[j] / math.sqrt(p), (1 - p) * w * math.sqrt(p / q) - p * k[i] / math.sqrt(q))
        rows[i] = [s + m for s, m in zip(rows[i], more)]
    found = [rows[i] for i, *_ in f if i in rows]
    assert got.observed == pytest.approx(sum((r - p) ** 2 / p for *_, r, p in f) + sum(s[0] for s in found), abs=1e-12)
    assert got.expected == pytest.approx((len(f) - 1 - 2 * sum(s[1] for s in found)) / sx, abs=1e-12)
    assert got.variance == pytest.approx(2 / sx**2 * sum(s[2] * s[3] for s in found), abs=1e-12)


def test_rogersons_r_of_few(spark):
    for rows in ([], [(1, 0.0, 0.0, 4.0, 2.0)], [(1, 0.0, 0.0, 0.0, 2.0), (2, 1.0, 0.0, 0.0, 1.0)]):
        df = spark.createDataFrame(rows, "fid long, x double, y double, v double, pop double")
        assert autocorr.global_rogersons_r(df, "v", "pop", fid="fid").first().z_score == 0


def everything(spark, s):
    return {r.id: r.asDict() for r in s.collect() if r.id is not None}


@pytest.mark.parametrize("own", [False, True])
@pytest.mark.parametrize("how", ["None", "Row"])
@pytest.mark.parametrize(("concept", "method"), [("InverseDistance", "Euclidean"), ("InverseDistance", "Manhattan"), ("InverseDistanceSquared", "Euclidean")])
def test_sums_of_odd_features(odd, spark, concept, method, how, own):
    ev = W.events(odd, "v", "pop", "fid")
    want = everything(spark, autocorr._pair_sums(W.standardized(W.pairs(ev, concept, method, self_neighbors=own), how)))
    got = everything(spark, W.dense_sums(ev, how, concept, method, own))
    for i, row in got.items():
        old = {k: v or 0 for k, v in want.get(i, dict.fromkeys(row)).items()}
        assert row == pytest.approx(old | {"id": i}, rel=1e-12, abs=1e-12), i
    assert not any(v for i in set(want) - set(got) for k, v in want[i].items() if k != "id")


def without_pairs(df, run, monkeypatch):
    """What ``run`` gives by sums of blocks and by pairs as rows."""
    with monkeypatch.context() as m:
        m.setattr(W, "_all_pairs", no_pairs)
        got = run(df).toPandas()
    with monkeypatch.context() as m:
        m.setattr(W, "WITHOUT_BAND", ())
        want = run(df).toPandas()
    return got, want


def test_morans_i_makes_no_pairs(odd, monkeypatch):
    got, want = without_pairs(odd, lambda df: autocorr.global_morans_i(df, "v", standardization="Row", fid="fid"), monkeypatch)
    assert got.to_numpy() == pytest.approx(want.to_numpy(), abs=1e-12)


def test_local_gearys_c_makes_no_pairs(odd, monkeypatch):
    got, want = without_pairs(odd.where("fid is not null and x is not null").dropDuplicates(["fid"]), lambda df: autocorr.local_gearys_c(df, "v", standardization="Row", fid="fid").select("fid", "LGcIndex", "LGcZScore", "LGcPValue").orderBy("fid"), monkeypatch)
    assert got.to_numpy() == pytest.approx(want.to_numpy(), rel=1e-9, abs=1e-9)


def test_local_morans_i_makes_no_pairs(odd, monkeypatch):
    got, want = without_pairs(odd.where("fid is not null and x is not null").dropDuplicates(["fid"]), lambda df: autocorr.local_morans_i(df, "v", standardization="Row", fid="fid").select("fid", "LMiIndex", "LMiZScore", "LMiPValue", "COType").orderBy("fid"), monkeypatch)
    assert got.pop("COType").tolist() == want.pop("COType").tolist()
    assert got.to_numpy() == pytest.approx(want.to_numpy(), rel=1e-9, abs=1e-9)
