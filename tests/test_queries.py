"""Every registered query against its SQL, and the others for a plausible result."""

import math

import pytest
from pyspark.sql import functions as F

from geoweft import queries as Q
from tests.conftest import same_rows


@pytest.mark.parametrize("name", list(Q.ORACLE_SQL))
def test_oracle(spark, data, duck, name):
    assert same_rows(Q.QUERIES[name](spark, data).toPandas(), duck.execute(Q.ORACLE_SQL[name]).df())


@pytest.fixture(scope="module")
def larger():
    import duckdb

    con, folder = duckdb.connect(), "/root/testdata/sf0.01"
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return folder, con


@pytest.mark.parametrize("name", [n for n in Q.ORACLE_SQL if n.startswith("local_")])
def test_local_statistics_to_the_last_digit(spark, larger, name):
    folder, con = larger
    got, want = Q.QUERIES[name](spark, folder).toPandas(), con.execute(Q.ORACLE_SQL[name]).df()
    got, want = got.sort_values("fid").reset_index(drop=True), want.sort_values("fid").reset_index(drop=True)
    assert len(got) == len(want)
    for c in want.columns:
        assert got[c].tolist() == want[c].tolist(), c


@pytest.mark.parametrize("name", [n for n in Q.QUERIES if n not in Q.ORACLE_SQL])
def test_runs(spark, data, name):
    assert Q.QUERIES[name](spark, data).columns
    Q.QUERIES[name](spark, data).toPandas()


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """A folder with 130 suppliers, more than there are in the small tables."""
    d = str(tmp_path_factory.mktemp("many"))
    spark.range(1, 131).select(F.col("id").alias("s_suppkey"), F.lit("s").alias("s_name"), (F.col("id") % 25).cast("int").alias("s_nationkey"), (F.col("id") * 7.0 - 300).alias("s_acctbal")).write.parquet(f"{d}/supplier.parquet")
    return d


def _length(fid):
    return math.hypot(50, fid % 40)


@pytest.mark.parametrize(
    ("name", "column", "value"),
    [
        ("single_sided_buffer", "area", lambda i: 4 * _length(i)),
        ("polygons_along_lines", "area", lambda i: 4 * _length(i)),
        ("points_along_lines", "n", lambda i: math.ceil(_length(i) / 7) + 1),
        ("split_line_at_point", "n", lambda i: 2),
        ("simplify", "n", lambda i: 3),
    ],
)
def test_all_lines(spark, many, name, column, value):
    got = {r.fid: r[column] for r in Q.QUERIES[name](spark, many).collect()}
    assert got == pytest.approx({i: value(i) for i in range(1, 131)}, abs=1e-3)


def test_all_origins_lines_and_zones(spark, many):
    polar = Q.QUERIES["polar_grids"](spark, many).groupBy("fid").count().collect()
    assert {r.fid: r["count"] for r in polar} == dict.fromkeys(range(1, 131), 24)
    assert {r.fid for r in Q.QUERIES["variable_buffer"](spark, many).where("area > 0").collect()} == set(range(1, 131))
    parts = Q.QUERIES["split_polygon_by_count"](spark, many).groupBy("fid").agg(F.count("*").alias("n"), F.sum("area").alias("area")).collect()
    assert {r.fid: r.n for r in parts} == dict.fromkeys(range(1, 101), 4) and all(r.area == pytest.approx(10404, abs=1e-3) for r in parts)


def test_spline_has_all_samples(spark, many, monkeypatch):
    seen, solve = [], Q.surface.thin_plate_spline
    monkeypatch.setattr(Q.surface, "thin_plate_spline", lambda df, *a, **b: seen.append(df.count()) or solve(df, *a, **b))
    cells = Q.QUERIES["thin_plate_spline"](spark, many).toPandas()
    assert seen == [130] and len(cells) == 51 * 51
    assert cells.value.to_numpy() == pytest.approx((3 * (cells.col * 20 + 10) - 2 * (1020 - cells.row * 20 - 10) + 5).to_numpy(), abs=0.02)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_registry():
    from geoweft import registry

    assert len(registry.PROCESSES) == 182
    assert all(callable(registry.process(n)) for n in registry.names())
    assert registry.process("globalmoransi") is registry.process("GlobalMoransI")
    with pytest.raises(KeyError):
        registry.process("nothing")
