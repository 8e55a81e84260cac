import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    from geoweft import ship

    ship(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def same_rows(a, b):
    """Whether two pandas frames hold the same rows, in any order."""
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)

    def norm(f):
        f = f[cols].copy()
        for c in cols:
            if f[c].dtype.kind == "f":
                f[c] = f[c].round(5) + 0.0
            elif f[c].dtype.kind in "iub":
                f[c] = f[c].astype(float)
        return sorted(map(str, f.itertuples(index=False, name=None)))

    return norm(a) == norm(b)
