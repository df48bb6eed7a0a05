"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import math
import os

import duckdb
import pytest

from sparkledger.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in catalogue.ORACLE_SQL:
        assert df.columns
        return
    found = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(str([plain(r[names.index(c)]) for c in sorted(names)]) for r in found.fetchall())
    assert sorted(str([plain(r[c]) for c in sorted(names)]) for r in rows) == want


def test_sandbox_runs_the_programs_of_all_suppliers(spark):
    sf = "/root/testdata/sf0.01"
    n = spark.read.parquet(f"{sf}/supplier.parquet").count()
    rows = catalogue.QUERIES["sandbox_exec_all"](spark, sf).collect()
    assert n > 50 and sum(r.n for r in rows) == n
    assert catalogue.QUERIES["sandbox_spot_check"](spark, sf).first().checked == min(50, n // 5)
