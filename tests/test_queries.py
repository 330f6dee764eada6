"""Every registered query of the library against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from tidewell import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return str(v)
    return round(float(v), 9) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, con, name):
    df = plans.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    sql = plans.oracle_sql().get(name)
    if sql is None:
        assert rows or name == "l7_sample"
        return
    r = con.sql(sql)
    at = [r.columns.index(c) for c in sorted(r.columns)]
    assert sorted(r.columns) == columns
    assert sorted(repr([plain(x[i]) for i in at]) for x in r.fetchall()) == rows


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {*plans.queries()} <= {*e.queries()}
