"""Queries of this folder against their SQL."""

import duckdb
import pytest

from tidewell.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    r = con.sql(queries.ORACLES[name])
    assert sorted(r.columns) == sorted(df.columns)
    at = [r.columns.index(c) for c in df.columns]
    expected = sorted(repr([x[i] for i in at]) for x in r.fetchall())
    assert sorted(repr(list(x)) for x in df.collect()) == expected and len(expected) > 0
