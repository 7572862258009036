"""Queries against their SQL."""

import duckdb
import pytest
from latticework.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    a, b = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda d: sorted(map(tuple, d[sorted(a.columns)].itertuples(index=False)))
    assert rows(a) == rows(b)
