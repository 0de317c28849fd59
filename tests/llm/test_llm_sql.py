"""Queries of the training-data operators against their SQL on the smallest tables."""

import duckdb
import pytest

from factloom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    found = c.sql(SQL[name])
    order = [found.columns.index(x) for x in df.columns]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(repr(tuple(v[i] for i in order)) for v in found.fetchall())
