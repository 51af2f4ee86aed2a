import os

import pytest

import __spark_entry__ as entry
from symgraph import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in TABLES.split():
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = connection.sql(queries.SQL[name]).df()
    found = queries.queries()[name](spark, SF).toPandas()
    assert sorted(found.columns) == sorted(expected.columns)
    rows = lambda df: sorted((tuple(None if x is None or x != x else x for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)
    assert rows(found) == rows(expected)


def test_contract(spark):
    assert entry.entry(spark).count() >= 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
