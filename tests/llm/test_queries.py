import os
import zlib

import pytest

import corpus_pipeline
from symgraph.llm import queries
from symgraph.llm.common import read_table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = connection.sql(queries.oracle_sql()[name]).df()
    found = queries.queries()[name](spark, SF).toPandas()
    rows = lambda df: sorted((tuple(None if x is None or x != x else x for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)
    assert sorted(found.columns) == sorted(expected.columns) and rows(found) == rows(expected)


def test_held_out_languages(spark):
    truth = read_table(spark, SF, "documents").select("doc_id", "lang")
    rows = queries.op2_language_id(spark, SF).join(truth, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert sum(held) > 0.95 * len(held)


def test_held_out_toxicity(spark):
    rows = queries.op10_toxicity(spark, SF).join(read_table(spark, SF, "labels"), "doc_id").where("held_out").collect()
    toxic, other = ([r["score"] for r in rows if r["toxic"] == y] for y in (1, 0))
    wins = [(a > b) + 0.5 * (a == b) for a in toxic for b in other]
    assert not wins or sum(wins) / len(wins) > 0.7


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    docs = read_table(spark, SF, "documents")
    start = docs.count()
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert 0.5 * start < len(kept) < start
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").distinct().collect()} == kept
