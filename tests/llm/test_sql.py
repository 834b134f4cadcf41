"""Queries of the subpackage against their SQL in DuckDB, on the smallest tables."""
import duckdb
import pytest

from quillon.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", ["op11_hilbert_zone_negatives", "op12_chat_machine", "op13_shared_lexical_search"])
def test_rows_equal(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = con.sql(SQL[name])
    at = [result.columns.index(c) for c in columns]
    expected = sorted(tuple(r[i] for i in at) for r in result.fetchall())
    assert sorted(result.columns) == columns and expected
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == expected
