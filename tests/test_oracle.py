"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""
import duckdb
import pytest

from quillon.plans.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = [tuple(r[c] for c in columns) for r in df.collect()]
    result = duck.sql(SQL[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    expected = [tuple(r[i] for i in at) for r in result.fetchall()]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(found, key=key) == sorted(expected, key=key)


def test_all_have_sql():
    assert set(QUERIES) == set(SQL)
