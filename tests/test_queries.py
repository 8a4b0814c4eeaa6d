"""Every registered query with SQL against DuckDB on the smallest tables; all queries run."""

import duckdb
import pytest

from kindred.plans import queries as P

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(pdf, cols):
    x = pdf[cols].astype(object)
    return sorted(map(repr, x.where(x.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(P.Q))
def test_query(spark, duck, name):
    got = P.Q[name](spark, SF).toPandas()
    if name in P.S:
        want = duck.sql(P.S[name]).df()
        cols = sorted(got.columns)
        assert cols == sorted(want.columns)
        assert rows(got, cols) == rows(want, cols)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 21
    assert set(e.oracle_sql()) <= set(e.queries())
