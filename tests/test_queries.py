"""Every registered query of the engine against its DuckDB counterpart."""

import duckdb
import pytest

from brindle.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([r[i] for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    want = con.execute(ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    assert sorted(cols) == sorted(df.columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(cols, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_points_agree():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
