"""Every registered query of the repository operators against its DuckDB oracle."""

import os

import duckdb
import pytest

from graphmill.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def canonical(rows, order):
    plain = lambda x: None if isinstance(x, float) and x != x else round(x, 9) if isinstance(x, float) else x
    return sorted(tuple(repr(plain(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    assert len({c.lower() for c in df.columns}) == len(df.columns)
    if name in ORACLES:
        expected = duck.sql(ORACLES[name])
        columns = sorted(df.columns)
        assert sorted(expected.columns) == columns
        assert canonical(got, [df.columns.index(c) for c in columns]) == canonical(expected.fetchall(), [expected.columns.index(c) for c in columns])
