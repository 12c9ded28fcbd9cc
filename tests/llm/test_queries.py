"""Every query of the subpackage with SQL gives the rows of its SQL on the smallest tables."""

import os

import pytest

from kmerloom.llm import queries

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA) or not os.path.exists(queries.BYTE_BPE), reason="no test data")


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, views, name):
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([plain(v) for v in r]) for r in df.select(columns).collect())
    answer = views.execute(queries.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in answer.fetchall())
