"""Every query with SQL gives the same rows as DuckDB."""

import os

import duckdb
import pytest

from engram.plans.catalog import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    if name in SQL:
        rel = duck.execute(SQL[name])
        names = [d[0] for d in rel.description]
        assert sorted(names) == cols
        want = sorted(repr(tuple(row[names.index(c)] for c in cols)) for row in rel.fetchall())
        assert [x.replace("-0.0,", "0.0,") for x in got] == [x.replace("-0.0,", "0.0,") for x in want]
