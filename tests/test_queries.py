"""Every query against its SQL at the smallest scale: the driver's own check, in small."""

import datetime
import os

import pytest

import __spark_entry__ as entry
from branchstone import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
    assert sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr) == want


def test_entry(spark):
    assert {r.outcome for r in entry.entry(spark).collect()} >= {"merge", "field", "existence"}
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL) <= set(entry.oracle_sql())
    assert set(queries.QUERIES) <= set(entry.queries())
