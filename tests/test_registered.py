"""Every registered query beside its SQL twin, on the smallest tables."""

import collections
import math

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as contract  # noqa: E402

SF = "/root/testdata/sf0.001"


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else str(v)


@pytest.fixture(scope="module")
def twin(tables):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in tables:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, twin, name):
    df = contract.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    if name not in contract.oracle_sql():
        assert got
        return
    cur = twin.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == names
    want = collections.Counter(tuple(plain(dict(zip(columns, r))[n]) for n in names) for r in cur.fetchall())
    assert got == want


def test_entry(spark, tables):
    assert contract.entry(spark).count() > 0
