"""Every query runs on the smallest tables; those with SQL agree with it."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, float):
        return f"{v:.6g}"
    return str([plain(x) for x in v]) if isinstance(v, list | tuple) else "" if v is None else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).columns == ["ref_table", "ref_key", "period", "state"]


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) & set(entry.catalogue.QUERIES)))
def test_against_sql(spark, con, name):
    got = entry.queries()[name](spark, DATA)
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted(tuple(map(plain, r)) for r in got.select(*(f"`{n}`" for n in names)).collect())
    assert rows == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_every_query_has_a_name_and_a_text():
    for name, f in entry.queries().items():
        assert f.__name__ == name
    assert set(entry.oracle_sql()) <= set(entry.queries())
