"""The queries run on the smallest tables with the columns that TESTDATA.md states; SQL where there is any."""

import os

import duckdb
import pytest

from shelfspark.llm import queries as Q

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
COLUMNS = {
    "p2_found": [("item_key", "string"), ("catalog_id", "string")], "p4_found": [("kit_id", "string")], "p5_found": [("listing_a", "bigint"), ("listing_b", "bigint")],
    "p6_found": [("doc_id", "bigint"), ("item_id", "bigint")], "p8_found": [("doc_id", "bigint"), ("subject", "string")],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_no_row_twice(spark, name):
    df = Q.QUERIES[name](spark, DATA)
    assert df.dtypes == COLUMNS[name]
    rows = df.collect()
    assert len(rows) == len(set(rows))


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    got = Q.QUERIES[name](spark, DATA)
    want = con.execute(Q.ORACLES[name]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
