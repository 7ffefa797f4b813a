"""The registered queries of the training-data operators against their SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest

from marlstone.llm.entries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, data, name):
    con = duckdb.connect()
    for table in os.listdir(data):
        con.execute(f"create view {table[:-8]} as select * from '{data}/{table}'")
    cursor = con.execute(ORACLE_SQL[name])
    names = [x[0] for x in cursor.description]
    want = sorted(cursor.fetchall(), key=repr)
    got = QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == want
