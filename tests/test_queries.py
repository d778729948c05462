"""Every registered query against its SQL in DuckDB, and the flagship query."""

import glob
import os

import duckdb
import pytest

from taktwerk.plans import oracle
from taktwerk.plans import queries as plans

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def test_every_query_has_sql():
    assert set(plans.queries()) == set(oracle.oracle_sql())


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_sql(spark, con, name):
    got = plans.queries()[name](spark, SF)
    want = con.sql(oracle.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    mine = sorted((tuple(r) for r in got.select(*columns).collect()), key=repr)
    theirs = sorted(con.sql(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({oracle.oracle_sql()[name]})").fetchall(), key=repr)
    assert len(mine) == len(theirs) and [x for x in zip(mine, theirs) if x[0] != x[1]][:3] == []


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
