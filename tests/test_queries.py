"""Every registered query with a SQL twin gives the same rows at the smallest scale."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import rows_of

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()))
def test_matches_sql_twin(spark, duck, key):
    df = entry.queries()[key](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(entry.oracle_sql()[key])
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows_of(names, cursor.fetchall())


def test_entry_runs(spark):
    row = entry.entry(spark).first()
    assert row["n_rows"] > 0
    assert row["state"] in {"pass", "inconclusive", "fail"}


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
