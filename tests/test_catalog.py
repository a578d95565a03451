"""Every query with SQL gives the rows that DuckDB gives; the others give rows."""

import os
from glob import glob

import duckdb
import pytest

from compare import table_rows
from quillstrand import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    mine = table_rows(df.columns, df.collect())
    assert mine
    if name in catalog.ORACLES:
        res = duck.execute(catalog.ORACLES[name])
        names = [d[0] for d in res.description]
        assert sorted(names) == sorted(df.columns)
        assert mine == table_rows(names, res.fetchall())


def test_entry_without_the_optional_part(spark):
    import __spark_entry__ as entry

    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
