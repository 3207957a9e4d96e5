"""Every registered query with SQL agrees with it on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    result, _ = check(spark, con, name, SF)
    assert result.startswith(("ok", "rows")), result


def test_entry_is_stable(spark):
    assert entry.entry(spark).columns == entry.entry(spark).columns
