"""Every registered query against its SQL on the smallest folder."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, duck_rows, spark_rows, types

FOLDER = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query(spark, con, key):
    df = entry.queries()[key](spark, FOLDER)
    assert types(df, con, ORACLES[key]) == {}
    assert spark_rows(df) == duck_rows(con, ORACLES[key])
