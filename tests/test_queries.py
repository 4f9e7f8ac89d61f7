"""Every registered query against its SQL, and the driver contract."""

import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    sql = oracle_sql().get(name)
    if sql is None:
        assert queries()[name](spark, FOLDER).count() > 0
    else:
        assert compare(spark, con, queries()[name], sql, FOLDER) == ""


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["o_orderkey", "priority_id", "priority_name", "o_totalprice"] and df.count() == 1500
