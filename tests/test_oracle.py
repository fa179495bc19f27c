"""Every registered query runs over its whole tables; those with SQL must equal DuckDB's answer."""

import os

import pytest
from compare import compare, connect

from quire import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in ORACLE:
        assert compare(df, con, ORACLE[name]) is None
    else:
        assert df.count() > 0


def test_oracles_have_queries():
    assert not ORACLE.keys() - QUERIES.keys()
