"""Every registered query next to its SQL counterpart on the smallest tables."""

import os

import pytest
from check import compare, duck

import __spark_entry__ as entry

PATH = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(PATH), reason="tables not there")


@pytest.fixture(scope="module")
def con():
    return duck(PATH)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    if name in ORACLES:
        assert compare(spark, con, PATH, QUERIES[name], ORACLES[name]) == ""
    else:
        assert QUERIES[name](spark, PATH).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
