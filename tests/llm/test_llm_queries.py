"""The found queries against SQL on the small test tables; every other one runs."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import compare  # noqa: E402

from millrace.llm import queries as Q  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return compare.oracle(DATA)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_rows_equal_sql(spark, con, name):
    assert not compare.differences(spark, con, Q.QUERIES[name], Q.SQL[name], DATA)


@pytest.mark.parametrize("name", ["p2_found", "p3_splits", "p6_groups", "p7_ids", "p8_containers", "p9_found"])
def test_runs(spark, name):
    df = Q.QUERIES[name](spark, DATA)
    assert df.columns and df.count() > 0
