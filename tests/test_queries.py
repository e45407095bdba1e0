"""Every core query runs; those with SQL give its rows."""

import glob
import os
import subprocess
import sys

import compare
import pytest

from millrace.plans import queries as core

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con():
    return compare.oracle(DATA)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_rows_equal_sql(spark, con, name):
    assert not compare.differences(spark, con, core.QUERIES[name], core.SQL[name], DATA)


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.SQL)))
def test_runs_alike_twice(spark, name):
    one, two = (core.QUERIES[name](spark, DATA).collect() for _ in range(2))
    assert sorted(map(repr, one)) == sorted(map(repr, two))


def test_entry_works_without_the_subpackage():
    code = "import sys; sys.modules['millrace.llm'] = None; import __spark_entry__ as e; assert e.llm is None and len(e.queries()) == len(e.core.QUERIES) > 100; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_outside_imports_the_subpackage():
    for p in glob.glob(f"{ROOT}/millrace/**/*.py", recursive=True):
        if "/llm/" not in p:
            text = open(p, encoding="utf-8").read()
            assert "millrace.llm" not in text and "from .llm" not in text and "from ..llm" not in text, p
