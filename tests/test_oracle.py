"""All registered queries with SQL against DuckDB on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check_oracle import compare, connect  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert compare(got, duck.sql(entry.oracle_sql()[name]).df()) == "ok"


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
