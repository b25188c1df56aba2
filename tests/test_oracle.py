"""Every registered query against its DuckDB twin, on the smallest tables."""

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    plan, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert plan(spark, SF).count() > 0
        return
    mine, theirs, difference = compare(spark, duck, plan, sql, SF)
    assert difference is None
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_no_oracle_without_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
