"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01: tests/oracle_check.py)."""

import pytest

import __spark_entry__ as E
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_matches_oracle(spark, con, name):
    msg, ok = compare(spark, name, E.queries()[name], E.oracle_sql().get(name), SF, con)
    assert ok, msg


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["cohort_week", "cohort_size", "week_offset", "active_users"]
    assert df.count() >= 0
