"""Every registered query with SQL gives the same names, types and values as DuckDB."""

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert differences(entry.queries()[name](spark, SF), con, ORACLES[name]) == []


def test_entry_runs(spark):
    result = entry.entry(spark)
    assert result.columns[:3] == ["target_lang", "seen", "perf"] and result.count() > 0


def test_rows_only_queries_run(spark):
    for name in set(entry.queries()) - set(ORACLES):
        assert entry.queries()[name](spark, SF).count() > 0
