"""Every registered query against its oracle SQL in DuckDB (sf0.001)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from eventclime.plans.registry import all_oracle_sql, all_queries  # noqa: E402
from oracle_check import compare, duck_for  # noqa: E402

from conftest import SF_SMALL  # noqa: E402

# the library's own queries; those of the optional subpackage have tests of their own
QUERIES = all_queries()
SQL = all_oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck_for(SF_SMALL)


def test_every_query_has_an_oracle():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    ok, n_spark, n_duck, msg = compare(spark, con, SF_SMALL, QUERIES[name], SQL.get(name))
    assert ok, f"{name}: spark {n_spark} rows, duckdb {n_duck} rows: {msg}"
    assert n_spark > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["window_start", "clz", "value"]
    assert df.count() > 0
