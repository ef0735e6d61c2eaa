"""Every registered query against its check SQL in DuckDB, value by value."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from codequarry.plans import all_queries
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"
SLOW = {"analyse_corpus", "analyse_file_stats"}  # covered by tests/test_jobs.py


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_a_check():
    assert set(all_queries.CHECKS) == set(all_queries.QUERIES)
    assert set(all_queries.QUERIES) <= set(queries()) and set(all_queries.CHECKS) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() == 5693


@pytest.mark.parametrize("name", sorted(set(all_queries.QUERIES) - SLOW))
def test_query(spark, con, name):
    diff, _ = difference(all_queries.QUERIES[name](spark, SF), con, all_queries.CHECKS[name])
    assert diff is None, diff
