"""Every registered query against its oracle SQL on the small tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from oracles.catalogue import all_statements
from oracle_check import check, duck
from tallyhouse.registry import all_queries

# Queries of the training-data package have tests of their own.
QUERIES = all_queries()
STATEMENTS = all_statements()


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle(spark, con, folder, name):
    good, message = check(spark, con, folder, name, QUERIES[name], STATEMENTS[name])
    assert good, message


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(STATEMENTS)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry_gives_rows(spark, folder):
    assert entry(spark).columns == ["category", "revenue"]
    assert entry(spark).count() == 5
