"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import check, connect


@pytest.fixture(scope="session")
def con(sf_dir):
    return connect(sf_dir)


def test_registry_is_consistent():
    assert set(oracle_sql()) <= set(queries())


def test_entry_gives_rows(spark):
    assert entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, con, sf_dir, name):
    ok, message = check(spark, con, name, sf_dir)
    assert ok, message
