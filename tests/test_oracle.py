"""Every query of the base library against its SQL on the small tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from cadastrum.registry import QUERIES

SF_DIR = "/root/testdata/sf0.001"
# Rows-only queries still run; these tables have no duplicates or departments to show at this size.
MAY_BE_EMPTY = {"explorer_page", "key_duplicates"}


@pytest.fixture(scope="module")
def connection():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    query, sql = entry.queries()[name], entry.oracle_sql().get(name)
    if sql is None:
        assert query(spark, SF_DIR).count() > 0
        return
    verdict = compare(spark, connection, name, query, sql, SF_DIR)
    if name in MAY_BE_EMPTY and verdict == "no rows on either side":
        return
    assert verdict is None, verdict


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
