"""Every registered query against its SQL on the smallest tables."""

import os

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from fleetbump.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    return connect(SF_DIR)


def test_every_core_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF_DIR)
    assert ok, note


def test_entry(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() > 0
