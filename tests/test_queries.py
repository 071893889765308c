"""Every registered query against its SQL counterpart, on the smallest data folder."""

import pytest
from compare import connect, differences

import __spark_entry__ as entry
from inkweave.plans.catalog import QUERIES
from inkweave.plans.oracle import ORACLE

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, tables):
    assert differences(QUERIES[name](spark, FOLDER), tables, ORACLE[name]) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
