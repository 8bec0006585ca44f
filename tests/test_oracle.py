"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as driver
from catalog.oracle import ORACLE
from catalog.queries import QUERIES
from oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return connect(SF_DIR)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, tables, name):
    frame = driver.queries()[name](spark, SF_DIR)
    assert compare(frame, tables, driver.oracle_sql()[name]) == ""


def test_entry(spark):
    frame = driver.entry(spark)
    assert len(frame.columns) == 17
    assert frame.count() > 0
