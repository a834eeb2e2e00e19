"""Every registered query against its SQL, and the shape of the driver contract."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from paperloom.plans.queries import QUERIES
from conftest import SF_DIR
from oracle_check import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    # the core library's own; the subpackage tests those without SQL by brute force
    assert set(QUERIES) <= set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    ok, note = compare(spark, con, driver.queries()[name], driver.oracle_sql()[name], SF_DIR)
    assert ok, note


def test_entry(spark):
    assert driver.entry(spark).columns == ["label_id", "papers", "confidence_sum"]
