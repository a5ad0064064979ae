"""Every registered query against its SQL, bit by bit, on whole tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as driver
from checks.compare import connect, difference
from checks.oracle import ORACLE
from tradelark.plans.catalog import catalog

QUERIES = catalog()


@pytest.fixture(scope="module")
def database(small):
    connection = connect(small)
    yield connection
    connection.close()


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLE.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, database, small, name):
    assert difference(database, ORACLE[name], QUERIES[name](spark, small)) is None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_sql_yields_plain_types(database, name):
    types = {str(column[1]) for column in database.execute(ORACLE[name]).description}
    assert types <= {"BIGINT", "DOUBLE", "VARCHAR"}


def test_entry_runs(spark):
    frame = driver.entry(spark)
    assert frame.columns == ["purchase_month", "orders", "customers", "revenue", "average_order_value", "revenue_growth_pct"]
    assert frame.count() > 0
