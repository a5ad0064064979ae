"""Checks gathered while tables are written equal the queries that scan them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.helpers import market, order, records
from tests.test_buckets import wide_market
from tradelark.operators import audit, cleaning, master
from tradelark.plans import measures
from tradelark.plans.measures import Measured
from tradelark.plans.refresh import Refresh
from tradelark.sources.buckets import Layout


def odd_market(spark):
    """Null keys, repeated order ids, orders without parts, flags of every kind."""
    days = {"delivered": "2018-01-09", "promised": "2018-01-05"}
    orders = [
        order("o1", "c1", **days), order("o1", "c2", delivered="2018-01-02", promised="2018-01-05"), order(None, "c1"),
        order(None, None, bought=None, **days), order("o2", "c9", status=None), order("o3", "c1", status="canceled", bought="1999-12-31 23:59:59"),
    ]
    items = [("o1", 1, "p1", None, None, None, None), ("o9", None, None, "s1", None, None, None), (None, 2, "p2", "s1", None, None, None)]
    tables = market(
        spark, customers=[("c1", "b1", "x", "SP"), ("c2", None, None, None)], orders=orders, order_items=items,
        payments=[("o1", 1, "voucher", 1, None), ("o3", None, None, None, None)], reviews=[("o1", 5, None, None), (None, 1, None, None)],
        geolocation=[("01", 1.0, 2.0, "a", "SP"), (None, 1.0, 2.0, "a", "SP"), ("01", 1.0, 3.0, "a", "SP")],
    )
    return tables.having(geolocation=tables.geolocation.withColumn("source_position", F.lit(0)))


def empty_market(spark):
    tables = market(spark)
    return tables.having(geolocation=tables.geolocation.withColumn("source_position", F.lit(0)))


def rows(frame):
    return sorted(map(str, records(frame)))


@pytest.mark.parametrize("make", [wide_market, odd_market, empty_market])
def test_gathered_checks_equal_the_queries(spark, tmp_path, monkeypatch, make):
    scans = {"contract_check": audit.contract_check, "cleaning_summary": cleaning.cleaning_summary, "master_validation": master.master_validation}
    for module, name in ((audit, "contract_check"), (cleaning, "cleaning_summary"), (master, "master_validation")):
        monkeypatch.setattr(module, name, lambda *_, name=name: pytest.fail(f"{name} scans the tables again"))
    refresh = Refresh(spark, str(tmp_path), buckets=3)
    clean = refresh.clean(make(spark))
    written = refresh.order_table(clean)

    def report(name):
        return spark.read.parquet(f"{tmp_path}/reports/{name}")

    wanted = {
        "contract_check": scans["contract_check"](clean),
        "cleaning_summary": scans["cleaning_summary"](clean),
        "master_validation": scans["master_validation"](clean.orders, written),
    }
    for name, frame in wanted.items():
        found = report(name)
        assert [(f.name, f.dataType) for f in found.schema] == [(f.name, f.dataType) for f in frame.schema], name
        assert rows(found) == rows(frame), name
    assert written.columns == master.order_master(clean).columns
    assert rows(written) == rows(master.order_master(clean))


def test_an_order_table_with_rows_too_many_is_an_error(spark, tmp_path):
    """Two customers of one id: their orders would stand there twice."""
    tables = odd_market(spark)
    twice = tables.having(customers=tables.customers.unionByName(tables.customers))
    refresh = Refresh(spark, str(tmp_path), buckets=2)
    with pytest.raises(ValueError, match="one row per order"):
        refresh.order_table(refresh.clean(twice))


def test_rows_are_counted_after_the_last_exchange(spark):
    """Only there a step that is run anew after a loss does not count twice."""
    orders = cleaning.clean_market(wide_market(spark)).orders
    dealt = measures.clean_measures("orders", orders).on(Layout("order_id", 3, cleaning.MONTH, 2).dealt(orders))
    built = master.order_master(cleaning.clean_market(wide_market(spark)).having(orders=measures.numbered(orders)))
    for frame in (dealt, measures.master_measures().on(built)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert -1 < plan.index("CollectMetrics") < plan.index("Exchange")


def test_numbering_stored_orders_needs_no_exchange(spark, tmp_path):
    clean = Refresh(spark, str(tmp_path), buckets=3).clean(wide_market(spark))
    plan = measures.numbered(clean.orders)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan


def test_numbers_are_counted_where_nothing_was_observed(spark):
    measured = Measured({"odd": F.count_if(F.col("id") % 2 == 1)})
    measured._observation = type("Nothing", (), {"get": {}})()
    assert measured.numbers(spark.range(5)) == {"rows": 5, "odd": 2}
