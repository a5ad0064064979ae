"""The shape of plans and what must not depend on them."""

from __future__ import annotations

import re
from decimal import Decimal as D

import pytest

from checks.compare import sorted_rows
from tests.helpers import market, order
from tradelark.operators import category, cleaning, cohort, headline, master, performance, seller
from tradelark.plans.catalog import catalog
from tradelark.sources.tpch import load_market

QUERIES = catalog()


def executed(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def optimized(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cross_join(spark, small, name):
    plan = executed(QUERIES[name](spark, small))
    for operator in ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan, operator


def test_only_used_columns_are_read(spark, small):
    clean = cleaning.clean_market(load_market(spark, small))
    plan = executed(performance.state_performance(clean))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    read = {name.split(":")[0] for schema in schemas for name in schema.split(",")}
    assert read == {
        "o_orderkey", "o_custkey", "o_orderstatus", "c_custkey", "c_nationkey", "n_nationkey", "n_name",
        "l_orderkey", "l_quantity", "l_extendedprice",
    }


def test_status_filter_reaches_the_scan(spark, tmp_path):
    stored = str(tmp_path / "orders")
    market(spark, orders=[order("o1")]).orders.write.parquet(stored)
    clean = cleaning.clean_market(market(spark).having(orders=spark.read.parquet(stored)))
    plan = executed(seller.seller_performance(clean))
    assert "EqualTo(order_status,delivered)" in plan


def test_unused_parts_are_not_joined(spark):
    clean = cleaning.clean_market(market(spark))
    facts = master.order_facts(clean, items=True, payments=True, reviews=True).select("order_id")
    assert "Join" not in optimized(facts)
    without_variety = master.order_facts(clean, items=True).select("order_id", "merchandise_value")
    assert "Expand" not in optimized(without_variety)


def test_top_n_does_not_sort_everything(spark, small):
    assert "TakeOrderedAndProject" in executed(QUERIES["top_sellers"](spark, small))
    assert "TakeOrderedAndProject(limit=20" in executed(QUERIES["ranked_customers"](spark, small))


def test_ranking_for_shares_sees_only_the_largest(spark):
    clean = cleaning.clean_market(market(spark))
    plan = executed(seller.seller_concentration(seller.seller_revenue(clean)))
    assert "TakeOrderedAndProject(limit=100" in plan


def test_distinct_buyers_are_spread_by_buyer(spark):
    """A state with a third of all orders is shuffled by (state, buyer), not by state alone."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = executed(performance.state_performance(cleaning.clean_market(market(spark))))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = [re.sub(r"#\d+L?", "", found) for found in re.findall(r"hashpartitioning\(([^)]*)\)", plan)]
    assert any(found.startswith("customer_state, customer_unique_id") for found in keys)


@pytest.mark.parametrize(
    "name", ["business_kpis", "category_performance", "seller_performance", "monthly_performance", "segment_summary", "geo_lookup"]
)
def test_partitioning_does_not_change_a_bit(spark, small, name):
    found = []
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(key) for key in names]
    try:
        for partitions in ("1", "37"):
            for key, value in zip(names, (partitions, "false")):
                spark.conf.set(key, value)
            frame = QUERIES[name](spark, small)
            assert [spark.conf.get(key) for key in names] == [partitions, "false"]
            found.append(sorted_rows(frame.columns, frame.collect()))
    finally:
        for key, value in zip(names, before):
            spark.conf.set(key, value)
    assert found[0] == found[1]


def test_the_wanted_partitions_really_run(spark, small):
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(key) for key in names]
    try:
        for key, value in zip(names, ("37", "false")):
            spark.conf.set(key, value)
        assert QUERIES["customer_order_counts"](spark, small).rdd.getNumPartitions() == 37
    finally:
        for key, value in zip(names, before):
            spark.conf.set(key, value)


def test_a_dominant_key_changes_nothing(spark):
    """Half of all orders belong to one buyer, and one order has half of all items."""
    from decimal import Decimal

    count = 400
    customers = [("hot", "hot", "x", "SP")] + [(f"c{at}", f"b{at % 50}", "x", f"S{at % 7}") for at in range(count // 2)]
    orders = [order(f"o{at}", "hot" if at % 2 else f"c{at // 2}", bought=f"2018-01-{at % 28 + 1:02d}") for at in range(count)]
    items = [(f"o{at % count if at % 2 else 0}", at, f"p{at % 9}", f"s{at % 11}", None, Decimal("1.25"), Decimal("0.50")) for at in range(2000)]
    payments = [(f"o{at}", 1, "credit_card", 1, Decimal("2.50")) for at in range(count)]
    clean = cleaning.clean_market(market(spark, customers=customers, orders=orders, order_items=items, payments=payments))
    orders_seen = {row.customer_unique_id: row.orders for row in headline.buyer_orders(clean).collect()}
    assert orders_seen["hot"] == 200 and sum(orders_seen.values()) == count
    first = master.item_summary(clean.order_items).where("order_id = 'o0'").first()
    assert (first.item_count, first.merchandise_value) == (1000, Decimal("1250.00"))
    assert (first.unique_products, first.unique_sellers) == (9, 11)


@pytest.mark.parametrize("name", ["business_kpis", "repeat_rate", "return_behaviour", "customer_type_summary", "cohort_activity", "rfm_base"])
def test_orders_are_summed_per_customer_before_they_meet_their_buyer(spark, name):
    """A customer with half of all orders reaches the join as one row (or one per month)."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        clean = cleaning.clean_market(market(spark, customers=[("c", "b", "x", "SP")], orders=[order("o1", "c")]))
        from tradelark.plans.catalog import CLEAN

        plan = optimized(CLEAN[name](clean))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    joins = [at for at, line in enumerate(lines) if re.search(r"Join .*customer_id#\d+ = customer_id#\d+", line)]
    assert joins
    for at in joins:
        child = next(line for line in lines[at + 1 :] if not re.search(r"[:+\- ]*(Project|Filter)", line.split("[")[0].split("(")[0]))
        assert "Aggregate [customer_id" in child, child


@pytest.mark.parametrize("make", [cohort.cohort_activity, lambda m: cohort.cohort_retention(cohort.cohort_activity(m))])
def test_cohorts_aggregate_numbers_of_fixed_width(spark, make):
    clean = cleaning.clean_market(market(spark, customers=[("c", "b", "x", "SP")], orders=[order("o1", "c")]))
    plan = make(clean)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "SortAggregate" not in plan


def test_products_of_an_order_are_not_counted_in_the_tasks_of_the_join(spark, small):
    plan = executed(QUERIES["order_category"](spark, small))
    counted = plan[plan.index("partial_count(distinct") :]
    before_join = counted[: re.search("(Hash|Merge)Join", counted).start()]
    # Dealt by all that is counted, and not gathered again into fewer, larger tasks.
    assert re.search(r"Exchange hashpartitioning\(order_id#\w+, product_category_name_english#\w+, product_id#\w+, 4\), REPARTITION_BY_NUM", before_join)


def test_counted_products_of_repeated_and_missing_rows(spark):
    items = [("o1", at, product, D("1.00"), D("0.50")) for at, product in enumerate(["p1", "p1", "p2", None, "p3", None])]
    items += [("hot", at, f"p{at % 7}", D("1.00"), None) for at in range(200)] + [(None, 1, "p1", D("1.00"), None)]
    shop = market(spark).having(
        order_items=spark.createDataFrame(items, "order_id string, order_item_id int, product_id string, price decimal(18,2), freight_value decimal(18,2)"),
        # p2 is there twice, p3 in two categories, p4 to p6 are not there at all.
        products=spark.createDataFrame(
            [("p0", "a"), ("p1", "a"), ("p2", "a"), ("p2", "a"), ("p3", "a"), ("p3", "b"), (None, "c")], "product_id string, product_category_name_english string"
        ),
    )
    found = {(row[0], row[1]): (row.units_sold, row.merchandise_revenue, row.freight_value, row.unique_products) for row in category.order_category(shop).collect()}
    assert found == {
        ("o1", "a"): (5, D("5.00"), D("2.50"), 3),
        ("o1", "b"): (1, D("1.00"), D("0.50"), 1),
        ("o1", "unknown"): (2, D("2.00"), D("1.00"), 0),
        ("hot", "a"): (29 + 29 + 58 + 29, D("145.00"), D("0.00"), 4),
        ("hot", "b"): (29, D("29.00"), D("0.00"), 1),
        ("hot", "unknown"): (28 * 3, D("84.00"), D("0.00"), 3),
    }
