"""Distinct counts as bitmaps, and the reports that are made of them."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.helpers import by, market, order, records
from tests.test_plans import executed, optimized
from tradelark.functions.bitmaps import counted, merged, numbered_keys, seen
from tradelark.operators import cleaning, seller
from tradelark.plans.refresh import Refresh

STATES = ("SP", "RJ", "MG", None)


def raw_shop(spark, *, orders=300, sellers=24):
    """Orders with several sellers, a hot order, repeated orders and sellers, lines without an order, no state."""
    chance = random.Random(7)
    headers = [order(f"o{at}", status=chance.choice(["delivered", "delivered", "canceled"])) for at in range(orders)]
    headers += [order("o1"), order("o1", status="canceled"), order(None)]
    places = [(f"s{at}", "x", STATES[at % 4]) for at in range(sellers)] + [("s1", "y", "RJ"), ("s1", "y", "MG"), (None, "x", "SP")]
    sold = [(f"o{chance.randrange(orders + 9)}", at, "p", f"s{chance.randrange(sellers + 2)}", None, Decimal("1.25"), None) for at in range(900)]
    sold += [("o2", at, "p", f"s{at % sellers}", None, Decimal("2.00"), None) for at in range(600)]
    sold += [(None, 1, "p", "s1", None, Decimal("9.00"), None), ("o3", 1, "p", None, None, Decimal("9.00"), None)]
    made = market(spark, orders=headers, order_items=sold, sellers=places)
    return made.having(geolocation=made.geolocation.withColumn("source_position", F.lit(0)))


def shop(spark):
    return cleaning.clean_market(raw_shop(spark))


def plain_states(shop):
    """Orders per state, counted distinct."""
    lines = seller.seller_order(shop).where("seller_state IS NOT NULL")
    return lines.groupBy("seller_state").agg(
        F.countDistinct("seller_id").alias("sellers"),
        F.countDistinct("order_id").alias("orders"),
        F.sum("merchandise_revenue").cast("decimal(18,2)").alias("merchandise_revenue"),
    )


def test_numbers_follow_from_the_keys(spark):
    keys = spark.createDataFrame([(f"k{at}",) for at in range(1000)] + [("k1",), (None,)], "k string")
    found = {row.k: row.number for row in numbered_keys(keys, "k", 7).collect()}
    assert len(found) == len(set(found.values())) == 1000 and None not in found
    again = {row.k: row.number for row in numbered_keys(keys.repartition(13), "k", 7).collect()}
    assert again == found
    # Without gaps within a partition of the exchange.
    parts = {}
    for number in found.values():
        parts.setdefault(number >> 40, []).append(number & ((1 << 40) - 1))
    assert sorted(parts) == list(range(7))
    assert all(sorted(numbers) == list(range(1, len(numbers) + 1)) for numbers in parts.values())
    for wrong in (0, 1 << 23):
        with pytest.raises(ValueError):
            numbered_keys(keys, "k", wrong)


@pytest.mark.parametrize("partitions", [1, 3, 200])
def test_counts_of_any_grouping_are_exact(spark, partitions):
    """More keys than a block holds, groups that overlap, and rows in no order of the numbers."""
    rows = spark.range(200_000).selectExpr("id % 70001 AS k", "CAST(id % 3 AS string) AS g", "CAST(id % 5 AS string) AS h")
    rows = rows.join(numbered_keys(rows, "k", partitions), "k").repartition(5)
    fine = seen(rows, ["g", "h"])
    for groups in (["g", "h"], ["g"], []):
        wanted = rows.groupBy(*groups).agg(F.countDistinct("k").alias("n"))
        assert sorted(map(str, records(counted(merged(fine, groups), groups, "n")))) == sorted(map(str, records(wanted)))
    twice = merged(fine.unionByName(fine), ["g"])
    assert sorted(map(str, records(counted(twice, ["g"], "n")))) == sorted(map(str, records(counted(merged(fine, ["g"]), ["g"], "n"))))


def test_no_rows_no_groups(spark):
    rows = spark.createDataFrame([("a", None)], "g string, number bigint")
    assert counted(seen(rows, ["g"]), ["g"], "n").collect() == []
    assert seller.seller_state_summary(cleaning.clean_market(market(spark))).collect() == []


def test_states_equal_plain_distinct_counts(spark):
    made = shop(spark)
    assert by(seller.seller_state_summary(made), "seller_state") == by(plain_states(made), "seller_state")


@pytest.mark.parametrize("partitions", [1, 8, 31])
def test_regions_are_merged_from_states(spark, partitions):
    made = shop(spark)
    stored = seller.seller_state_orders(made, numbered_keys(made.orders, "order_id", partitions))
    region = F.when(F.col("seller_state").isin("SP", "RJ"), "coast").otherwise("inland").alias("region")
    lines = seller.seller_order(made).where("seller_state IS NOT NULL")
    wanted = {row.region: row.n for row in lines.groupBy(region).agg(F.countDistinct("order_id").alias("n")).collect()}
    found = {row.region: row.n for row in counted(merged(stored, [region]), ["region"], "n").collect()}
    assert found == wanted and len(found) == 2
    # Orders that sold from both regions are in each count, and once in the whole.
    whole = counted(merged(stored, []), [], "n").first().n
    assert whole == lines.select("order_id").distinct().count() < sum(found.values())


def test_refresh_counts_stored_orders_in_their_buckets(spark, tmp_path):
    """The stored numbers meet the stored lines without an exchange of orders; bitmaps and report agree with the query."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        refresh = Refresh(spark, str(tmp_path), buckets=3)
        clean = refresh.clean(raw_shop(spark))
        numbers = refresh.order_numbers(clean)
        plan = executed(seller.seller_state_orders(clean, numbers))
        assert "Exchange" in plan and "hashpartitioning(order_id" not in plan
        refresh.state_table(clean)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        if before is not None:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    report = spark.read.parquet(f"{tmp_path}/reports/seller_state_summary")
    assert by(report, "seller_state") == by(plain_states(clean), "seller_state")
    stored = spark.read.parquet(f"{tmp_path}/master/seller_state_orders")
    assert {row.block for row in stored.collect()} <= {1 + (at << 25) for at in range(3)}


def test_no_values_of_orders_are_shuffled_by_state(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        frame = seller.seller_state_summary(shop(spark))
        plan, logical = executed(frame), optimized(frame)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Expand" not in logical
    exchanges = [line for line in plan.splitlines() if "hashpartitioning(seller_state" in line]
    assert exchanges and not any("order_id" in line for line in exchanges)
