"""Per-order summaries and the table with one row per order.

Items, payments and reviews are reduced to one row per order before any join:
totals cannot multiply, the reduction starts before the shuffle, and every join
below has a unique right side.
"""

from __future__ import annotations

from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelark.functions.labels import COMPLETED
from tradelark.functions.numbers import NullSums, mean_of_whole, total
from tradelark.market import Market
from tradelark.operators.cleaning import delay_features

# What happens to rows whose dimension row is missing.
Unmatched = Literal["keep", "drop"]

BUYER = "customer_unique_id"


def join_kind(unmatched: Unmatched) -> str:
    return {"keep": "left", "drop": "inner"}[unmatched]


def item_summary(items: DataFrame, null_sums: NullSums = "zero") -> DataFrame:
    """Per order: items, merchandise, freight, distinct products, distinct sellers.

    Each distinct count runs by itself beside the sums, over the two columns it needs.
    Counted together, every item would be sent once per count and once for the sums, at
    full width and dealt by all their columns; apart, each is combined by order and value, items
    that are stored by order meet without an exchange, and reports that do not use a
    count do not compute it either.
    """
    known = items.where(F.col("order_id").isNotNull())
    sums = known.groupBy("order_id").agg(
        F.count("order_item_id").alias("item_count"),
        total("price", null_sums).alias("merchandise_value"),
        total("freight_value", null_sums).alias("freight_value"),
    )
    products = known.groupBy("order_id").agg(F.countDistinct("product_id").alias("unique_products"))
    sellers = known.groupBy("order_id").agg(F.countDistinct("seller_id").alias("unique_sellers"))
    return sums.join(products, "order_id", "left").join(sellers, "order_id", "left")


def payment_summary(payments: DataFrame, null_sums: NullSums = "zero") -> DataFrame:
    return (
        payments.where(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(
            total("payment_value", null_sums).alias("payment_value"),
            F.count("payment_sequential").alias("payment_records"),
            F.max("payment_installments").alias("max_installments"),
        )
    )


def review_summary(reviews: DataFrame) -> DataFrame:
    return (
        reviews.where(F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(mean_of_whole(F.col("review_score")).alias("review_score"))
    )


def order_facts(
    market: Market,
    *,
    buyer: bool = False,
    items: bool = False,
    payments: bool = False,
    reviews: bool = False,
    unmatched: Unmatched = "keep",
    null_sums: NullSums = "zero",
) -> DataFrame:
    """Orders with only the parts a report asks for: buyer columns and summaries.

    Everything keyed by order comes first and shares one partitioning; the buyer,
    under another key, comes last.
    """
    facts = market.orders
    if items:
        facts = facts.join(item_summary(market.order_items, null_sums), "order_id", "left")
    if payments:
        facts = facts.join(payment_summary(market.payments, null_sums), "order_id", "left")
    if reviews:
        facts = facts.join(review_summary(market.reviews), "order_id", "left")
    if buyer:
        facts = facts.join(market.customers, "customer_id", join_kind(unmatched))
    return facts


def with_buyer(sums: DataFrame, customers: DataFrame, unmatched: Unmatched) -> DataFrame:
    """Rows per customer id with their buyer: one row per id joins, not one per order."""
    return sums.join(customers.select("customer_id", BUYER), "customer_id", join_kind(unmatched))


def completed(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("order_status") == COMPLETED)


def completed_market(market: Market) -> Market:
    """The market seen from completed orders only."""
    return market.having(orders=completed(market.orders))


def customer_order_counts(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Completed orders per known buyer."""
    bought = completed(orders).join(customers.select("customer_id", BUYER), "customer_id")
    return (
        bought.where(F.col(BUYER).isNotNull())
        .groupBy(BUYER)
        .agg(F.count("*").alias("customer_delivered_orders"))
    )


def order_master(market: Market) -> DataFrame:
    """One row per order: order, buyer, summaries, day counts, late flag, repeat flag."""
    facts = order_facts(market, buyer=True, items=True, payments=True, reviews=True).withColumns(delay_features())
    counts = customer_order_counts(market.orders, market.customers)
    orders_of_buyer = F.coalesce("customer_delivered_orders", F.lit(0).cast("bigint"))
    return (
        facts.join(counts, BUYER, "left")
        .withColumn("customer_delivered_orders", orders_of_buyer)
        .withColumn("is_repeat_customer", F.col("customer_delivered_orders") > 1)
    )


def master_validation(orders: DataFrame, master: DataFrame) -> DataFrame:
    """Row counts in and out, repeated ids, and how many orders have each part.

    The query fails when the master does not have exactly one row per input order.
    """

    def known(name: str) -> Column:
        return F.count_if(F.col(name).isNotNull())

    per_order = master.groupBy("order_id").agg(
        F.count("*").alias("n"),
        known("item_count").alias("items"),
        known("payment_value").alias("payments"),
        known("review_score").alias("reviews"),
    )
    out = per_order.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("master_rows"),
        F.count("order_id").alias("unique_orders"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_orders"),
        F.coalesce(F.sum("items"), F.lit(0)).alias("orders_with_items"),
        F.coalesce(F.sum("payments"), F.lit(0)).alias("orders_with_payments"),
        F.coalesce(F.sum("reviews"), F.lit(0)).alias("orders_with_reviews"),
    )
    counted = out.withColumn("order_rows", orders.agg(F.count("*")).scalar())
    preserved = F.col("order_rows") == F.col("master_rows")
    checked = F.when(preserved, F.col("order_rows")).otherwise(
        F.raise_error(F.lit("the order master does not keep one row per order")).cast("bigint")
    )
    return counted.select(
        checked.alias("order_rows"),
        "master_rows",
        "unique_orders",
        "duplicate_orders",
        "orders_with_items",
        "orders_with_payments",
        "orders_with_reviews",
    )
