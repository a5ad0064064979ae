"""Headline figures over completed orders."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelark.functions.labels import customer_type
from tradelark.functions.numbers import NullSums, percent, ratio, total
from tradelark.market import Market
from tradelark.operators.cleaning import PURCHASED, late_flag
from tradelark.operators.master import BUYER, Unmatched, completed_market, order_facts, with_buyer

# What an order without delivery or promised date means for a late rate: it is
# left out, or it counts as on time.
LatePolicy = Literal["exclude", "as_on_time"]


def late_for_rate(policy: LatePolicy) -> Column:
    return late_flag() if policy == "exclude" else F.coalesce(late_flag(), F.lit(False))


def business_kpis(
    market: Market,
    *,
    late_policy: LatePolicy = "exclude",
    unmatched: Unmatched = "keep",
    null_sums: NullSums = "zero",
) -> DataFrame:
    """One row: orders, buyers, revenue, order value, repeat share, late share, review mean."""
    facts = order_facts(
        completed_market(market),
        items=True,
        payments=True,
        reviews=True,
        null_sums=null_sums,
    )
    score = F.col("review_score").cast("decimal(18,12)")
    late = late_for_rate(late_policy)
    # Customer ids are summed up before they meet their buyers, and buyers before the
    # whole: distinct and repeat buyers then are plain counts.
    per_customer = facts.groupBy("customer_id").agg(
        F.count("*").alias("orders"),
        total("merchandise_value", "null").alias("merchandise"),
        total("payment_value", "null").alias("paid"),
        F.sum(score).alias("score_sum"),
        F.count(score).alias("scored"),
        F.sum(late.cast("bigint")).alias("late"),
        F.count(late).alias("dated"),
    )
    per_buyer = with_buyer(per_customer, market.customers, unmatched).groupBy(BUYER).agg(
        total("merchandise", "null").alias("merchandise"),
        total("paid", "null").alias("paid"),
        *[F.sum(name).alias(name) for name in ("orders", "score_sum", "scored", "late", "dated")],
    )
    known = F.col(BUYER).isNotNull()
    sums = per_buyer.agg(
        F.coalesce(F.sum("orders"), F.lit(0)).alias("delivered_orders"),
        F.count(BUYER).alias("unique_customers"),
        total("merchandise", null_sums).alias("merchandise_revenue"),
        total("paid", null_sums).alias("customer_payments"),
        F.count_if(known & (F.col("orders") > 1)).alias("repeat_customers"),
        ratio(F.sum("score_sum"), F.sum("scored")).alias("average_review_score"),
        percent(F.sum("late"), F.sum("dated")).alias("late_delivery_rate"),
    )
    return sums.select(
        "delivered_orders",
        "unique_customers",
        "merchandise_revenue",
        "customer_payments",
        ratio(F.col("customer_payments"), F.col("delivered_orders")).alias("average_order_value"),
        "repeat_customers",
        percent(F.col("repeat_customers"), F.col("unique_customers")).alias("repeat_customer_rate"),
        "late_delivery_rate",
        "average_review_score",
    )


def buyer_orders(
    market: Market,
    *,
    spend: bool = False,
    unmatched: Unmatched = "keep",
    null_buyers: Literal["keep", "drop"] = "drop",
    null_sums: NullSums = "zero",
) -> DataFrame:
    """Per buyer: completed orders, and with ``spend`` total spend and last purchase."""
    facts = order_facts(completed_market(market), payments=spend, null_sums=null_sums)
    spent = [total("payment_value", null_sums).alias("total_spend"), F.max(PURCHASED).alias("last_purchase")]
    per_customer = facts.groupBy("customer_id").agg(F.count("*").alias("orders"), *(spent if spend else []))
    bought = with_buyer(per_customer, market.customers, unmatched)
    if null_buyers == "drop":
        bought = bought.where(F.col(BUYER).isNotNull())
    extra = [total("total_spend", null_sums).alias("total_spend"), F.max("last_purchase").alias("last_purchase")]
    return bought.groupBy(BUYER).agg(F.sum("orders").alias("orders"), *(extra if spend else []))


def repeat_rate(market: Market) -> DataFrame:
    buyers = buyer_orders(market, unmatched="drop", null_buyers="keep")
    return buyers.agg(
        F.count("*").alias("total_customers"), F.count_if(F.col("orders") > 1).alias("repeat_customers")
    ).select("*", percent(F.col("repeat_customers"), F.col("total_customers")).alias("repeat_customer_rate_pct"))


def return_behaviour(market: Market) -> DataFrame:
    return buyer_orders(market).agg(
        F.count_if(F.col("orders") == 1).alias("one_time_customers"),
        F.count_if(F.col("orders") > 1).alias("repeat_customers"),
        F.count_if(F.col("orders") >= 3).alias("three_plus_customers"),
    )


def purchase_frequency(market: Market) -> DataFrame:
    """Buyers per number of completed orders."""
    buyers = buyer_orders(market, unmatched="drop", null_buyers="keep")
    return (
        buyers.groupBy(F.col("orders").alias("order_count"))
        .agg(F.count("*").alias("customers"))
        .orderBy("order_count")
    )


def customer_type_summary(
    market: Market,
    *,
    unmatched: Unmatched = "keep",
    null_buyers: Literal["keep", "drop"] = "drop",
    null_sums: NullSums = "zero",
) -> DataFrame:
    """Repeat against one-time buyers. With null sums, buyers without payment leave the mean."""
    buyers = buyer_orders(market, spend=True, unmatched=unmatched, null_buyers=null_buyers, null_sums=null_sums)
    return (
        buyers.groupBy(customer_type(F.col("orders")).alias("customer_type"))
        .agg(
            F.count("*").alias("customers"),
            F.sum("orders").alias("orders"),
            total("total_spend", null_sums).alias("revenue"),
            ratio(total("total_spend", "null"), F.count("total_spend")).alias("average_customer_spend"),
        )
        .orderBy(F.desc_nulls_last("revenue"), "customer_type")
    )


def ranked_customers(market: Market, top: int = 20) -> DataFrame:
    """Buyers whose spend is among the ``top`` highest amounts; equal amounts share a rank."""
    buyers = buyer_orders(market, spend=True, unmatched="drop", null_buyers="keep", null_sums="null")
    # Only the highest amounts are ranked, each once; buyers then look their amount up, so
    # any number of buyers with equal spend stays spread over the tasks.
    highest = buyers.select("total_spend").distinct().orderBy(F.desc_nulls_last("total_spend")).limit(top)
    amounts = highest.withColumn("spend_rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("total_spend"))))
    ranked = buyers.join(
        F.broadcast(amounts.withColumnRenamed("total_spend", "_amount")), F.col("total_spend").eqNullSafe(F.col("_amount"))
    )
    return ranked.select("spend_rank", BUYER, "orders", "total_spend", "last_purchase").orderBy("spend_rank", BUYER)
