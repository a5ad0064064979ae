"""Months, states and delivery quality of completed orders."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelark.functions.clock import DayMode, floor_days, whole_hours, year_month
from tradelark.functions.labels import LATE, ON_TIME
from tradelark.functions.numbers import (
    NullSums,
    mean_of_scores,
    mean_of_whole,
    percent,
    ratio,
    score_sum,
    share_of_true,
    total,
)
from tradelark.market import Market
from tradelark.operators.cleaning import DELIVERED, MONTH, PROMISED, PURCHASED, late_flag
from tradelark.operators.master import BUYER, Unmatched, completed_market, order_facts, with_buyer

NullGroups = Literal["drop", "keep"]


def mean_delivery_days(mode: DayMode) -> Column:
    """Mean time from purchase to delivery; orders without delivery are left out."""
    if mode == "hours":
        return mean_of_whole(whole_hours(F.col(DELIVERED), F.col(PURCHASED))) / 24
    return mean_of_whole(floor_days(F.col(DELIVERED), F.col(PURCHASED)))


def _within(facts: DataFrame, period: tuple[str, str] | None) -> DataFrame:
    """Keep purchases from the first moment on and before the second.

    Cleaned orders also tell their month, which they may be stored by: what it says is
    implied, but lets the scan leave out the files of other months.
    """
    if period is None:
        return facts
    start, end = (F.lit(bound).cast("timestamp_ntz") for bound in period)
    inside = (F.col(PURCHASED) >= start) & (F.col(PURCHASED) < end)
    if MONTH in facts.columns:
        inside &= F.col(MONTH).between(*(bound[:7] for bound in period))
    return facts.where(inside)


def _with_growth(months: DataFrame, month: str) -> DataFrame:
    """Order value, and growth over the previous month that has orders.

    The window runs on one partition, over one row per month.
    """
    previous = F.lag("revenue").over(Window.orderBy(month))
    return months.withColumns(
        {
            "average_order_value": ratio(F.col("revenue"), F.col("orders")),
            "revenue_growth_pct": percent(F.col("revenue") - previous, previous),
        }
    )


def _per_customer_and_month(facts: DataFrame, *sums: Column) -> DataFrame:
    """Orders (and sums) of each customer id and month, so that few rows meet their buyer."""
    bought = facts.withColumn(MONTH, year_month(F.col(PURCHASED)))
    return bought.groupBy("customer_id", MONTH).agg(F.count("*").alias("orders"), *sums)


def monthly_performance(market: Market) -> DataFrame:
    """Per purchase month: orders, buyers, revenue, merchandise, reviews, order value, growth."""
    facts = order_facts(completed_market(market), items=True, payments=True, reviews=True)
    sums = _per_customer_and_month(
        facts.where(F.col(PURCHASED).isNotNull()),
        total("payment_value").alias("revenue"),
        total("merchandise_value").alias("merchandise_value"),
        score_sum("review_score").alias("scores"),
        F.count("review_score").alias("scored"),
    )
    months = with_buyer(sums, market.customers, "keep").groupBy(MONTH).agg(
        F.sum("orders").alias("orders"),
        F.countDistinct(BUYER).alias("customers"),
        total("revenue").alias("revenue"),
        total("merchandise_value").alias("merchandise_value"),
        ratio(F.sum("scores"), F.sum("scored")).alias("average_review_score"),
    )
    return _with_growth(months, MONTH).orderBy(MONTH)


def monthly_growth(market: Market, period: tuple[str, str] | None = None) -> DataFrame:
    """Per month of the period: orders, buyers, revenue, order value, growth.

    Orders without a customer row are left out and a month without payments has
    null revenue.
    """
    orders = _within(completed_market(market).orders, period)
    facts = order_facts(market.having(orders=orders), payments=True, null_sums="null")
    sums = _per_customer_and_month(facts, total("payment_value", "null").alias("revenue"))
    months = with_buyer(sums, market.customers, "drop").groupBy(F.col(MONTH).alias("purchase_month")).agg(
        F.sum("orders").alias("orders"),
        F.countDistinct(BUYER).alias("customers"),
        total("revenue", "null").alias("revenue"),
    )
    return _with_growth(months, "purchase_month").orderBy("purchase_month")


def top_months(market: Market, n: int = 5) -> DataFrame:
    return best_months(monthly_performance(market), n)


def best_months(table: DataFrame, n: int = 5) -> DataFrame:
    """The months of highest revenue in a finished table of ``monthly_performance``."""
    return table.orderBy(F.desc("revenue"), "purchase_year_month").limit(n)


def state_performance(
    market: Market,
    *,
    unmatched: Unmatched = "keep",
    null_groups: NullGroups = "drop",
    null_sums: NullSums = "zero",
) -> DataFrame:
    """Per customer state: orders, buyers, revenue, order value; highest revenue first."""
    facts = order_facts(
        completed_market(market), buyer=True, payments=True, unmatched=unmatched, null_sums=null_sums
    )
    if null_groups == "drop":
        facts = facts.where(F.col("customer_state").isNotNull())
    states = facts.groupBy("customer_state").agg(
        F.count("*").alias("orders"),
        F.countDistinct(BUYER).alias("customers"),
        total("payment_value", null_sums).alias("revenue"),
    )
    return states.withColumn("average_order_value", ratio(F.col("revenue"), F.col("orders"))).orderBy(
        F.desc_nulls_last("revenue"), "customer_state"
    )


def top_states(market: Market, n: int = 10, **variant) -> DataFrame:
    return state_performance(market, **variant).limit(n)


def delivery_time_stats(market: Market) -> DataFrame:
    """Mean and median delivery days.

    The exact median keeps one counter per distinct number of days, so its size is
    bounded by the calendar, not by the orders.
    """
    days = floor_days(F.col(DELIVERED), F.col(PURCHASED))
    return completed_market(market).orders.agg(
        mean_of_whole(days).alias("average_delivery_days"), F.median(days).alias("median_delivery_days")
    )


def review_by_lateness(market: Market) -> DataFrame:
    """Mean review of late and of on-time orders; undated orders are left out."""
    facts = order_facts(completed_market(market), reviews=True)
    return (
        facts.withColumn("delivered_late", late_flag())
        .where(F.col("delivered_late").isNotNull())
        .groupBy("delivered_late")
        .agg(mean_of_scores("review_score").alias("average_review_score"))
    )


def _dated(facts: DataFrame) -> DataFrame:
    return facts.where(F.col(DELIVERED).isNotNull() & F.col(PROMISED).isNotNull())


def delivery_status_satisfaction(market: Market, *, days: DayMode = "hours") -> DataFrame:
    """Late against on-time orders: count, mean review, mean delivery days."""
    orders = _dated(completed_market(market).orders)
    facts = order_facts(market.having(orders=orders), reviews=True)
    return facts.groupBy(F.when(late_flag(), LATE).otherwise(ON_TIME).alias("delivery_status")).agg(
        F.count("*").alias("orders"),
        mean_of_scores("review_score").alias("average_review_score"),
        mean_delivery_days(days).alias("average_delivery_days"),
    )


def state_delivery(market: Market, *, min_orders: int = 500, days: DayMode = "hours") -> DataFrame:
    """Delivery quality per customer state with enough dated orders, latest first."""
    orders = _dated(completed_market(market).orders)
    facts = order_facts(market.having(orders=orders), buyer=True, reviews=True, unmatched="drop")
    return (
        facts.groupBy("customer_state")
        .agg(
            F.count("*").alias("delivered_orders"),
            mean_delivery_days(days).alias("average_delivery_days"),
            share_of_true(late_flag()).alias("late_delivery_rate_pct"),
            mean_of_scores("review_score").alias("average_review_score"),
        )
        .where(F.col("delivered_orders") >= min_orders)
        .orderBy(F.desc_nulls_last("late_delivery_rate_pct"), "customer_state")
    )
