"""Order lines summed per order and one more dimension (category or seller).

The lines are combined straight off the scan, before they meet an order: a
frequent order id reaches the join as at most one row per category or seller.
Review, delivery days and lateness belong to the order and are copied whole to
each of its rows; a mean over such rows is a mean over (order, dimension) pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelark.functions.clock import DayMode
from tradelark.functions.numbers import mean_of_scores, ratio, share_of_true, total
from tradelark.market import Market
from tradelark.operators.cleaning import DELIVERED, PROMISED, PURCHASED, delay_features, late_flag
from tradelark.operators.master import review_summary
from tradelark.operators.performance import mean_delivery_days


def line_sums(items: DataFrame, dimension: str, *extra: Column) -> DataFrame:
    return (
        items.where(F.col("order_id").isNotNull() & F.col(dimension).isNotNull())
        .groupBy("order_id", dimension)
        .agg(
            F.count("order_item_id").alias("units_sold"),
            total("price").alias("merchandise_revenue"),
            total("freight_value").alias("freight_value"),
            *extra,
        )
    )


def with_order(lines: DataFrame, market: Market) -> DataFrame:
    """Add status, delivery facts and review of the order; lines without order stay."""
    orders = market.orders.select(
        "order_id",
        "order_status",
        PURCHASED,
        DELIVERED,
        PROMISED,
        *[column.alias(name) for name, column in delay_features().items()],
    )
    return lines.join(orders, "order_id", "left").join(review_summary(market.reviews), "order_id", "left")


def order_quality(days: DayMode) -> list[Column]:
    """Review mean, delivery days and late share over (order, dimension) rows."""
    return [
        mean_of_scores("review_score").alias("average_review_score"),
        mean_delivery_days(days).alias("average_delivery_days"),
        share_of_true(late_flag()).alias("late_delivery_rate"),
    ]


def line_totals() -> list[Column]:
    """Orders (one row each, so a plain count), units and revenue."""
    return [
        F.count("*").alias("orders"),
        F.sum("units_sold").alias("units_sold"),
        total("merchandise_revenue").alias("merchandise_revenue"),
    ]


def spend_per_order() -> Column:
    return ratio(F.col("merchandise_revenue"), F.col("orders"))
