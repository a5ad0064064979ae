"""Product categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelark.functions.clock import DayMode
from tradelark.functions.labels import UNKNOWN_CATEGORY
from tradelark.functions.numbers import total
from tradelark.market import Market
from tradelark.operators.cleaning import DELIVERED, PROMISED, PURCHASED
from tradelark.operators.master import Unmatched, completed, join_kind
from tradelark.operators.order_lines import line_sums, line_totals, order_quality, spend_per_order, with_order

CATEGORY = "product_category_name_english"


def _order_category(market: Market, unmatched: Unmatched) -> DataFrame:
    """Counting products per order takes three hash tables of nearly every line in one task.

    Joined rows are dealt anew by all that is counted, and to as many tasks as the session
    shuffles into: left where the join has them, or in fewer tasks of the size that suits an
    exchange, those tables take 28 times the bytes that the task read. Products are the hashed
    side of the join, so that lines are not sorted either.
    """
    categories = market.products.select("product_id", CATEGORY).hint("shuffle_hash")
    items = market.order_items.join(categories, "product_id", join_kind(unmatched)).withColumn(
        CATEGORY, F.coalesce(CATEGORY, F.lit(UNKNOWN_CATEGORY))
    )
    partitions = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = items.repartition(partitions, "order_id", CATEGORY, "product_id")
    lines = line_sums(dealt, CATEGORY, F.countDistinct("product_id").alias("unique_products"))
    return with_order(lines, market)


def order_category(market: Market, *, unmatched: Unmatched = "keep") -> DataFrame:
    """Per order and category: units, revenue, freight, products, order facts and review.

    An item whose product is missing counts as 'unknown', or is left out.
    """
    return _order_category(market, unmatched).drop(PURCHASED, DELIVERED, PROMISED)


def category_performance(
    market: Market, *, days: DayMode = "floor_days", unmatched: Unmatched = "keep"
) -> DataFrame:
    """Per category over completed orders: volume, revenue, reviews, delivery, late share."""
    return (
        completed(_order_category(market, unmatched))
        .groupBy(CATEGORY)
        .agg(*line_totals(), total("freight_value").alias("freight_value"), *order_quality(days))
        .withColumn("avg_category_spend_per_order", spend_per_order())
    )


def category_late_rate(market: Market) -> DataFrame:
    """Late share per category, from the same single aggregation."""
    return category_performance(market).select(CATEGORY, "late_delivery_rate")


def top_categories_revenue(market: Market, n: int = 10, **variant) -> DataFrame:
    return by_revenue(category_performance(market, **variant), n)


def top_categories_volume(market: Market, n: int = 10) -> DataFrame:
    return by_volume(category_performance(market), n)


def lowest_reviewed_categories(market: Market, *, min_orders: int = 500, n: int = 10, **variant) -> DataFrame:
    return lowest_reviewed(category_performance(market, **variant), min_orders, n)


def late_categories(market: Market, *, min_orders: int = 500, n: int = 10) -> DataFrame:
    return most_late(category_performance(market), min_orders, n)


# The lists above from a finished table of ``category_performance``.


def by_revenue(table: DataFrame, n: int = 10) -> DataFrame:
    return table.orderBy(F.desc("merchandise_revenue"), CATEGORY).limit(n)


def by_volume(table: DataFrame, n: int = 10) -> DataFrame:
    return table.orderBy(F.desc("units_sold"), CATEGORY).limit(n)


def lowest_reviewed(table: DataFrame, min_orders: int = 500, n: int = 10) -> DataFrame:
    major = table.where(F.col("orders") >= min_orders)
    return major.orderBy(F.asc_nulls_last("average_review_score"), CATEGORY).limit(n)


def most_late(table: DataFrame, min_orders: int = 500, n: int = 10) -> DataFrame:
    major = table.where(F.col("orders") >= min_orders)
    return major.orderBy(F.desc_nulls_last("late_delivery_rate"), CATEGORY).limit(n)
