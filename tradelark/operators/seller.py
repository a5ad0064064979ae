"""Sellers."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelark.functions.bitmaps import counted, numbered_keys, seen
from tradelark.functions.clock import DayMode
from tradelark.functions.numbers import percent, total
from tradelark.market import Market
from tradelark.operators.cleaning import DELIVERED, PROMISED, PURCHASED
from tradelark.operators.master import Unmatched, completed, join_kind
from tradelark.operators.order_lines import line_sums, line_totals, order_quality, spend_per_order, with_order

PLACE = ["seller_id", "seller_city", "seller_state"]


def _completed_lines(market: Market) -> DataFrame:
    """One row per completed order and seller, with the facts of the order."""
    return completed(with_order(line_sums(market.order_items, "seller_id"), market))


def _placed(rows: DataFrame, market: Market, unmatched: Unmatched) -> DataFrame:
    return rows.join(market.sellers.select(*PLACE), "seller_id", join_kind(unmatched))


def seller_order(market: Market, *, unmatched: Unmatched = "keep") -> DataFrame:
    """Per completed order and seller: units, revenue, freight, order facts, place, review."""
    return _placed(_completed_lines(market), market, unmatched).drop(PURCHASED, DELIVERED, PROMISED)


def seller_performance(
    market: Market,
    *,
    days: DayMode = "floor_days",
    unmatched: Unmatched = "keep",
    null_places: Literal["drop", "keep"] = "drop",
) -> DataFrame:
    """Per seller: volume, revenue, reviews, delivery, late share.

    By default a seller without city or state is left out.
    """
    # Sellers are summed up before they meet their place: the lines of a seller with
    # a large part of all sales never gather in one join task.
    sums = _completed_lines(market).groupBy("seller_id").agg(*line_totals(), *order_quality(days))
    sellers = _placed(sums, market, unmatched)
    if null_places == "drop":
        sellers = sellers.dropna(subset=PLACE)
    measures = [name for name in sums.columns if name != "seller_id"]
    return sellers.select(*PLACE, *measures, spend_per_order().alias("revenue_per_order"))


def top_sellers(market: Market, n: int = 10, **variant) -> DataFrame:
    return by_revenue(seller_performance(market, **variant), n)


def seller_revenue(market: Market) -> DataFrame:
    """Revenue of every seller with a completed order, known to the seller table or not."""
    return _completed_lines(market).groupBy("seller_id").agg(
        total("merchandise_revenue").alias("merchandise_revenue")
    )


def seller_concentration(revenue: DataFrame, tops: Sequence[int] = (10, 50, 100)) -> DataFrame:
    """Number of sellers and the revenue share of the largest ones.

    ``revenue`` has one row per seller. Only the ``max(tops)`` largest sellers are
    ever ranked; the grand total is an aggregate of its own over the same rows.
    """
    ranked = (
        revenue.select("seller_id", "merchandise_revenue")
        .orderBy(F.desc("merchandise_revenue"), "seller_id")
        .limit(max(tops))
        .withColumn("place", F.row_number().over(Window.orderBy(F.desc("merchandise_revenue"), "seller_id")))
    )
    largest = ranked.agg(
        *[total(F.when(F.col("place") <= n, F.col("merchandise_revenue"))).alias(f"top_{n}") for n in tops]
    )
    overall = revenue.agg(
        F.struct(F.count("*").alias("sellers"), total("merchandise_revenue").alias("revenue")).alias("overall")
    ).scalar()
    return largest.withColumn("overall", overall).select(
        F.col("overall.sellers").alias("active_sellers"),
        *[percent(F.col(f"top_{n}"), F.col("overall.revenue")).alias(f"top_{n}_revenue_share_pct") for n in tops],
    )


def lowest_reviewed_sellers(market: Market, *, min_orders: int = 100, n: int = 10) -> DataFrame:
    return lowest_reviewed(seller_performance(market), min_orders, n)


def late_sellers(market: Market, *, min_orders: int = 100, n: int = 10, **variant) -> DataFrame:
    return most_late(seller_performance(market, **variant), min_orders, n)


# The lists above from a finished table of ``seller_performance``.


def by_revenue(table: DataFrame, n: int = 10) -> DataFrame:
    return table.orderBy(F.desc("merchandise_revenue"), "seller_id").limit(n)


def lowest_reviewed(table: DataFrame, min_orders: int = 100, n: int = 10) -> DataFrame:
    major = table.where(F.col("orders") >= min_orders)
    return major.orderBy(F.asc_nulls_last("average_review_score"), "seller_id").limit(n)


def most_late(table: DataFrame, min_orders: int = 100, n: int = 10) -> DataFrame:
    major = table.where(F.col("orders") >= min_orders)
    return major.orderBy(F.desc_nulls_last("late_delivery_rate"), "seller_id").limit(n)


def seller_state_orders(market: Market, numbers: DataFrame | None = None) -> DataFrame:
    """seller_state, block, bits: which completed orders sold from a state.

    An order can have several sellers in a state and sellers in several states; it has one bit, so
    states are merged into larger regions (``functions.bitmaps.merged``) and it still counts once.
    ``numbers`` are the numbered orders, where they are stored (``refresh``).
    """
    if numbers is None:
        numbers = numbered_keys(market.orders, "order_id")
    sold = market.order_items.where(F.col("order_id").isNotNull() & F.col("seller_id").isNotNull())
    done = completed(market.orders.select("order_id", "order_status")).select("order_id")
    # Repeated rows of an order or of a line set the same bit.
    lines = sold.select("order_id", "seller_id").distinct().join(done.join(numbers, "order_id"), "order_id")
    placed = lines.join(market.sellers.select("seller_id", "seller_state"), "seller_id")
    return seen(placed.where(F.col("seller_state").isNotNull()), ["seller_state"])


def seller_state_summary(market: Market, *, orders: DataFrame | None = None) -> DataFrame:
    """Per seller state: sellers, distinct orders, revenue; highest revenue first.

    Sellers are summed before they meet their state. ``orders`` are the states' bitmaps
    (``seller_state_orders``), where they are stored.
    """
    if orders is None:
        orders = seller_state_orders(market)
    sums = _placed(seller_revenue(market), market, "keep").where(F.col("seller_state").isNotNull())
    states = sums.groupBy("seller_state").agg(
        F.countDistinct("seller_id").alias("sellers"), total("merchandise_revenue").alias("merchandise_revenue")
    )
    return (
        states.join(counted(orders, ["seller_state"], "orders"), "seller_state")
        .select("seller_state", "sellers", "orders", "merchandise_revenue")
        .orderBy(F.desc("merchandise_revenue"), "seller_state")
    )


def top_seller_states(market: Market, n: int = 10) -> DataFrame:
    return seller_state_summary(market).limit(n)
