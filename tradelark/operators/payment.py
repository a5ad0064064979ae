"""Payment methods and card instalments of completed orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelark.functions.labels import CARD, instalment_label, instalment_rank
from tradelark.functions.numbers import percent, ratio, total
from tradelark.market import Market
from tradelark.operators.master import completed


def _of_completed(rows: DataFrame, market: Market) -> DataFrame:
    return rows.join(completed(market.orders).select("order_id"), "order_id", "left_semi")


def delivered_payments(market: Market) -> DataFrame:
    return _of_completed(market.payments, market)


def payment_methods(market: Market) -> DataFrame:
    """Per method: records, orders, value, value per order, share of all value."""
    # Combined per order and method off the scan, so that a frequent order id joins
    # as one row per method and distinct orders are a plain count.
    per_order = (
        market.payments.where(F.col("payment_type").isNotNull())
        .groupBy("order_id", "payment_type")
        .agg(F.count("payment_sequential").alias("records"), total("payment_value", "null").alias("paid"))
    )
    methods = (
        _of_completed(per_order, market)
        .groupBy("payment_type")
        .agg(
            F.sum("records").alias("payment_records"),
            F.count("*").alias("orders_using_method"),
            total("paid").alias("payment_value"),
        )
    )
    everything = F.sum("payment_value").over(Window.partitionBy())
    return methods.withColumns(
        {
            "avg_payment_per_order": ratio(F.col("payment_value"), F.col("orders_using_method")),
            "payment_value_share_pct": percent(F.col("payment_value"), everything),
        }
    ).orderBy(F.desc("payment_value"), "payment_type")


def card_orders(market: Market) -> DataFrame:
    """Per completed order paid by card: most instalments and card total."""
    cards = (
        market.payments.where((F.col("payment_type") == CARD) & F.col("order_id").isNotNull())
        .groupBy("order_id")
        .agg(F.max("payment_installments").alias("installments"), total("payment_value").alias("payment_value"))
    )
    return _of_completed(cards, market)


def installment_groups(market: Market) -> DataFrame:
    """Card orders per instalment group, in the order of the groups."""
    return (
        card_orders(market)
        .groupBy(instalment_rank(F.col("installments")).alias("sort_order"))
        .agg(F.count("*").alias("orders"), total("payment_value").alias("total_payment_value"))
        .select(
            instalment_label(F.col("sort_order")).alias("installment_group"),
            "sort_order",
            "orders",
            "total_payment_value",
            ratio(F.col("total_payment_value"), F.col("orders")).alias("average_order_value"),
        )
        .orderBy("sort_order")
    )


def installment_distribution(market: Market) -> DataFrame:
    """Card orders per number of instalments."""
    return (
        card_orders(market)
        .where(F.col("installments").isNotNull())
        .groupBy("installments")
        .agg(F.count("*").alias("orders"))
        .orderBy("installments")
    )
