"""Closed-form labels. Each is one CASE expression, evaluated in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names the reports use.
COMPLETED = "delivered"
UNKNOWN_CATEGORY = "unknown"
REPEAT, ONE_TIME = "Repeat Customer", "One-Time Customer"
LATE, ON_TIME = "Late", "On Time"
CARD = "credit_card"

# Instalment groups as (largest count in the group, label).
INSTALMENT_GROUPS = (
    (1, "1 installment"),
    (3, "2-3 installments"),
    (6, "4-6 installments"),
    (12, "7-12 installments"),
    (None, "13+ installments"),
)


def customer_type(orders: Column) -> Column:
    return F.when(orders > 1, REPEAT).otherwise(ONE_TIME)


def instalment_rank(instalments: Column) -> Column:
    """Position of the instalment group, from 1; an unknown count is in the last."""
    rank = F.lit(len(INSTALMENT_GROUPS))
    for position, (largest, _) in reversed(list(enumerate(INSTALMENT_GROUPS[:-1], start=1))):
        rank = F.when(instalments <= largest, position).otherwise(rank)
    return rank


def instalment_label(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(label) for _, label in INSTALMENT_GROUPS]), rank - 1)


def frequency_score(orders: Column) -> Column:
    """1 order scores 1, 2 score 3, 3 score 4, anything else 5."""
    return F.when(orders == 1, 1).when(orders == 2, 3).when(orders == 3, 4).otherwise(5)


def value_segment(recency: Column, frequency: Column, monetary: Column) -> Column:
    """Customer segment from the three scores; the first rule that holds decides."""
    returning, single = frequency >= 3, frequency == 1
    big_spender, recent = monetary >= 4, recency >= 4
    return (
        F.when(recent & returning & big_spender, "Champions")
        .when(returning & (recency >= 3), "Loyal Customers")
        .when(returning & (recency <= 2), "At Risk Repeat")
        .when(single & big_spender & (recency >= 3), "High Value One-Time")
        .when(single & recent, "Recent One-Time")
        .when(single & big_spender, "High Value Inactive")
        .otherwise(ONE_TIME)
    )
