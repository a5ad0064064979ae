"""Monthly cohorts of buyers, by the month of their first completed order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelark.functions.clock import year_month
from tradelark.functions.numbers import percent
from tradelark.market import Market
from tradelark.operators.cleaning import PURCHASED
from tradelark.operators.master import BUYER, completed_market, with_buyer

# Numbers of 64 bits that hold a buyer's months: 42 years between the first and the last purchase.
WORDS = 8


def _month_number(moment: Column) -> Column:
    """Months since the year 0."""
    return F.year(moment) * 12 + F.month(moment) - 1


def _month_of(number: Column) -> Column:
    """The first day of a numbered month."""
    return F.make_date(F.floor(number / 12).cast("int"), F.pmod(number, F.lit(12)) + 1, F.lit(1))


def cohort_activity(market: Market, *, words: int = WORDS) -> DataFrame:
    """Per known buyer and month with a purchase: the buyer's first month and the distance to it.

    A buyer's months are bits of ``words`` numbers, a ring of 64 * words months. Together with
    the first month every bit stands for one month, as long as the buyer's last month
    is less than a ring away from it; a longer stretch is an error, never a lost month.
    """
    ring = 64 * words
    orders = completed_market(market).orders
    # The months of each customer id meet its buyer once, however many orders it has.
    months = orders.select("customer_id", _month_number(F.col(PURCHASED)).alias("month")).distinct()
    facts = with_buyer(months, market.customers, "drop").where(F.col(BUYER).isNotNull() & F.col("month").isNotNull())
    place = F.pmod(F.col("month"), F.lit(ring))
    bit = F.expr("shiftleft(1L, place % 64)")
    masks = [F.bit_or(F.when(F.floor(F.col("place") / 64) == at, bit).otherwise(F.lit(0))).alias(f"mask_{at}") for at in range(words)]
    # Numbers of fixed width only: a hash aggregate, combined before the shuffle.
    buyers = facts.withColumn("place", place).groupBy(BUYER).agg(F.min("month").alias("first"), F.max("month").alias("last"), *masks)
    last = F.when(F.col("last") - F.col("first") < ring, F.col("last")).otherwise(
        F.raise_error(F.lit(f"a buyer's purchases span {ring} months or more: pass more words")).cast("int")
    )
    every = buyers.select(BUYER, "first", F.array(*[f"mask_{at}" for at in range(words)]).alias("masks"), F.explode(F.sequence("first", last)).alias("month"))
    bought = F.getbit(F.get("masks", F.floor(place / 64).cast("int")), F.pmod(F.col("month"), F.lit(64))) == 1
    return every.where(bought).select(
        BUYER,
        _month_of(F.col("first")).alias("cohort_month"),
        _month_of(F.col("month")).alias("purchase_month"),
        (F.col("month") - F.col("first")).alias("cohort_index"),
    )


def cohort_retention(activity: DataFrame) -> DataFrame:
    """Per cohort and month index: active buyers, cohort size, retention in percent."""
    # A buyer appears once per month, so active buyers are a plain count.
    counts = activity.groupBy("cohort_month", "cohort_index").agg(F.count("*").alias("active_customers"))
    # Few rows by now, at most one per month and cohort: the size is read off the
    # cohort's first month without a second pass over the buyers.
    first_month = F.when(F.col("cohort_index") == 0, F.col("active_customers"))
    size = F.max(first_month).over(Window.partitionBy("cohort_month"))
    return (
        counts.withColumn("cohort_size", size)
        .withColumn("retention_rate", percent(F.col("active_customers"), F.col("cohort_size")))
        .orderBy("cohort_month", "cohort_index")
    )


def cohort_sizes(retention: DataFrame) -> DataFrame:
    """Buyers in the first month of each cohort, from a retention table."""
    return retention.where(F.col("cohort_index") == 0).select(
        "cohort_month", F.col("active_customers").alias("cohort_size")
    )


def retention_window(retention: DataFrame, *, first_cohort: str, last_index: int = 5) -> DataFrame:
    """The part of a retention table to show; cohorts themselves come from all data."""
    shown = (F.col("cohort_month") >= F.lit(first_cohort).cast("date")) & (F.col("cohort_index") <= last_index)
    return retention.where(shown).orderBy("cohort_month", "cohort_index")


def cohort_matrix(retention: DataFrame, indexes: Sequence[int]) -> DataFrame:
    """Retention with one row per cohort ("YYYY-MM") and one column per month index.

    The indexes are given, so no extra job has to find them; a cohort has null where
    it has no active buyer.
    """
    labelled = retention.withColumn("cohort", year_month(F.col("cohort_month")))
    wide = labelled.groupBy("cohort").pivot("cohort_index", list(indexes)).agg(F.max("retention_rate"))
    return wide.select("cohort", *[F.col(str(index)).alias(f"month_{index}") for index in indexes]).orderBy("cohort")


def cohort_matrix_head(retention: DataFrame, width: int = 6) -> DataFrame:
    return cohort_matrix(retention, range(width))


def indexes_between(first: str, last: str) -> range:
    """Every month index possible between two purchase dates, "YYYY-MM..." each."""
    (y1, m1), (y2, m2) = ((int(text[:4]), int(text[5:7])) for text in (first, last))
    return range((y2 - y1) * 12 + m2 - m1 + 1)


def indexes_possible(orders: DataFrame) -> range:
    """Every month index that the purchases of ``orders`` allow. Runs a job that returns one row."""
    first, last = orders.agg(*[year_month(pick(PURCHASED)) for pick in (F.min, F.max)]).first()
    return indexes_between(first, last) if first else range(0)


def indexes_present(retention: DataFrame) -> list[int]:
    """The month indexes that occur, read from a finished retention table.

    Runs a job; what it returns is at most one number per calendar month.
    """
    found = retention.select("cohort_index").distinct().orderBy("cohort_index")
    return [row.cohort_index for row in found.collect()]
