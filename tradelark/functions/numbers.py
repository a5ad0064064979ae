"""Sums, ratios and means whose value does not depend on how rows are spread.

Money is summed as whole hundredths and review averages as decimals. Both are
exact; what is divided is divided once, as doubles. The same rows give the same
bits for any number of partitions.
"""

from __future__ import annotations

from decimal import Decimal
from typing import Literal

from pyspark.sql import Column
from pyspark.sql import functions as F

NullSums = Literal["zero", "null"]

CENT = Decimal("0.01")


def hundredths(money: str | Column) -> Column:
    """An amount with two decimals as a whole number."""
    amount = F.col(money) if isinstance(money, str) else money
    return (amount * 100).cast("bigint")


def total(money: str | Column, null_sums: NullSums = "zero") -> Column:
    """Sum of amounts; over nothing but nulls it is zero, or null when asked for.

    Adding 64-bit numbers is several times cheaper than adding wide decimals. They
    hold sums up to 9e16; beyond, the query fails rather than wraps around, whether or
    not the session is in ANSI mode.
    """
    whole = F.try_sum(hundredths(money))
    lost = whole.isNull() & (F.count(money) > 0)
    checked = F.when(lost, F.raise_error(F.lit("a sum of money is too large")).cast("bigint")).otherwise(whole)
    summed = (checked.cast("decimal(20,0)") * F.lit(CENT)).cast("decimal(20,2)")
    return F.coalesce(summed, F.lit(0).cast("decimal(20,2)")) if null_sums == "zero" else summed


def ratio(numerator: Column, denominator: Column) -> Column:
    """Double division that yields null, not an error, for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(numerator: Column, denominator: Column) -> Column:
    return ratio(numerator, denominator) * 100


def mean_of_whole(column: Column) -> Column:
    """Mean of whole numbers; null rows are left out."""
    return ratio(F.sum(column.cast("bigint")), F.count(column))


def score_sum(column: str | Column) -> Column:
    """Sum of small fractional values as decimals with 12 digits; sums of such sums are as exact."""
    column = F.col(column) if isinstance(column, str) else column
    return F.sum(column.cast("decimal(18,12)"))


def mean_of_scores(column: str | Column) -> Column:
    """Mean of small fractional values, summed as decimals with 12 digits."""
    return ratio(score_sum(column), F.count(column))


def share_of_true(flag: Column) -> Column:
    """Percentage of true among the rows where the flag is known."""
    return percent(F.sum(flag.cast("bigint")), F.count(flag))
