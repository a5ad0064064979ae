"""Calendar arithmetic on zone-less timestamps."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import Column
from pyspark.sql import functions as F

# How a stretch of time is counted in days: whole days rounded down, or whole
# hours (rounded towards zero) divided by 24.
DayMode = Literal["floor_days", "hours"]

DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def floor_days(later: Column, earlier: Column) -> Column:
    """Whole days from earlier to later, rounded down: -14 hours is -1."""
    gap = later - earlier
    towards_zero = F.extract(F.lit("DAY"), gap)
    overshoot = gap < F.make_dt_interval(towards_zero)
    return (towards_zero - overshoot.cast("int")).cast("int")


def whole_hours(later: Column, earlier: Column) -> Column:
    """Whole hours from earlier to later, rounded towards zero."""
    gap = later - earlier
    return F.extract(F.lit("DAY"), gap).cast("bigint") * 24 + F.extract(F.lit("HOUR"), gap).cast("bigint")


def year_month(moment: Column) -> Column:
    """"YYYY-MM". Text of a date, not date_format, which goes through the session zone."""
    return F.substring(moment.cast("date").cast("string"), 1, 7)


def day_name(moment: Column) -> Column:
    # get, not element_at: that one ignores a null index of an array without nulls.
    return F.get(F.array(*[F.lit(day) for day in DAYS]), F.weekday(moment.cast("date")))


def parsed_with(text: Column, pattern: str) -> Column:
    """Text in the given pattern as a zone-less timestamp, null where it does not fit."""
    instant = F.try_to_timestamp(F.concat(text, F.lit(" Z")), F.lit(f"{pattern} X"))
    seconds = (F.unix_micros(instant) / 1_000_000).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds)


def month_start(moment: Column) -> Column:
    return F.trunc(moment.cast("date"), "month")


def months_apart(later: Column, earlier: Column) -> Column:
    return ((F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)).cast("int")
