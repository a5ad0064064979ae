from __future__ import annotations

from datetime import datetime
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.helpers import at, records
from tradelark.functions import clock, labels, numbers, order_stats, present, text


def test_floor_days_and_whole_hours_agree_with_pandas(spark):
    moments = [
        ("2018-01-02 00:00:00", "2018-01-01 10:00:00"),
        ("2018-01-01 00:00:00", "2018-01-01 14:00:00"),  # -14 hours
        ("2018-01-02 01:00:00", "2018-01-01 00:00:00"),  # +25 hours
        ("2018-01-01 00:00:00", "2018-01-02 00:00:00"),  # exactly -1 day
        ("2018-01-01 00:00:00", "2018-01-02 00:00:01"),
        ("2018-11-05 00:30:00", "2018-11-03 23:45:00"),  # over a clock change
        ("2018-02-17 23:30:00", "2018-02-16 23:45:00"),
        ("2018-01-01 00:00:00", "2018-01-01 00:00:00"),
        (None, "2018-01-01 00:00:00"),
        ("2018-01-01 00:00:00", None),
    ]
    frame = spark.createDataFrame([(at(a), at(b)) for a, b in moments], "a timestamp_ntz, b timestamp_ntz")
    found = frame.select(
        clock.floor_days(F.col("a"), F.col("b")).alias("days"),
        clock.whole_hours(F.col("a"), F.col("b")).alias("hours"),
    ).collect()
    gaps = [pd.Timestamp(a) - pd.Timestamp(b) if a and b else None for a, b in moments]
    assert [row.days for row in found] == [None if gap is None else gap.days for gap in gaps]
    assert [row.hours for row in found] == [
        None if gap is None else int(gap.total_seconds() / 3600) for gap in gaps
    ]


def test_months(spark):
    frame = spark.createDataFrame([(datetime(2018, 2, 1, 0, 30), datetime(2016, 12, 31, 23, 59))], "a timestamp_ntz, b timestamp_ntz")
    row = frame.select(
        clock.year_month(F.col("a")).alias("label"),
        clock.month_start(F.col("b")).cast("string").alias("start"),
        clock.months_apart(F.col("a"), F.col("b")).alias("apart"),
    ).first()
    assert (row.label, row.start, row.apart) == ("2018-02", "2016-12-01", 14)


def test_strip_removes_any_white_space(spark):
    values = [" \tSao Paulo\n", " x ", "\x1cy\x1f", "a b", "", None]
    frame = spark.createDataFrame([(value,) for value in values], "t string")
    assert [row.t for row in frame.select(text.strip("t").alias("t")).collect()] == [
        value if value is None else value.strip() for value in values
    ]
    row = frame.limit(1).select(text.strip_lower("t").alias("a"), text.strip_upper("t").alias("b")).first()
    assert (row.a, row.b) == ("sao paulo", "SAO PAULO")


def test_totals_are_exact_and_follow_the_null_rule(spark):
    frame = spark.createDataFrame(
        [("a", Decimal("0.10"))] * 3 + [("b", None), ("c", Decimal("9999999999999.99")), ("c", Decimal("0.01")), ("d", Decimal("-0.05"))],
        "k string, v decimal(18,2)",
    )
    zero = {row.k: row.v for row in frame.groupBy("k").agg(numbers.total("v").alias("v")).collect()}
    null = {row.k: row.v for row in frame.groupBy("k").agg(numbers.total("v", "null").alias("v")).collect()}
    assert zero == {"a": Decimal("0.30"), "b": Decimal("0.00"), "c": Decimal("10000000000000.00"), "d": Decimal("-0.05")}
    assert null == {**zero, "b": None}


def test_ratio_by_zero_is_null(spark):
    row = spark.range(1).select(
        numbers.ratio(F.lit(1), F.lit(0)).alias("zero"), numbers.percent(F.lit(1), F.lit(8)).alias("share")
    ).first()
    assert row.zero is None and row.share == 12.5


def test_means_leave_nulls_out(spark):
    frame = spark.createDataFrame([(1, 1.5, True), (2, None, None), (None, 2.0, False)], "n int, s double, f boolean")
    row = frame.agg(
        numbers.mean_of_whole(F.col("n")).alias("n"),
        numbers.mean_of_scores("s").alias("s"),
        numbers.share_of_true(F.col("f")).alias("f"),
    ).first()
    assert (row.n, row.s, row.f) == (1.5, 1.75, 50.0)


def test_instalment_groups(spark):
    counts = [0, 1, 2, 3, 4, 6, 7, 12, 13, None]
    frame = spark.createDataFrame([(n,) for n in counts], "n int")
    rank = labels.instalment_rank(F.col("n"))
    found = frame.select(rank.alias("rank"), labels.instalment_label(rank).alias("label")).collect()
    assert [row.rank for row in found] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert [found[at].label for at in (0, 2, 4, 6, 9)] == [
        "1 installment", "2-3 installments", "4-6 installments", "7-12 installments", "13+ installments",
    ]


def _segment(r, f, m):
    if r >= 4 and f >= 3 and m >= 4:
        return "Champions"
    if f >= 3:
        return "Loyal Customers" if r >= 3 else "At Risk Repeat"
    if f == 1 and m >= 4:
        return "High Value One-Time" if r >= 3 else "High Value Inactive"
    return "Recent One-Time" if f == 1 and r >= 4 else "One-Time Customer"


def test_every_segment_cell(spark):
    cells = [(r, f, m) for r in range(1, 6) for f in (1, 3, 4, 5) for m in range(1, 6)]
    frame = spark.createDataFrame(cells, "r int, f int, m int")
    found = frame.withColumn("s", labels.value_segment(F.col("r"), F.col("f"), F.col("m"))).collect()
    assert {(row.r, row.f, row.m): row.s for row in found} == {cell: _segment(*cell) for cell in cells}
    scores = spark.range(0, 6).select(labels.frequency_score(F.col("id")).alias("s")).collect()
    assert [row.s for row in scores] == [5, 1, 3, 4, 5, 5]


def _marks(spark, groups: dict[str, list], parts, slots, ladder, kind="bigint", few_groups=True):
    rows = [(key, value) for key, values in groups.items() for value in values]
    frame = spark.createDataFrame(rows, f"k string, v {kind}")
    found = order_stats.scaled_quantiles(
        frame, ["k"], ladder(F.col("v")), parts=parts, slots=slots, few_groups=few_groups
    )
    return {(row.k, row.slot): row.mark for row in found.collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.integers(-(2**40), 2**40), min_size=1, max_size=40),
    st.lists(st.integers(0, 3), min_size=1, max_size=40),
)
def test_quantiles_of_whole_numbers_are_exact(spark, wide, tied):
    groups = {"wide": wide, "tied": tied}
    found = _marks(spark, groups, 5, range(6), order_stats.whole_number_ladder)
    for key, values in groups.items():
        ordered, last = sorted(values), len(values) - 1
        for slot in range(6):
            below, beyond = divmod(slot * last, 5)
            above = ordered[min(below + 1, last)]
            assert found[key, slot] == ordered[below] * (5 - beyond) + above * beyond


def test_medians_of_coordinates(spark):
    groups = {
        "odd": [-46.6333, -46.6, -46.7],
        "even": [10.0, 10.00000001, 10.00000002, 10.5],
        "one": [-0.5],
        "nulls": [None, 3.0, None],
        "none": [None],
    }
    found = _marks(spark, groups, 2, [1], order_stats.degree_ladder, "double", few_groups=False)
    expected = {key: np.median([v for v in values if v is not None]) for key, values in groups.items() if key != "none"}
    assert {key: mark / 2 for (key, _), mark in found.items()} == expected


def test_quantiles_of_a_dominant_group(spark):
    # One key holds most rows, and one value most of that key.
    frame = spark.range(60_000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"),
        F.when(F.col("id") % 3 == 1, 7).otherwise(F.col("id") % 1000).alias("v"),
    )
    found = order_stats.scaled_quantiles(
        frame, ["k"], order_stats.whole_number_ladder(F.col("v")), parts=4, slots=[1, 2, 3]
    )
    expected = frame.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75)])).alias("q"))
    want = {(row.k, slot): row.q[slot - 1] * 4 for row in expected.collect() for slot in (1, 2, 3)}
    assert {(row.k, row.slot): float(row.mark) for row in found.collect()} == pytest.approx(want)


def test_present(spark):
    frame = spark.createDataFrame(
        [(1, Decimal("1.235"), 2.3456, True, datetime(2018, 1, 2, 3, 4, 5), 1 / 3)],
        "i int, d decimal(10,3), x double, b boolean, t timestamp_ntz, average_review_score double",
    )
    assert records(present.portable(frame)) == [
        {"i": 1, "d": 1.235, "x": 2.3456, "b": 1, "t": "2018-01-02 03:04:05", "average_review_score": 0.333333}
    ]
    row = present.rounded(frame).first()
    assert (row.i, row.x, row.t) == (1, 2.35, datetime(2018, 1, 2, 3, 4, 5))
