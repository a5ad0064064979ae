"""Quantiles from sketched brackets against the exact ladder."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tradelark.functions.order_stats import bracketed_quantiles, scaled_quantiles, whole_number_ladder

SLOTS = range(6)


def both(frame, **options):
    names = frame.columns
    ladder = scaled_quantiles(
        frame.unpivot([], names, "measure", "value"), ["measure"], whole_number_ladder(F.col("value")), parts=5, slots=SLOTS, few_groups=True
    )
    found = bracketed_quantiles(frame, names, parts=5, slots=SLOTS, **options)
    return [sorted(map(tuple, one.select("measure", "slot", "mark").collect())) for one in (found, ladder)]


def columns():
    draw = random.Random(1)
    yield "spread", [draw.randrange(-(10**12), 10**12) for _ in range(3001)]
    yield "tied", [draw.choice([0, 0, 0, 7]) for _ in range(3001)]
    yield "hot", [5 if at % 3 else draw.randrange(1000) for at in range(3001)]
    yield "few", [None if at > 4 else at * at for at in range(3001)]
    yield "single", [None] * 3000 + [42]
    yield "nothing", [None] * 3001
    yield "steps", [at // 600 for at in range(3001)]


@pytest.mark.parametrize("options", [{}, {"sketch_size": 64, "margin": 0.2}, {"sketch_size": 200, "margin": 0.08}])
def test_same_marks_as_the_ladder(spark, options):
    names, values = zip(*columns())
    frame = spark.createDataFrame(list(zip(*values)), ", ".join(f"{name} long" for name in names)).repartition(7)
    found, wanted = both(frame, **options)
    assert found == wanted
    assert {measure for measure, _, _ in found} == set(names) - {"nothing"}


def test_empty_table(spark):
    frame = spark.createDataFrame([], "a long, b long")
    assert both(frame) == [[], []]


def test_a_missed_quantile_is_an_error(spark):
    draw = random.Random(2)
    frame = spark.createDataFrame([(draw.randrange(10**9),) for _ in range(20000)], "a long")
    with pytest.raises(Exception, match="misses a quantile of a"):
        bracketed_quantiles(frame, ["a"], parts=5, slots=SLOTS, sketch_size=8, margin=0.002).collect()


def test_two_reads(spark, tmp_path):
    path = str(tmp_path / "base")
    spark.range(100_000).selectExpr("id * 7919 % 100003 AS a").write.parquet(path)
    frame = bracketed_quantiles(spark.read.parquet(path), ["a"], parts=5, slots=SLOTS)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2
    assert sorted(map(tuple, frame.collect())) == [("a", slot, mark) for slot, mark in enumerate(exact_marks(range(100_000)))]


def exact_marks(ids):
    values = sorted(at * 7919 % 100003 for at in ids)
    places = [divmod(slot * (len(values) - 1), 5) for slot in SLOTS]
    return [values[low] * (5 - part) + (values[low + 1] * part if part else 0) for low, part in places]
