"""Column profiles merged from the sketches of parts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.helpers import market, order, records
from tests.test_bitmaps import raw_shop
from tradelark.operators import audit, inventory
from tradelark.plans.refresh import Refresh


def rows(frame):
    return sorted(map(str, records(frame)))


@pytest.fixture(scope="module")
def values(spark):
    """More distinct values than a small sketch keeps, nulls, empty text and one very frequent value."""
    return spark.range(60_000).selectExpr(
        "CAST(id * 7919 % 20011 AS string) AS many",
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL WHEN id % 7 = 1 THEN '' ELSE CAST(id % 50 AS string) END AS few",
        "CASE WHEN id % 2 = 0 THEN 0.0D WHEN id % 5 = 0 THEN double('NaN') ELSE -0.0D END AS zero",
        "id % 13 AS part",
    )


def exact(frame):
    return {row.column: row for row in audit._counted_columns("t", frame).collect()}


@pytest.mark.parametrize("part", [None, "part", "part % 2", "nullif(part, 3)"])
def test_any_division_gives_the_numbers_of_one_scan(values, part):
    whole = inventory.merged_profile(inventory.column_sketches("t", values, size_log=8), {"t": values}, size_log=8)
    divided = inventory.column_sketches("t", values.repartition(5), part and F.expr(part), size_log=8)
    assert rows(inventory.merged_profile(divided, {"t": values}, size_log=8)) == rows(whole)


def test_counts_are_exact_until_the_stated_size_and_near_beyond(values):
    wanted = exact(values)
    for size_log in (15, 12, 8):
        made = inventory.column_sketches("t", values, F.col("part"), size_log=size_log)
        for row in inventory.merged_profile(made, {"t": values}, size_log=size_log).collect():
            if wanted[row.column].unique_values <= 1 << size_log:
                assert row == wanted[row.column]
            else:
                error = abs(row.unique_values / wanted[row.column].unique_values - 1)
                assert error <= 4 * inventory.relative_error(size_log)
                assert row.missing_values == wanted[row.column].missing_values


def test_a_part_is_replaced_alone(spark, values, tmp_path):
    path = str(tmp_path / "sketches")
    first = values.where("part < 12")
    inventory.store_sketches(inventory.column_sketches("t", first, F.col("part"), size_log=15), path)
    inventory.store_sketches(inventory.column_sketches("other", first.limit(0), size_log=15), path)
    before = set(inventory.stored_sketches(spark, path).inputFiles())
    # One part is new, one is written again with other rows.
    changed = values.where("part = 12").union(values.where("part = 3 AND few = 'hot'"))
    inventory.store_sketches(inventory.column_sketches("t", changed, F.col("part"), size_log=15), path)
    kept = inventory.stored_sketches(spark, path)
    assert len(before & set(kept.inputFiles())) == len(before) - 1
    now = values.where("part <> 3 OR few = 'hot'")
    assert {row.column: row for row in inventory.merged_profile(kept, {"t": now}, size_log=15).collect()} == exact(now)


def test_empty_tables_and_unknown_columns(spark):
    tables = market(spark, orders=[order("o1"), order("o1", "c2"), order(None)]).tables()
    made = inventory.table_sketches(tables, {"orders": F.col("order_status")})
    assert rows(inventory.merged_profile(made, tables)) == rows(audit.column_profile(market(spark, orders=[order("o1"), order("o1", "c2"), order(None)])))
    wider = {"orders": tables["orders"].withColumn("added", F.lit(1)).drop("order_status")}
    found = {row.column: row for row in inventory.merged_profile(made, wider).collect()}
    assert "order_status" not in found and (found["added"].unique_values, found["added"].missing_percent) == (0, None)


def test_refresh_sketches_only_replaced_months(spark, tmp_path):
    refresh = Refresh(spark, str(tmp_path), buckets=2)
    made = raw_shop(spark)
    days = [order("n1", bought="2018-02-01"), order("n2", bought="2018-03-01"), order("n3", bought="2018-03-02")]
    clean = refresh.clean(made.having(orders=made.orders.unionByName(market(spark, orders=days).orders)))
    refresh.sketch(clean.tables())
    assert rows(refresh.column_profile(clean)) == rows(audit.column_profile(clean))
    files = set(inventory.stored_sketches(spark, f"{tmp_path}/master/column_sketches").inputFiles())
    march = clean.orders.where("order_id = 'n2'")
    refresh.replace_months(spark.createDataFrame(march.collect(), march.schema))
    again = set(inventory.stored_sketches(spark, f"{tmp_path}/master/column_sketches").inputFiles())
    assert len(files - again) == 1 and "part=2018-03" in next(iter(files - again))
    assert rows(refresh.column_profile(clean)) == rows(audit.column_profile(clean))
