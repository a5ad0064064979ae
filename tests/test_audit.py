from __future__ import annotations

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.helpers import by, market, order, records, table
from tradelark.market import Market
from tradelark.operators import audit


def test_contract_names_every_missing_table(spark):
    with pytest.raises(ValueError, match="customers.*payments"):
        audit.contract_check(Market(orders=table(spark, "orders", [])))


def test_contract_reports_columns_types_and_key_nulls(spark):
    tables = market(spark, orders=[order("o1"), order(None)])
    broken = tables.products.drop("product_category_name").withColumn("product_id", tables.products.product_id.cast("double"))
    found = records(audit.contract_check(tables.having(products=broken)))
    lookup = {(row["table"], row["column"]): row for row in found}
    assert lookup["orders", "order_id"] == {
        "table": "orders", "column": "order_id", "present": True, "type_accepted": True, "key_nulls": 1,
    }
    assert lookup["orders", "order_status"]["key_nulls"] is None
    assert lookup["products", "product_id"]["type_accepted"] is False
    assert lookup["products", "product_category_name"]["present"] is False


def test_table_profile_counts_null_rows_as_equal(spark):
    rows = [("c1", "b1", None, "SP"), ("c1", "b1", None, "SP"), ("c2", "b1", "x", "SP"), (None, None, None, None), (None, None, None, None)]
    found = by(audit.table_profile(market(spark, customers=rows)), "table")
    assert found["customers"] == {"table": "customers", "rows": 5, "columns": 4, "duplicate_rows": 2, "missing_values": 10}
    assert found["orders"]["rows"] == 0


def test_table_profile_largest_first(spark):
    tables = market(spark, sellers=[("s1", "x", "SP")], customers=[("c1", "b", "x", "SP"), ("c2", "b", "x", "SP")])
    names = [row["table"] for row in records(audit.table_profile(tables))]
    assert names[:2] == ["customers", "sellers"]


def test_column_profile(spark):
    tables = market(spark, products=[("p1", None), ("p2", "toys"), ("p3", "toys"), ("p4", "pets")])
    found = {(row["table"], row["column"]): row for row in records(audit.column_profile(tables))}
    row = found["products", "product_category_name"]
    assert (row["ordinal"], row["data_type"], row["missing_values"], row["missing_percent"], row["unique_values"]) == (2, "string", 1, 25.0, 2)
    empty = found["sellers", "seller_id"]
    assert (empty["missing_values"], empty["missing_percent"], empty["unique_values"]) == (0, None, 0)
    sketched = {(row["table"], row["column"]): row for row in records(audit.column_profile(tables, approx=True))}
    assert sketched["products", "product_category_name"] == row


def test_key_check_treats_nulls_as_equal(spark):
    frame = table(spark, "products", [("p1", None), ("p1", None), (None, None), (None, None), ("p2", None)])
    assert records(audit.key_check(frame, "product_id", "products")) == [
        {"table": "products", "column": "product_id", "rows": 5, "unique_values": 2, "missing_values": 2, "duplicate_values": 2}
    ]


def test_identities(spark):
    customers = table(spark, "customers", [("c1", "b1", "x", "SP"), ("c2", "b1", "x", "SP"), ("c3", "b1", "x", "SP"), ("c4", "b2", "x", "SP"), ("c5", None, "x", "SP"), ("c6", None, "x", "SP")])
    assert records(audit.identity_summary(customers)) == [
        {"customer_rows": 6, "distinct_accounts": 6, "distinct_buyers": 2, "buyers_with_several_rows": 1}
    ]
    assert records(audit.top_identities(customers, 1)) == [{"customer_unique_id": "b1", "customer_rows": 3}]


def test_child_cardinality(spark):
    payments = table(spark, "payments", [("o1", 1, "x", 1, Decimal(1)), ("o1", 2, "x", 1, Decimal(1)), ("o2", 1, "x", 1, Decimal(1)), (None, 1, "x", 1, Decimal(1))])
    assert records(audit.child_cardinality(payments, "order_id", "payments")) == [
        {"table": "payments", "parents": 2, "most_children": 2, "mean_children": 1.5}
    ]


def test_orphans(spark):
    one = Decimal(1)
    tables = market(
        spark,
        orders=[order("o1", "c1"), order("o2", "gone"), order("o3", None)],
        customers=[("c1", "b1", "x", "SP")],
        order_items=[("o1", 1, "p1", "s1", None, one, one), ("gone", 1, "gone", None, None, one, one), ("gone", 2, "p1", "s1", None, one, one)],
        products=[("p1", "toys")],
        sellers=[("s1", "x", "SP")],
        payments=[("gone", 1, "x", 1, one)],
        reviews=[("gone", 5, None, None), ("o1", 5, None, None)],
    )
    found = {row["relation"]: row["orphan_rows"] for row in records(audit.foreign_key_orphans(tables))}
    assert found == {
        "orders.customer_id": 2, "order_items.order_id": 2, "order_items.product_id": 1,
        "order_items.seller_id": 1, "payments.order_id": 1, "reviews.order_id": 1,
    }


def test_a_null_key_matches_a_null_parent(spark):
    child = spark.createDataFrame([(None,), ("a",)], "fk string")
    parent = spark.createDataFrame([(None,), ("b",)], "pk string")
    assert audit.orphans(child, "fk", parent, "pk", "r").first().orphan_rows == 1


def test_status_distribution_leaves_null_out(spark):
    orders = table(spark, "orders", [order("o1"), order("o2"), order("o3", status="shipped"), order("o4", status=None)])
    assert [tuple(row) for row in audit.status_distribution(orders).collect()] == [("delivered", 2), ("shipped", 1)]


def messy_market(spark):
    reviews = [("a", 1, None, None), ("a", 1, None, None), (None, 1, None, None), ("a", None, None, None), ("b", 2, None, None)]
    sellers = [("s", None, "x"), ("s", "x", None), (None, "s", "x"), ("s", "x", "x")]
    return market(spark, reviews=reviews, sellers=sellers)


@pytest.mark.parametrize("collide", ["never", "always", "some"])
def test_table_profile_is_exact_whatever_collides(spark, collide):
    prints = {
        "never": audit.row_fingerprint,
        "always": lambda names: [F.lit(0), F.lit(0)],
        "some": lambda names: [F.length(F.concat_ws("", *[F.col(name).cast("string") for name in names])), F.lit(1)],
    }[collide]
    found = by(audit.table_profile(messy_market(spark), fingerprint=prints), "table")
    assert {name: found["reviews"][name] for name in ("rows", "columns", "duplicate_rows", "missing_values")} == {
        "rows": 5, "columns": 4, "duplicate_rows": 1, "missing_values": 12
    }
    assert (found["sellers"]["rows"], found["sellers"]["duplicate_rows"], found["sellers"]["missing_values"]) == (4, 0, 3)
    assert (found["orders"]["rows"], found["orders"]["duplicate_rows"], found["orders"]["missing_values"]) == (0, 0, 0)
    assert len(found) == 9


def test_tables_without_repeats_shuffle_fingerprints_only(spark):
    tables = [(messy_market(spark).sellers, ["seller_id", "seller_city", "seller_state"])]
    plan = audit._fingerprints(tables, audit.row_fingerprint)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert keys and not any("seller_" in key for key in keys)
    wide = spark.range(3).select("id", *[F.when(F.col("id") == at % 3, at).alias(f"c{at}") for at in range(130)])
    counted = audit._fingerprints([(wide, wide.columns)], audit.row_fingerprint).collect()
    assert [(row.first, row.n, row.nulls) for row in counted] == [(None, 3, 260)]
    profile = audit.table_profile(market(spark, sellers=[("s", None, "x"), ("t", None, "x")]))
    assert "seller_city" not in profile._jdf.queryExecution().executedPlan().toString()
