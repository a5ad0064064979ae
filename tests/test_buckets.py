"""Tables stored by order and by month: same rows, no exchange, and one month at a time."""

from __future__ import annotations

import os
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.helpers import market, order, records
from tradelark.market import Market
from tradelark.operators import cleaning, master, performance, seller
from tradelark.plans.refresh import BY_ORDER, Refresh
from tradelark.sources import buckets
from tradelark.sources.buckets import Layout

COUNT = 120


def wide_market(spark):
    customers = [(f"c{at}", f"b{at % 17}", "x", f"S{at % 5}") for at in range(40)]
    orders = [order(f"o{at}", f"c{at % 41}", bought=f"2018-{at % 4 + 1:02d}-11") for at in range(COUNT)] + [order("late", bought=None)]
    # One order has half of all items.
    items = [(f"o{at % COUNT if at % 2 else 0}", at, f"p{at % 9}", f"s{at % 11}", None, Decimal("1.25"), Decimal("0.50")) for at in range(900)]
    payments = [(f"o{at % COUNT}", at // COUNT, "credit_card", 1 + at % 3, Decimal("2.50")) for at in range(300)]
    reviews = [(f"o{at % 70}", 1 + at % 5, None, None) for at in range(100)]
    sellers = [(f"s{at}", "city", f"S{at % 3}") for at in range(11)]
    products = [(f"p{at}", f"k{at % 4}") for at in range(9)]
    tables = market(spark, customers=customers, orders=orders, order_items=items, payments=payments, reviews=reviews, sellers=sellers, products=products)
    return tables.having(geolocation=tables.geolocation.withColumn("source_position", F.lit(0)))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    refresh = Refresh(spark, str(tmp_path_factory.mktemp("bucketed")), buckets=5)
    return refresh, wide_market(spark), refresh.clean(wide_market(spark))


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def exchanges(frame):
    return [re.sub(r"#\d+L?", "", found) for found in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan_of(frame))]


def same(one, other):
    return sorted(map(str, records(one))) == sorted(map(str, records(other.select(*one.columns))))


def test_the_order_table_needs_no_exchange_by_order(stored, no_broadcast):
    _, raw, clean = stored
    built = master.order_master(clean)
    keys = exchanges(built)
    assert keys and not [key for key in keys if "order_id" in key]
    loose = master.order_master(cleaning.clean_market(raw))
    assert any(key.startswith("order_id") for key in exchanges(loose))
    assert same(built, loose)


@pytest.mark.parametrize("make", [lambda m: master.item_summary(m.order_items), seller.seller_order, performance.monthly_performance])
def test_other_reports_on_stored_tables(stored, no_broadcast, make):
    _, raw, clean = stored
    assert not [key for key in exchanges(make(clean)) if key.startswith("order_id,") or key == "order_id, 4"]
    assert same(make(clean), make(cleaning.clean_market(raw)))


def test_a_period_reads_only_its_months(stored):
    _, raw, clean = stored
    period = ("2018-02-01", "2018-04-01")
    growth = performance.monthly_growth(clean, period)
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan_of(growth))
    assert any("purchase_year_month" in found and "2018-02" in found for found in filters)
    assert [row.purchase_month for row in growth.collect()] == ["2018-02", "2018-03"]
    assert same(growth, performance.monthly_growth(cleaning.clean_market(raw), period))


def files_of(path):
    return {os.path.join(folder, name) for folder, _, names in os.walk(path) for name in names if name.endswith(".parquet")}


def test_a_new_month_rewrites_one_partition(spark, tmp_path):
    raw = wide_market(spark)
    refresh = Refresh(spark, str(tmp_path), buckets=3)
    clean = refresh.clean(raw)
    before = files_of(f"{tmp_path}/clean/orders")
    changed = [order("new", "c1", bought="2018-03-02"), order("other", "c2", bought="2018-03-30"), order("may", "c2", bought="2018-05-01")]
    refresh.replace_months(cleaning.clean_market(market(spark, orders=changed)).orders)
    after = files_of(f"{tmp_path}/clean/orders")
    assert {path.split("/")[-2] for path in before - after} == {"purchase_year_month=2018-03"}
    assert {path.split("/")[-2] for path in after - before} == {"purchase_year_month=2018-03", "purchase_year_month=2018-05"}
    layout, path = refresh.layout("orders"), f"{tmp_path}/clean/orders"
    again = buckets.open_bucketed(spark, path, clean.orders.schema, layout)
    march = sorted(row.order_id for row in again.where("purchase_year_month = '2018-03'").collect())
    assert march == ["new", "other"] and again.where("purchase_year_month IS NULL").count() == 1
    assert again.count() == COUNT + 1 - COUNT // 4 + 3


def test_opened_by_another_session(spark, stored, no_broadcast):
    refresh, _, clean = stored
    tables = {
        name: buckets.open_bucketed(spark, f"{refresh.out}/clean/{name}", getattr(clean, name).schema, refresh.layout(name)) for name in BY_ORDER
    }
    again = Market(**{**clean.tables(), **tables})
    assert not [key for key in exchanges(master.order_master(again)) if "order_id" in key]
    assert same(master.order_master(again), master.order_master(clean))


def test_a_hot_key_is_written_by_several_tasks_and_read_without_buckets(spark, tmp_path, monkeypatch):
    rows = spark.range(20000).selectExpr("if(id % 3 = 0, 1, id) AS k", "id AS v")
    path = str(tmp_path / "hot")
    buckets.write_bucketed(rows, path, Layout("k", 4, spread=3))
    sizes = buckets.bucket_sizes(spark, path)
    assert sorted(sizes) == [0, 1, 2, 3]
    hot = max(sizes, key=sizes.get)
    assert len([name for name in files_of(path) if re.search(rf"_0000{hot}\.c", name)]) == 3
    assert buckets._even(sizes) and not buckets._even(sizes, least=0, times=1.2)
    monkeypatch.setattr(buckets, "EVEN_BYTES", 0)
    monkeypatch.setattr(buckets._even, "__defaults__", (0, 1.2))
    loose = buckets.open_bucketed(spark, path, rows.schema, Layout("k", 4, spread=3))
    assert "Bucketed: true" not in plan_of(loose) and loose.count() == 20000 and loose.agg({"v": "sum"}).first()[0] == 20000 * 19999 // 2


def test_bucket_count_follows_the_raw_size(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"x" * 1000)
    (tmp_path / "b.csv").write_bytes(b"x" * 501)
    paths = [str(tmp_path / name) for name in ("a.csv", "b.csv")]
    assert buckets.bucket_count(spark, paths, 500) == 4 and buckets.bucket_count(spark, paths) == 1


def test_only_tables_with_partitions_can_replace_them(spark):
    with pytest.raises(ValueError):
        buckets.replace_partitions(spark.range(1), "/nowhere", Layout("id", 2))
