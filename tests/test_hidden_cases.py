"""Cases that the fixture tables do not hold."""

from __future__ import annotations

import random
from decimal import Decimal as D
from statistics import median

import pytest
from pyspark.sql import functions as F

from tests.helpers import by, market, order, records
from tradelark.functions.numbers import total
from tradelark.functions.order_stats import degree_ladder, scaled_quantiles
from tradelark.operators import audit, cleaning, cohort, headline
from tradelark.session import RUNTIME_SETTINGS, apply_runtime_settings
from tradelark.sources import files


def halves(spark, groups):
    rows = [(key, value) for key, values in groups.items() for value in values]
    marks = scaled_quantiles(spark.createDataFrame(rows, "zip string, x double"), ["zip"], degree_ladder(F.col("x")), parts=2, slots=[1])
    return {row.zip: row.mark / 2 for row in marks.collect()}


def test_medians_where_rounded_buckets_do_not_nest(spark):
    groups = {"a": [0.29, 0.2900003, 0.2900003], "b": [0.57, 0.5700004, 0.5700005]}
    draw = random.Random(1)
    for number in range(2000):
        near = draw.randrange(-3000, 3000) / 100
        groups[f"z{number}"] = [near + draw.choice([0, 0, 3e-7, -3e-7, 5e-7, 0.01]) for _ in range(draw.randrange(1, 8))]
    found = halves(spark, groups)
    assert all(found[key] == pytest.approx(median(values), abs=1e-12) for key, values in groups.items())
    assert halves(spark, {"one": groups["a"]})["one"] == 0.2900003


def test_a_late_month_keeps_its_cell(spark):
    orders = [order("o1", "c1", bought="2018-01-05"), order("o2", "c1", bought="2026-01-05"), order("o3", "c2", bought="2018-02-01")]
    tables = cleaning.clean_market(market(spark, orders=orders, customers=[("c1", "b1", "x", "SP"), ("c2", "b2", "x", "SP")]))
    retention = cohort.cohort_retention(cohort.cohort_activity(tables))
    matrix = by(cohort.cohort_matrix(retention, cohort.indexes_present(retention)), "cohort")
    assert matrix["2018-01"]["month_96"] == 100.0 and matrix["2018-02"]["month_96"] is None
    assert cohort.indexes_possible(tables.orders) == range(97)
    assert cohort.indexes_possible(tables.orders.limit(0)) == range(0)


def test_unknown_buyers_are_in_no_cohort(spark):
    orders = [order("o1", "c1", bought="2018-01-05"), order("o2", "c2", bought="2018-01-06"), order("o3", "c3", bought="2018-02-06")]
    customers = [("c1", "b1", "x", "SP"), ("c2", None, "x", "SP"), ("c3", None, "x", "SP")]
    tables = cleaning.clean_market(market(spark, orders=orders, customers=customers))
    found = records(cohort.cohort_retention(cohort.cohort_activity(tables)))
    assert [(row["cohort_index"], row["active_customers"]) for row in found] == [(0, 1)]


@pytest.mark.parametrize("approx", [False, True])
def test_zeros_are_one_value_and_nan_is_missing(spark, approx):
    places = [("1", zero, 1.0, "x", "SP", None) for zero in (0.0, -0.0, float("nan"), None, 2.5)]
    tables = market(spark)
    names = tables.geolocation.columns
    frame = spark.createDataFrame([row[: len(names)] for row in places], tables.geolocation.schema)
    found = {row.column: row for row in audit.column_profile(tables.having(geolocation=frame), approx=approx).where("table = 'geolocation'").collect()}
    assert (found["geolocation_lat"].unique_values, found["geolocation_lat"].missing_values) == (2, 2)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_a_sum_that_is_too_large_fails(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        money = spark.createDataFrame([(D("9000000000000000.00"),)] * 20, "paid decimal(18,2)")
        with pytest.raises(Exception, match="too large|overflow|OVERFLOW"):
            money.agg(total("paid")).collect()
        assert money.limit(2).agg(total("paid")).first()[0] == D("18000000000000000.00")
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_a_setting_the_caller_chose_stays(spark):
    name = "spark.sql.adaptive.skewJoin.enabled"
    assert name in RUNTIME_SETTINGS
    spark.conf.set(name, "false")
    try:
        apply_runtime_settings(spark)
        assert spark.conf.get(name) == "false"
    finally:
        spark.conf.unset(name)


def test_equal_spend_shares_a_rank_for_any_number_of_buyers(spark):
    orders = [order(f"o{at}", f"c{at}") for at in range(300)]
    customers = [(f"c{at}", f"b{at}", "x", "SP") for at in range(300)]
    payments = [(f"o{at}", 1, "credit_card", 1, D("5.00") if at < 250 else D(at)) for at in range(299)]
    tables = cleaning.clean_market(market(spark, orders=orders, customers=customers, payments=payments))
    found = records(headline.ranked_customers(tables, top=60))
    assert len(found) == 300 and [row["spend_rank"] for row in found[:3]] == [1, 2, 3]
    assert sum(row["total_spend"] == D("5.00") for row in found) == 250
    assert {row["spend_rank"] for row in found if row["total_spend"] is None} == {51}
    assert len(records(headline.ranked_customers(tables, top=20))) == 20


# ------------------------------------------------------------------------------ CSV


def test_all_absent_files_are_named_at_once(spark, tmp_path):
    (tmp_path / "customers.csv").write_text("customer_id,customer_unique_id,customer_city,customer_state\n")
    paths = {name: str(tmp_path / f"{name}.csv") for name in ("customers", "orders", "payments")}
    with pytest.raises(ValueError, match="'orders'.*'payments'.*'reviews'"):
        files.read_csv_market(spark, paths)


def test_another_header_order_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("seller_id,seller_city,seller_state\ns1,Rio,RJ\n")
    (tmp_path / "b.csv").write_text("seller_id,seller_state,seller_city\ns2,SP,Santos\n")
    names = [field.name for field in files.CONTRACT["sellers"]]
    if set(names) != {"seller_id", "seller_city", "seller_state"}:
        for part, order_ in (("a.csv", names), ("b.csv", names[::-1])):
            (tmp_path / part).write_text(",".join(order_) + "\n" + ",".join("x" for _ in order_) + "\n")
    with pytest.raises(Exception, match="(?i)header|schema"):
        files.read_csv_table(spark, "sellers", str(tmp_path)).collect()


def test_values_that_do_not_parse_are_counted(spark, tmp_path):
    names = [field.name for field in files.CONTRACT["payments"]]
    values = {"order_id": "o1", "payment_sequential": "1", "payment_type": "boleto", "payment_installments": "1", "payment_value": "50.00"}
    lines = [",".join(names)]
    for paid in ("50.00", "R$ 50", '"1,234.50"', "", "NA"):
        lines.append(",".join((values | {"payment_value": paid}).get(name, "") for name in names))
    path = tmp_path / "payments.csv"
    path.write_text("\n".join(lines) + "\n")
    found = {row.column: row.rejected for row in files.rejected_values(spark, "payments", str(path)).collect()}
    assert found["payment_value"] == 2 and found["payment_sequential"] == 0


def test_shared_tables_are_made_once(spark, tmp_path, monkeypatch):
    from tradelark.operators import category, performance, seller
    from tradelark.plans import refresh

    made = []
    for module, name in ((category, "category_performance"), (seller, "seller_performance"), (performance, "monthly_performance")):
        real = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, real=real, name=name, **k: made.append((name, bool(k))) or real(*a, **k))
    orders = [order(f"o{at}", f"c{at}", bought=f"2018-0{at % 5 + 1}-05") for at in range(20)]
    customers = [(f"c{at}", f"b{at % 7}", "x", "SP") for at in range(20)]
    tables = cleaning.clean_market(market(spark, orders=orders, customers=customers))
    run = refresh.Refresh(spark, str(tmp_path), report_format="csv")
    for name, (make, derived) in refresh.shared_tables().items():
        table = run._stored("master", name, make(tables))
        for report, pick in derived.items():
            run._report(report, pick(table))
    assert sorted(made) == [("category_performance", False), ("monthly_performance", False), ("seller_performance", False)]
    assert (tmp_path / "reports" / "top_sellers").is_dir()


def test_cohorts_over_more_months_than_a_number_has_bits(spark):
    """Against sets of months; purchases lie up to 41 years apart, some of them before 1970."""
    draw = random.Random(5)
    customers = [(f"c{at}", f"b{at % 23}" if at % 10 else None, "x", "SP") for at in range(60)]
    bought = [f"{draw.randrange(1960, 2001)}-{draw.randrange(1, 13):02d}-{draw.randrange(1, 28):02d}" for _ in range(400)]
    orders = [order(f"o{at}", f"c{draw.randrange(60)}", bought=day if at % 15 else None) for at, day in enumerate(bought)]
    months = {}
    for _, customer, _, day, *_ in orders:
        buyer = customers[int(customer[1:])][1]
        if day and buyer:
            months.setdefault(buyer, set()).add(day.date().replace(day=1))
    wanted = {
        (buyer, min(found), month, (month.year - min(found).year) * 12 + month.month - min(found).month)
        for buyer, found in months.items()
        for month in found
    }
    tables = cleaning.clean_market(market(spark, orders=orders, customers=customers))
    rows = [tuple(row) for row in cohort.cohort_activity(tables).collect()]
    assert len(rows) == len(wanted) and set(rows) == wanted and max(row[3] for row in rows) > 64


def test_a_buyers_months_that_do_not_fit_are_an_error(spark):
    def activity(last, words):
        orders = [order("o1", "c1", bought="2000-01-05"), order("o2", "c1", bought=last)]
        return cohort.cohort_activity(cleaning.clean_market(market(spark, orders=orders, customers=[("c1", "b1", "x", "SP")])), words=words)

    assert [row.cohort_index for row in activity("2005-04-01", 1).collect()] == [0, 63]
    with pytest.raises(Exception, match="pass more words"):
        activity("2005-05-01", 1).collect()
    assert sorted(row.cohort_index for row in activity("2005-05-01", 2).collect()) == [0, 64]
