"""Operators on a small marketplace with the awkward cases in it."""

from __future__ import annotations

from decimal import Decimal as D

import pandas as pd
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from tests.helpers import by, market, order, records
from tradelark.operators import category, cleaning, cohort, headline, master, payment, performance, rfm, seller


def clean(spark, **rows):
    return cleaning.clean_market(market(spark, **rows))


CUSTOMERS = [
    ("c1", "b1", "Sao Paulo", "sp"),
    ("c2", "b1", "Sao Paulo", "sp"),
    ("c3", "b2", "Rio", "rj"),
    ("c4", None, "Rio", None),
]


@pytest.fixture(scope="module")
def shop(spark):
    """Fan-out order o1: 3 items, 2 payments, 2 reviews."""
    return clean(
        spark,
        customers=CUSTOMERS,
        orders=[
            order("o1", "c1", bought="2018-01-05", delivered="2018-01-10 12:00:00", promised="2018-01-09"),
            order("o2", "c2", bought="2018-03-01", delivered="2018-03-02 23:00:00", promised="2018-03-09"),
            order("o3", "c3", bought="2018-03-07", promised="2018-03-09"),
            order("o4", "c4", bought="2018-03-08", delivered="2018-03-08 10:00:00", promised="2018-03-08"),
            order("o5", "gone", bought="2018-05-01", delivered="2018-05-04", promised="2018-05-09"),
            order("o6", "c3", status="canceled"),
        ],
        order_items=[
            ("o1", 1, "p1", "s1", None, D("10.10"), D("1.00")),
            ("o1", 2, "p1", "s1", None, D("10.10"), D("1.00")),
            ("o1", 3, "p2", "s2", None, D("5.05"), D("0.50")),
            ("o2", 1, "gone", "s1", None, D("20.00"), D("2.00")),
            ("o3", 1, "p2", "gone", None, D("7.00"), D("0.70")),
            ("o4", 1, "p3", "s3", None, D("1.00"), D("0.10")),
            ("o6", 1, "p1", "s1", None, D("99.00"), D("9.00")),
        ],
        payments=[
            ("o1", 1, "credit_card", 3, D("20.00")),
            ("o1", 2, "voucher", 1, D("7.75")),
            ("o2", 1, "credit_card", 13, D("22.00")),
            ("o4", 1, None, 1, D("1.10")),
            ("o5", 1, "credit_card", 1, D("0.00")),
            ("o6", 1, "boleto", 1, D("108.00")),
        ],
        reviews=[("o1", 5, None, None), ("o1", 2, None, None), ("o2", 4, None, None), ("o4", None, None, None)],
        products=[("p1", "brinquedos"), ("p2", None), ("p3", "livros")],
        category_translation=[("brinquedos", "toys")],
        sellers=[("s1", "A", "SP"), ("s2", "B", "SP"), ("s3", "C", None)],
    )


def test_summaries_do_not_multiply(shop):
    orders = by(master.order_master(shop), "order_id")
    assert len(orders) == 6
    o1 = orders["o1"]
    assert (o1["item_count"], o1["merchandise_value"], o1["freight_value"]) == (3, D("25.25"), D("2.50"))
    assert (o1["unique_products"], o1["unique_sellers"]) == (2, 2)
    assert (o1["payment_value"], o1["payment_records"], o1["max_installments"]) == (D("27.75"), 2, 3)
    assert (o1["review_score"], o1["delivery_days"], o1["delivered_late"]) == (3.5, 5, True)
    assert orders["o3"]["payment_value"] is None and orders["o5"]["item_count"] is None
    assert orders["o4"]["review_score"] is None


def test_repeat_flag(shop):
    orders = by(master.order_master(shop), "order_id")
    seen = {key: (row["customer_delivered_orders"], row["is_repeat_customer"]) for key, row in orders.items()}
    assert seen == {"o1": (2, True), "o2": (2, True), "o3": (1, False), "o4": (0, False), "o5": (0, False), "o6": (1, False)}
    assert by(master.customer_order_counts(shop.orders, shop.customers), "customer_unique_id").keys() == {"b1", "b2"}


def test_validation(shop):
    assert records(master.master_validation(shop.orders, master.order_master(shop))) == [
        {
            "order_rows": 6, "master_rows": 6, "unique_orders": 6, "duplicate_orders": 0,
            "orders_with_items": 5, "orders_with_payments": 5, "orders_with_reviews": 2,
        }
    ]


def test_validation_fails_when_orders_multiply(shop):
    doubled = shop.having(customers=shop.customers.unionByName(shop.customers))
    with pytest.raises(PySparkException, match="one row per order"):
        master.master_validation(shop.orders, master.order_master(doubled)).collect()


def test_kpis_keep_unmatched_orders(shop):
    row = records(headline.business_kpis(shop))[0]
    assert (row["delivered_orders"], row["unique_customers"], row["repeat_customers"]) == (5, 2, 1)
    assert (row["merchandise_revenue"], row["customer_payments"]) == (D("53.25"), D("50.85"))
    assert row["average_order_value"] == pytest.approx(10.17)
    assert (row["repeat_customer_rate"], row["late_delivery_rate"]) == (50.0, 50.0)
    assert row["average_review_score"] == 3.75


def test_kpis_count_undated_orders_as_on_time(shop):
    row = records(headline.business_kpis(shop, late_policy="as_on_time", unmatched="drop", null_sums="null"))[0]
    assert (row["delivered_orders"], row["unique_customers"]) == (4, 2)
    # o4 was delivered after the promised midnight.
    assert row["late_delivery_rate"] == 50.0


def test_kpis_of_nothing(spark):
    row = records(headline.business_kpis(clean(spark)))[0]
    assert (row["delivered_orders"], row["customer_payments"], row["average_order_value"]) == (0, D("0.00"), None)


def test_months_compare_with_the_previous_month_present(shop):
    months = by(performance.monthly_performance(shop), "purchase_year_month")
    assert list(months) == ["2018-01", "2018-03", "2018-05"]
    assert (months["2018-03"]["orders"], months["2018-03"]["customers"], months["2018-03"]["revenue"]) == (3, 2, D("23.10"))
    assert months["2018-01"]["revenue_growth_pct"] is None
    assert months["2018-03"]["revenue_growth_pct"] == pytest.approx((23.10 / 27.75 - 1) * 100)
    assert months["2018-05"]["revenue_growth_pct"] == -100.0


def test_growth_after_a_zero_month_is_null(spark):
    tables = clean(
        spark,
        customers=CUSTOMERS,
        orders=[order("a", bought="2018-01-31 23:59:59"), order("b", bought="2018-02-01"), order("c", bought="2018-03-01"), order("d", bought="2018-04-01")],
        payments=[("a", 1, "x", 1, D("0")), ("b", 1, "x", 1, D("5")), ("d", 1, "x", 1, D("5"))],
    )
    growth = by(performance.monthly_growth(tables), "purchase_month")
    assert [growth[m]["revenue_growth_pct"] for m in ("2018-01", "2018-02", "2018-03", "2018-04")] == [None] * 4
    assert growth["2018-03"]["revenue"] is None
    python = by(performance.monthly_performance(tables), "purchase_year_month")
    assert python["2018-03"]["revenue"] == D("0.00") and python["2018-03"]["revenue_growth_pct"] == -100.0
    window = records(performance.monthly_growth(tables, ("2018-02-01", "2018-04-01")))
    assert [row["purchase_month"] for row in window] == ["2018-02", "2018-03"]


def test_states(shop):
    kept = by(performance.state_performance(shop), "customer_state")
    assert kept.keys() == {"SP", "RJ"}
    assert (kept["SP"]["orders"], kept["SP"]["customers"], kept["SP"]["revenue"]) == (2, 1, D("49.75"))
    assert kept["RJ"]["revenue"] == D("0.00")
    strict = by(performance.state_performance(shop, unmatched="drop", null_groups="keep", null_sums="null"), "customer_state")
    assert strict.keys() == {"SP", "RJ", None} and strict["RJ"]["revenue"] is None


def test_customer_types(shop):
    zero = by(headline.customer_type_summary(shop), "customer_type")
    assert (zero["Repeat Customer"]["customers"], zero["Repeat Customer"]["orders"]) == (1, 2)
    assert zero["One-Time Customer"]["average_customer_spend"] == 0.0
    strict = by(headline.customer_type_summary(shop, unmatched="drop", null_buyers="keep", null_sums="null"), "customer_type")
    # b2 has no payment and leaves the mean; the buyer without id counts as one buyer.
    assert (strict["One-Time Customer"]["customers"], strict["One-Time Customer"]["average_customer_spend"]) == (2, 1.1)


def test_delivery(shop):
    assert records(performance.delivery_time_stats(shop)) == [
        {"average_delivery_days": 2.25, "median_delivery_days": 2.0}
    ]
    lateness = by(performance.review_by_lateness(shop), "delivered_late")
    assert lateness[True]["average_review_score"] == 3.5 and lateness[False]["average_review_score"] == 4.0
    status = by(performance.delivery_status_satisfaction(shop), "delivery_status")
    assert (status["Late"]["orders"], status["On Time"]["orders"]) == (2, 2)
    assert status["On Time"]["average_delivery_days"] == pytest.approx((47 + 72) / 24 / 2)
    states = records(performance.state_delivery(shop, min_orders=1))
    assert [(row["customer_state"], row["delivered_orders"], row["late_delivery_rate_pct"]) for row in states] == [
        (None, 1, 100.0), ("SP", 2, 50.0),
    ]
    assert performance.state_delivery(shop, min_orders=2).count() == 1


def test_categories(shop):
    lines = {(row["order_id"], row["product_category_name_english"]): row for row in records(category.order_category(shop))}
    assert lines["o1", "toys"]["units_sold"] == 2 and lines["o1", "toys"]["unique_products"] == 1
    assert ("o6", "toys") in lines and lines["o2", "unknown"]["merchandise_revenue"] == D("20.00")
    found = by(category.category_performance(shop), "product_category_name_english")
    # Review and days of o1 count once for each of its two categories.
    assert (found["unknown"]["orders"], found["unknown"]["average_review_score"]) == (3, 3.75)
    assert (found["unknown"]["average_delivery_days"], found["unknown"]["late_delivery_rate"]) == (3.0, 50.0)
    assert found["toys"]["merchandise_revenue"] == D("20.20")
    dropped = by(category.category_performance(shop, unmatched="drop"), "product_category_name_english")
    assert dropped["unknown"]["orders"] == 2
    worst = records(category.lowest_reviewed_categories(shop, min_orders=1))
    assert [row["product_category_name_english"] for row in worst] == ["toys", "unknown", "livros"]
    latest = records(category.late_categories(shop, min_orders=1, n=2))
    assert [row["product_category_name_english"] for row in latest] == ["livros", "toys"]


def test_sellers(shop):
    found = by(seller.seller_performance(shop), "seller_id")
    assert found.keys() == {"s1", "s2"}
    assert (found["s1"]["orders"], found["s1"]["units_sold"], found["s1"]["merchandise_revenue"]) == (2, 3, D("40.20"))
    assert found["s1"]["revenue_per_order"] == pytest.approx(20.1)
    everyone = by(seller.seller_performance(shop, null_places="keep", unmatched="keep"), "seller_id")
    assert everyone.keys() == {"s1", "s2", "s3", "gone"}
    states = records(seller.seller_state_summary(shop))
    # Order o1 has two sellers in SP and counts once.
    assert states == [{"seller_state": "SP", "sellers": 2, "orders": 2, "merchandise_revenue": D("45.25")}]
    shares = records(seller.seller_concentration(seller.seller_revenue(shop), tops=(1, 2, 10)))[0]
    assert shares["active_sellers"] == 4
    assert shares["top_1_revenue_share_pct"] == pytest.approx(40.20 / 53.25 * 100)
    assert shares["top_1_revenue_share_pct"] <= shares["top_2_revenue_share_pct"] <= shares["top_10_revenue_share_pct"] == 100.0


def test_payments(shop):
    assert payment.delivered_payments(shop).count() == 5
    found = by(payment.payment_methods(shop), "payment_type")
    assert found.keys() == {"credit_card", "voucher"}
    assert (found["credit_card"]["payment_records"], found["credit_card"]["orders_using_method"]) == (3, 3)
    assert sum(row["payment_value_share_pct"] for row in found.values()) == pytest.approx(100)
    groups = records(payment.installment_groups(shop))
    assert [(row["installment_group"], row["orders"], row["total_payment_value"]) for row in groups] == [
        ("1 installment", 1, D("0.00")), ("2-3 installments", 1, D("20.00")), ("13+ installments", 1, D("22.00")),
    ]
    assert [tuple(row) for row in payment.installment_distribution(shop).collect()] == [(1, 1), (3, 1), (13, 1)]


def test_return_behaviour(shop):
    assert records(headline.return_behaviour(shop)) == [
        {"one_time_customers": 1, "repeat_customers": 1, "three_plus_customers": 0}
    ]
    assert [tuple(row) for row in headline.purchase_frequency(shop).collect()] == [(1, 2), (2, 1)]
    assert records(headline.repeat_rate(shop))[0]["total_customers"] == 3


def test_cohorts_over_a_year_end(spark):
    tables = clean(
        spark,
        customers=[("c1", "b1", "x", "SP"), ("c2", "b2", "x", "SP")],
        orders=[
            order("o1", "c1", bought="2016-12-31 23:00:00"),
            order("o2", "c1", bought="2017-01-01"),
            order("o3", "c1", bought="2017-01-20"),
            order("o4", "c1", bought="2018-01-05"),
            order("o5", "c2", bought="2016-12-01"),
            order("o6", "c2", bought="2016-11-01", status="canceled"),
        ],
    )
    retention = cohort.cohort_retention(cohort.cohort_activity(tables))
    assert [(str(row.cohort_month), row.cohort_index, row.active_customers, row.cohort_size, row.retention_rate) for row in retention.collect()] == [
        ("2016-12-01", 0, 2, 2, 100.0), ("2016-12-01", 1, 1, 2, 50.0), ("2016-12-01", 13, 1, 2, 50.0),
    ]
    assert cohort.indexes_present(retention) == [0, 1, 13]
    assert records(cohort.cohort_matrix(retention, [0, 1, 13])) == [
        {"cohort": "2016-12", "month_0": 100.0, "month_1": 50.0, "month_13": 50.0}
    ]
    head = records(cohort.cohort_matrix_head(retention, 3))
    assert head == [{"cohort": "2016-12", "month_0": 100.0, "month_1": 50.0, "month_2": None}]
    assert cohort.retention_window(retention, first_cohort="2017-01-01").count() == 0
    assert cohort.retention_window(retention, first_cohort="2016-12-01", last_index=5).count() == 2
    assert list(cohort.indexes_between("2016-12", "2018-01")) == list(range(14))


def _buyers(spark, spends, bought=None):
    count = len(spends)
    return clean(
        spark,
        customers=[(f"c{at}", f"b{at:03d}", "x", "SP") for at in range(count)],
        orders=[
            order(f"o{at}", f"c{at}", bought=bought[at] if bought else f"2018-{at % 12 + 1:02d}-{at % 28 + 1:02d}")
            for at in range(count)
        ],
        payments=[(f"o{at}", 1, "x", 1, D(str(spend))) for at, spend in enumerate(spends)],
    )


def test_ranked_customers_share_ranks(spark):
    spends = [100 - at for at in range(22)]
    spends[1] = spends[0]
    spends[20] = spends[19]
    ranked = records(headline.ranked_customers(_buyers(spark, spends)))
    assert [row["spend_rank"] for row in ranked][:3] == [1, 1, 2]
    assert ranked[-1]["spend_rank"] == 20 and len(ranked) == 22
    assert [row["customer_unique_id"] for row in ranked][:2] == ["b000", "b001"]


def test_top_n_ties_break_by_key(spark):
    top = rfm.top_customers(rfm.rfm_base(_buyers(spark, [5, 7, 7, 7, 1])).selectExpr("*", "'x' AS customer_segment"), 2)
    assert [row["customer_unique_id"] for row in records(top)] == ["b001", "b002"]


def test_rfm_scores_agree_with_pandas(spark):
    spends = [round(3 + (at * 37 % 101) / 7, 2) for at in range(53)] + [8.5] * 5
    base = rfm.rfm_base(_buyers(spark, spends))
    frame = base.toPandas()
    expected = pd.DataFrame(
        {
            "m": pd.qcut(frame["monetary"].astype(float), 5, labels=[1, 2, 3, 4, 5]).astype(int),
            "r": pd.qcut(frame["recency_days"], 5, labels=[5, 4, 3, 2, 1]).astype(int),
        }
    )
    want = dict(zip(frame["customer_unique_id"], zip(expected["r"], expected["m"])))
    got = {row["customer_unique_id"]: (row["recency_score"], row["monetary_score"]) for row in records(rfm.rfm_scores(base))}
    assert got == want
    assert frame["recency_days"].min() == 1


def test_rfm_refuses_or_collapses_repeated_edges(spark):
    base = rfm.rfm_base(_buyers(spark, [5] * 8 + [6, 7], [f"2018-01-{at + 1:02d}" for at in range(10)]))
    with pytest.raises((PySparkException, Py4JJavaError), match="edges repeat for monetary"):
        rfm.rfm_scores(base).collect()
    found = by(rfm.rfm_scores(base, repeated="collapse"), "customer_unique_id")
    assert found["b000"]["monetary_score"] == 1 and found["b009"]["monetary_score"] == 5
    assert found["b009"]["recency_score"] == 5 and found["b000"]["recency_score"] == 1


def test_segment_shares_add_up(spark):
    base = rfm.rfm_base(_buyers(spark, [round(1 + at * 1.5, 2) for at in range(40)]))
    summary = records(rfm.segment_summary(rfm.rfm_segments(rfm.rfm_scores(base))))
    assert sum(row["customers"] for row in summary) == 40
    assert sum(row["customer_share_pct"] for row in summary) == pytest.approx(100)
    assert sum(row["revenue_share_pct"] for row in summary) == pytest.approx(100)
    revenue = [row["total_revenue"] for row in summary]
    assert revenue == sorted(revenue, reverse=True)
