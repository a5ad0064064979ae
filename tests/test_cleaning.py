from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tests.helpers import by, market, order, records, table
from tradelark.operators import cleaning


def test_bad_timestamps_become_null(spark):
    values = ["2018-01-02 03:04:05", "2018-01-02", "not a date", "", "2018-13-45 00:00:00", None]
    frame = spark.createDataFrame([(value,) for value in values], "t string")
    expected = [datetime(2018, 1, 2, 3, 4, 5), datetime(2018, 1, 2), None, None, None, None]
    assert [row.t for row in cleaning.parse_timestamps(frame, ["t"]).collect()] == expected
    # The second time does not exist in the session time zone.
    spelled = spark.createDataFrame([("02/01/2018 03:04",), ("15/10/2017 00:30",), ("2018-01-02",), (None,)], "t string")
    found = cleaning.parse_timestamps(spelled, ["t"], "dd/MM/yyyy HH:mm").collect()
    assert [row.t for row in found] == [datetime(2018, 1, 2, 3, 4), datetime(2017, 10, 15, 0, 30), None, None]


def test_places(spark):
    frame = table(spark, "sellers", [("s1", " \tSao PAULO ", " sp\n"), ("s2", None, None)])
    found = by(cleaning.standardize_places(frame, "seller_city", "seller_state"), "seller_id")
    assert found["s1"] == {"seller_id": "s1", "seller_city": "sao paulo", "seller_state": "SP"}
    assert found["s2"]["seller_city"] is None


def test_categories(spark):
    products = table(spark, "products", [("p1", "brinquedos"), ("p2", None), ("p3", "outro"), ("p4", " brinquedos")])
    translation = table(spark, "category_translation", [(" brinquedos ", "toys\t")])
    found = by(cleaning.translate_categories(products, translation), "product_id")
    assert {key: row["product_category_name_english"] for key, row in found.items()} == {
        "p1": "toys", "p2": "unknown", "p3": "outro", "p4": " brinquedos",
    }
    assert found["p2"]["product_category_name"] == "unknown"


def _geo(spark, rows):
    return table(spark, "geolocation", rows).withColumn("source_position", F.monotonically_increasing_id())


def test_geo(spark):
    frame = _geo(
        spark,
        [
            ("01037", 1.0, -10.0, None, "SP"),
            ("01037", 2.0, -20.0, "first", None),
            ("01037", 2.0, -20.0, "first", None),  # an exact copy does not weigh in the median
            ("01037", 4.0, -40.0, "second", "RJ"),
            ("01037", 9.0, -90.0, "third", "RJ"),
            ("00002", 5.5, None, "x", "AM"),
            (None, 7.0, 7.0, "y", "AM"),
        ],
    )
    assert records(cleaning.geo_dedup_report(frame)) == [{"rows": 7, "distinct_rows": 6, "duplicates_removed": 1}]
    found = by(cleaning.geo_lookup(frame), "geolocation_zip_code_prefix")
    assert found == {
        "01037": {
            "geolocation_zip_code_prefix": "01037", "geolocation_lat": 3.0, "geolocation_lng": -30.0,
            "geolocation_city": "first", "geolocation_state": "SP",
        },
        "00002": {
            "geolocation_zip_code_prefix": "00002", "geolocation_lat": 5.5, "geolocation_lng": None,
            "geolocation_city": "x", "geolocation_state": "AM",
        },
    }


def test_order_features(spark):
    orders = table(
        spark,
        "orders",
        [
            order("early", bought="2018-02-28 14:00:00", delivered="2018-02-28 00:00:00", promised="2018-03-01"),
            order("late", bought="2018-01-01", delivered="2018-01-11 01:00:00", promised="2018-01-10"),
            order("equal", bought="2018-01-01", delivered="2018-01-10", promised="2018-01-10"),
            order("open", bought="2018-01-01", promised="2018-01-10", status="shipped"),
            order("unknown", bought=None, status=None),
        ],
    )
    found = by(cleaning.order_features(orders), "order_id")

    def pick(key, *names):
        return tuple(found[key][name] for name in names)

    days = ("delivery_days", "estimated_delivery_days", "delivery_delay_days", "delivered_late", "is_delivered")
    assert pick("early", *days) == (-1, 0, -1, False, True)
    assert pick("late", *days) == (10, 9, 1, True, True)
    assert pick("equal", *days) == (9, 9, 0, False, True)
    assert pick("open", *days) == (None, 9, None, None, False)
    assert pick("unknown", *days) == (None, None, None, None, False)
    calendar = ("purchase_year", "purchase_month", "purchase_year_month", "purchase_day_of_week")
    assert pick("early", *calendar) == (2018, 2, "2018-02", "Wednesday")
    assert pick("unknown", *calendar) == (None, None, None, None)


def test_cleaning_summary(spark):
    tables = market(
        spark,
        orders=[
            order("o1", delivered="2018-01-05", promised="2018-01-04"),
            order("o2", bought="2018-03-01 10:00:00", delivered="2018-03-03", promised="2018-03-04"),
            order("o3", bought="2017-05-05"),
            order("o4", status="shipped"),
        ],
        geolocation=[("1", 1.0, 1.0, "x", "SP"), ("1", 2.0, 1.0, "x", "SP"), (None, 2.0, 1.0, "x", "SP")],
    )
    clean = tables.having(
        orders=cleaning.order_features(tables.orders),
    )
    found = {row["metric"]: row["value"] for row in records(cleaning.cleaning_summary(clean))}
    assert found["rows_orders"] == "4" and found["rows_payments"] == "0" and found["rows_geolocation_lookup"] == "1"
    assert (found["first_purchase"], found["last_purchase"]) == ("2017-05-05 00:00:00", "2018-03-01 10:00:00")
    assert (found["delivered_true"], found["delivered_false"]) == ("3", "1")
    assert (found["late_true"], found["late_false"], found["late_unknown"]) == ("1", "1", "1")
