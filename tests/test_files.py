"""CSV in, tables out."""

from __future__ import annotations

import subprocess
import sys
from decimal import Decimal as D
from pathlib import Path

import pytest

from tests.helpers import by, records
from tradelark.contract import CONTRACT
from tradelark.operators import cleaning, headline
from tradelark.plans import staging
from tradelark.plans.refresh import Refresh
from tradelark.sources import files, tables

RAW = {
    "customers": "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
    + "".join(f"c{at},b{at // 2 if at < 4 else at},01037, Sao Paulo ,sp\n" for at in range(30)),
    "orders": "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,"
    "order_delivered_customer_date,order_estimated_delivery_date\n"
    + "".join(
        f"o{at},c{at},delivered,2018-{at % 9 + 1:02d}-{at % 27 + 1:02d} 10:00:00,oops,,2018-{at % 9 + 1:02d}-28 09:00:00,2018-{at % 9 + 1:02d}-27\n"
        for at in range(30)
    )
    + "o30,c1,shipped,2018-02-03 10:00:00,,,,\n",
    "order_items": "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\n"
    + "".join(f"o{at},1,p{at % 3},s{at % 4},2018-01-01,{at + 1}.10,{at}.5\n" for at in range(30)),
    "payments": "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
    + "".join(f"o{at},1,credit_card,{at % 14}.0,{2 * at + 1}.60\n" for at in range(30)),
    "reviews": 'order_id,review_score,review_comment_message,review_creation_date,review_answer_timestamp\n'
    'o1,5,"two\nlines, ""quoted""",2018-01-01,bad\no2,4,NaN,2018-01-01,2018-01-02 00:00:00\n',
    "products": "product_id,product_category_name,product_weight_g\np0,brinquedos,10\np1,,20\np2,N/A,30\n",
    "sellers": "seller_id,seller_city,seller_state\n" + "".join(f"s{at},City,SP\n" for at in range(4)),
    "geolocation": "geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,geolocation_state\n"
    "01037,-23.5,-46.6,,SP\n01037,-23.7,-46.8,sao paulo,SP\n01037,-23.7,-46.8,sao paulo,SP\n",
    "category_translation": "product_category_name,product_category_name_english\nbrinquedos,toys\n",
}


@pytest.fixture(scope="module")
def raw(tmp_path_factory) -> dict[str, str]:
    folder = tmp_path_factory.mktemp("raw")
    for table, text in RAW.items():
        (folder / f"{table}.csv").write_text(text)
    return {table: str(folder / f"{table}.csv") for table in RAW}


def test_every_missing_input_is_named(spark, raw):
    some = {table: path for table, path in raw.items() if table not in ("orders", "sellers")}
    with pytest.raises(ValueError, match="orders.*sellers"):
        files.read_csv_market(spark, some)


def test_missing_columns_are_named(spark, tmp_path):
    (tmp_path / "x.csv").write_text("seller_id\ns1\n")
    with pytest.raises(ValueError, match="seller_city.*seller_state"):
        files.read_csv_table(spark, "sellers", str(tmp_path / "x.csv"))


def test_types_follow_the_contract(spark, raw):
    loaded = files.read_csv_market(spark, raw)
    geo = loaded.geolocation.orderBy("source_position").collect()
    assert [row.geolocation_zip_code_prefix for row in geo] == ["01037"] * 3 and geo[0].geolocation_city is None
    assert by(loaded.products, "product_id")["p2"]["product_category_name"] is None
    payment = by(loaded.payments, "order_id")["o13"]
    assert (payment["payment_installments"], payment["payment_value"]) == (13, D("27.60"))
    reviews = by(loaded.reviews, "order_id")
    assert reviews["o1"]["review_comment_message"] == 'two\nlines, "quoted"'
    assert reviews["o2"]["review_comment_message"] is None


def test_refresh_writes_every_table(spark, raw, tmp_path):
    out = str(tmp_path / "out")
    Refresh(spark, out).run(raw)

    def stored(name):
        return spark.read.parquet(f"{out}/{name}")

    master = stored("master/order_analysis")
    assert master.count() == 31
    o1 = by(master, "order_id")["o1"]
    assert (o1["customer_city"], o1["customer_state"], o1["order_approved_at"]) == ("sao paulo", "SP", None)
    assert o1["customer_zip_code_prefix"] == "01037"
    assert (o1["customer_delivered_orders"], o1["payment_value"], o1["delivered_late"]) == (2, D("3.60"), True)
    assert by(stored("clean/products"), "product_id")["p1"]["product_category_name_english"] == "unknown"
    lookup = records(stored("clean/geolocation_lookup"))
    assert lookup[0]["geolocation_lat"] == pytest.approx(-23.6) and lookup[0]["geolocation_city"] == "sao paulo"
    accepted = [row for row in records(stored("reports/contract_check")) if not (row["present"] and row["type_accepted"])]
    assert accepted == []
    assert by(stored("reports/dataset_summary"), "table")["geolocation"]["duplicate_rows"] == 1
    assert stored("reports/customer_rfm").count() == 28
    assert "month_0" in stored("reports/cohort_retention_matrix").columns
    kpis = records(stored("reports/business_kpis"))[0]
    assert (kpis["delivered_orders"], kpis["unique_customers"], kpis["repeat_customers"]) == (30, 28, 2)


def test_csv_reports(spark, tmp_path):
    path = str(tmp_path / "report")
    frame = spark.createDataFrame([("a,b", 'say "x"', None)], "k string, v string, w string").coalesce(1)
    files.write_table(frame, path, "csv")
    text = "".join(part.read_text() for part in Path(path).glob("part-*.csv"))
    assert text.splitlines() == ["k,v,w", '"a,b","say ""x""",']


def test_staged_tables_go_to_the_session_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert staging.checkpoint_folder(spark) == named
    again = staging.staged(spark.range(5).selectExpr("id", "id * 2 AS twice"), "numbers")
    assert again.agg({"twice": "sum"}).first()[0] == 20
    assert all(named in path for path in again.inputFiles())


def test_contract_lists_nine_tables():
    assert len(CONTRACT) == 9


def test_command_line_explains_itself():
    done = subprocess.run([sys.executable, "-m", "tradelark", "--help"], capture_output=True, text=True, cwd=Path(__file__).parents[1])
    assert done.returncode == 0 and "--input" in done.stdout


def test_views_answer_sql(spark, raw):
    tables.register_views(cleaning.clean_market(files.read_csv_market(spark, raw)))
    row = spark.sql(
        """SELECT count(DISTINCT o.order_id) AS orders, round(sum(p.payment_value), 2) AS revenue
        FROM orders o JOIN customers c ON o.customer_id = c.customer_id
        LEFT JOIN payments p ON o.order_id = p.order_id WHERE o.order_status = 'delivered'"""
    ).first()
    assert (row.orders, row.revenue) == (30, D("918.00"))
    again = tables.read_table_market(spark)
    assert headline.return_behaviour(again).first().repeat_customers == 2
