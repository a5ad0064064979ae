"""The nine contract tables, derived from TPC-H style Parquet tables.

The mapping gives the analytics something to chew on that those tables do not
have by themselves: buyers with two accounts, times of day, missing delivery
dates, products without category, several reviews per order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelark.contract import POSITION
from tradelark.market import Market

# Fixed values of the mapping.
STATUS = {"F": "delivered", "O": "shipped", "P": "processing"}
TRANSLATIONS = {
    "economy": "economy_goods",
    "medium": "medium_goods",
    "small": "small_goods",
    "large": "large_goods",
    "unknown": "unknown",
}
PROMISED_DAYS = 900

# Stated rather than read from the files: no job runs while a query is built.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
        o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": """l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double,
        l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string,
        l_shipdate timestamp_ntz""",
}


def _choose(column: str, mapping: dict[str, str]) -> Column:
    # One CASE, so that a filter on the result turns into a filter on the column.
    (found, meaning), *others = mapping.items()
    chosen = F.when(F.col(column) == found, meaning)
    for found, meaning in others:
        chosen = chosen.when(F.col(column) == found, meaning)
    return chosen


def load_market(spark: SparkSession, folder: str) -> Market:
    def read(table: str) -> DataFrame:
        return spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}.parquet")

    return Market(
        customers=lambda: _customers(read("customer"), read("nation")),
        orders=lambda: _orders(read("orders"), read("lineitem")),
        order_items=lambda: _order_items(read("lineitem")),
        payments=lambda: _payments(read("lineitem")),
        reviews=lambda: _reviews(read("lineitem")),
        products=lambda: _products(read("part")),
        sellers=lambda: _sellers(read("supplier"), read("nation")),
        geolocation=lambda: _geolocation(read("customer"), read("nation")),
        category_translation=lambda: _category_translation(spark),
    )


def _customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").select(
        key.alias("customer_id"),
        F.when(key % 10 == 1, key - 1).otherwise(key).alias("customer_unique_id"),
        F.col("c_mktsegment").alias("customer_city"),
        F.col("n_name").alias("customer_state"),
    )


def _orders(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    # Shipping dates are whole days, so the set kept per order is no larger than
    # the calendar the data spans, however many lines an order has.
    shipped = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.collect_set(F.col("l_shipdate").cast("date")).alias("ship_days")
    )
    placed = F.col("o_orderdate")
    on_time_days = F.filter("ship_days", lambda day: day >= placed.cast("date"))
    dated = orders.join(shipped, "o_orderkey", "left").withColumn(
        "arrived", F.array_min(on_time_days).cast("timestamp_ntz")
    )
    hour = F.make_dt_interval(F.lit(0), (F.col("o_orderkey") % 24).cast("int"))
    return dated.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        _choose("o_orderstatus", STATUS).alias("order_status"),
        (placed + hour).alias("order_purchase_timestamp"),
        (placed + F.make_dt_interval(F.lit(1))).alias("order_approved_at"),
        F.col("arrived").alias("order_delivered_carrier_date"),
        F.col("arrived").alias("order_delivered_customer_date"),
        (placed + F.make_dt_interval(F.lit(PROMISED_DAYS))).alias("order_estimated_delivery_date"),
    )


def _money(column: str):
    return F.col(column).cast("decimal(18,2)")


def _order_items(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("shipping_limit_date"),
        _money("l_extendedprice").alias("price"),
        _money("l_quantity").alias("freight_value"),
    )


def _payments(lineitem: DataFrame) -> DataFrame:
    method = (
        F.when(F.col("l_returnflag") == "R", "credit_card")
        .when(F.col("l_returnflag") == "A", "boleto")
        .when(F.col("l_linestatus") == "F", "voucher")
        .otherwise("debit_card")
    )
    return lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        method.alias("payment_type"),
        (F.col("l_quantity").cast("int") % 15).alias("payment_installments"),
        (_money("l_extendedprice") + _money("l_quantity")).cast("decimal(18,2)").alias("payment_value"),
    )


def _reviews(lineitem: DataFrame) -> DataFrame:
    written = F.col("l_shipdate").cast("timestamp_ntz")
    return lineitem.where(F.col("l_linenumber") == 1).select(
        F.col("l_orderkey").alias("order_id"),
        (F.col("l_quantity").cast("int") % 5 + 1).alias("review_score"),
        written.alias("review_creation_date"),
        written.alias("review_answer_timestamp"),
    )


def _products(part: DataFrame) -> DataFrame:
    kind = F.lower("p_type")
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.when(kind != "promo", kind).alias("product_category_name"),
    )


def _sellers(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey, "left").select(
        F.col("s_suppkey").alias("seller_id"),
        F.col("s_name").alias("seller_city"),
        F.col("n_name").alias("seller_state"),
    )


def _geolocation(customer: DataFrame, nation: DataFrame) -> DataFrame:
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey, "left").select(
        F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("geolocation_zip_code_prefix"),
        F.col("c_acctbal").alias("geolocation_lat"),
        (-F.col("c_acctbal")).alias("geolocation_lng"),
        F.col("c_mktsegment").alias("geolocation_city"),
        F.col("n_name").alias("geolocation_state"),
        F.col("c_custkey").alias(POSITION),
    )


def _category_translation(spark: SparkSession) -> DataFrame:
    pairs = ", ".join(f"('{name}', '{english}')" for name, english in TRANSLATIONS.items())
    return spark.sql(f"VALUES {pairs} AS pairs(product_category_name, product_category_name_english)")
