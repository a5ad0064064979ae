"""The nine input tables: columns, accepted Spark types and keys.

Identifiers may be text or 64-bit integers. Times are ``timestamp_ntz``: the data
carries wall-clock times without a zone, and this type keeps every date
calculation independent of the session time zone. Money is ``decimal(18,2)``.
Columns that are not listed pass through the operators untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

IDENTIFIER = ("string", "bigint")
TEXT = ("string",)
WHOLE = ("int", "bigint")
MONEY = ("decimal(18,2)",)
DEGREES = ("double",)
TIME = ("timestamp_ntz",)


@dataclass(frozen=True)
class Field:
    name: str
    types: tuple[str, ...]
    key: bool = False


CONTRACT: dict[str, tuple[Field, ...]] = {
    "customers": (
        Field("customer_id", IDENTIFIER, key=True),
        Field("customer_unique_id", IDENTIFIER),
        Field("customer_city", TEXT),
        Field("customer_state", TEXT),
    ),
    "orders": (
        Field("order_id", IDENTIFIER, key=True),
        Field("customer_id", IDENTIFIER),
        Field("order_status", TEXT),
        Field("order_purchase_timestamp", TIME),
        Field("order_approved_at", TIME),
        Field("order_delivered_carrier_date", TIME),
        Field("order_delivered_customer_date", TIME),
        Field("order_estimated_delivery_date", TIME),
    ),
    "order_items": (
        Field("order_id", IDENTIFIER, key=True),
        Field("order_item_id", WHOLE, key=True),
        Field("product_id", IDENTIFIER),
        Field("seller_id", IDENTIFIER),
        Field("shipping_limit_date", TIME),
        Field("price", MONEY),
        Field("freight_value", MONEY),
    ),
    "payments": (
        Field("order_id", IDENTIFIER, key=True),
        Field("payment_sequential", WHOLE, key=True),
        Field("payment_type", TEXT),
        Field("payment_installments", WHOLE),
        Field("payment_value", MONEY),
    ),
    "reviews": (
        Field("order_id", IDENTIFIER),
        Field("review_score", WHOLE),
        Field("review_creation_date", TIME),
        Field("review_answer_timestamp", TIME),
    ),
    "products": (
        Field("product_id", IDENTIFIER, key=True),
        Field("product_category_name", TEXT),
    ),
    "sellers": (
        Field("seller_id", IDENTIFIER, key=True),
        Field("seller_city", TEXT),
        Field("seller_state", TEXT),
    ),
    "geolocation": (
        Field("geolocation_zip_code_prefix", TEXT),
        Field("geolocation_lat", DEGREES),
        Field("geolocation_lng", DEGREES),
        Field("geolocation_city", TEXT),
        Field("geolocation_state", TEXT),
    ),
    "category_translation": (
        Field("product_category_name", TEXT, key=True),
        Field("product_category_name_english", TEXT),
    ),
}

TABLES = tuple(CONTRACT)

# Added by the readers where row order matters; not part of the data.
POSITION = "source_position"


def columns(table: str) -> list[str]:
    return [field.name for field in CONTRACT[table]]


def data_columns(names: list[str]) -> list[str]:
    return [name for name in names if name != POSITION]


def time_columns(table: str) -> list[str]:
    return [field.name for field in CONTRACT[table] if field.types == TIME]
