"""From raw tables to clean ones, and the features of an order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelark.contract import POSITION, data_columns, time_columns
from tradelark.functions.clock import day_name, floor_days, parsed_with, year_month
from tradelark.functions.labels import COMPLETED, UNKNOWN_CATEGORY
from tradelark.functions.order_stats import degree_ladder, scaled_quantiles
from tradelark.functions.text import strip, strip_lower, strip_upper
from tradelark.market import Market

PURCHASED = "order_purchase_timestamp"
MONTH = "purchase_year_month"
DELIVERED = "order_delivered_customer_date"
PROMISED = "order_estimated_delivery_date"


def parse_timestamps(frame: DataFrame, columns: Sequence[str], pattern: str | None = None) -> DataFrame:
    """Text to zone-less timestamps; text that is no timestamp becomes null."""

    def parsed(name: str) -> Column:
        if pattern is None:
            return F.col(name).try_cast("timestamp_ntz")
        return parsed_with(F.col(name), pattern)

    return frame.withColumns({name: parsed(name) for name in columns})


def standardize_places(frame: DataFrame, city: str, state: str) -> DataFrame:
    return frame.withColumns({city: strip_lower(city), state: strip_upper(state)})


def translate_categories(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Add the english category; without a translation the original name stands in.

    The translation side is stripped, the product side is matched as it is.
    """
    english = translation.select(
        strip("product_category_name").alias("product_category_name"),
        strip("product_category_name_english").alias("product_category_name_english"),
    )
    named = products.withColumn(
        "product_category_name", F.coalesce("product_category_name", F.lit(UNKNOWN_CATEGORY))
    )
    return named.join(english, "product_category_name", "left").withColumn(
        "product_category_name_english", F.coalesce("product_category_name_english", "product_category_name")
    )


def geo_dedup_report(geolocation: DataFrame) -> DataFrame:
    """How many rows an exact de-duplication removes."""
    copies = _distinct_geo(geolocation).agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows")
    )
    return copies.select("rows", "distinct_rows", (F.col("rows") - F.col("distinct_rows")).alias("duplicates_removed"))


def _distinct_geo(geolocation: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies; the position in the source is not part of a row."""
    return geolocation.groupBy(*data_columns(geolocation.columns)).agg(F.count("*").alias("_copies"))


def geo_lookup(geolocation: DataFrame) -> DataFrame:
    """Per zip prefix: median coordinates over distinct rows, first known city and state.

    "First" follows the column ``source_position``, which the readers provide.
    """
    zip_prefix = "geolocation_zip_code_prefix"
    located = geolocation.where(F.col(zip_prefix).isNotNull())

    axes = ["geolocation_lat", "geolocation_lng"]
    # Both coordinates go through one quantile run, as (zip, axis, degrees) rows.
    points = _distinct_geo(located).select(zip_prefix, *axes).unpivot(zip_prefix, axes, "axis", "degrees")
    medians = scaled_quantiles(
        points, [zip_prefix, "axis"], degree_ladder(F.col("degrees")), parts=2, slots=[1]
    )

    def median_of(axis: str) -> Column:
        return (F.max(F.when(F.col("axis") == axis, F.col("mark"))) / 2).alias(axis)

    def first_known(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), F.col(POSITION))).alias(name)

    places = located.groupBy(zip_prefix).agg(first_known("geolocation_city"), first_known("geolocation_state"))
    centres = medians.groupBy(zip_prefix).agg(*[median_of(axis) for axis in axes])
    return places.join(centres, zip_prefix, "left").select(
        zip_prefix, *axes, "geolocation_city", "geolocation_state"
    )


def late_flag() -> Column:
    """Delivered after the promised time; unknown unless both times are known."""
    return F.col(DELIVERED) > F.col(PROMISED)


def delivered_flag() -> Column:
    return F.coalesce(F.col("order_status") == COMPLETED, F.lit(False))


def delay_features() -> dict[str, Column]:
    return {
        "delivery_days": floor_days(F.col(DELIVERED), F.col(PURCHASED)),
        "delivery_delay_days": floor_days(F.col(DELIVERED), F.col(PROMISED)),
        "delivered_late": late_flag(),
    }


def order_features(orders: DataFrame) -> DataFrame:
    """Add calendar columns, day counts and the two delivery flags.

    An order without purchase time has a null month.
    """
    bought = F.col(PURCHASED)
    return orders.withColumns(
        {
            "purchase_year": F.year(bought),
            "purchase_month": F.month(bought),
            MONTH: year_month(bought),
            "purchase_day_of_week": day_name(bought),
            "estimated_delivery_days": floor_days(F.col(PROMISED), bought),
            **delay_features(),
            "is_delivered": delivered_flag(),
        }
    )


def clean_market(market: Market) -> Market:
    """Every cleaning step. Keys, rows and unlisted columns are left as they are."""
    return market.having(
        customers=lambda: standardize_places(market.customers, "customer_city", "customer_state"),
        sellers=lambda: standardize_places(market.sellers, "seller_city", "seller_state"),
        orders=lambda: order_features(parse_timestamps(market.orders, time_columns("orders"))),
        order_items=lambda: parse_timestamps(market.order_items, time_columns("order_items")),
        reviews=lambda: parse_timestamps(market.reviews, time_columns("reviews")),
        products=lambda: translate_categories(market.products, market.category_translation),
    )


def cleaning_summary(clean: Market) -> DataFrame:
    """(metric, value) rows, values as text: row counts, date range and flag counts."""

    def rows(metric: str, frame: DataFrame) -> DataFrame:
        return frame.agg(F.count("*").cast("string").alias("value")).select(F.lit(metric).alias("metric"), "value")

    def flag_counts(prefix: str, frame: DataFrame, flag: str) -> DataFrame:
        name = F.coalesce(F.col(flag).cast("string"), F.lit("unknown"))
        return frame.groupBy(F.concat(F.lit(prefix), name).alias("metric")).agg(
            F.count("*").cast("string").alias("value")
        )

    counted = ("customers", "orders", "order_items", "payments", "reviews", "products", "sellers")
    zips = clean.geolocation.where(F.col("geolocation_zip_code_prefix").isNotNull())
    zips = zips.select("geolocation_zip_code_prefix").distinct()
    bounds = clean.orders.agg(F.min(PURCHASED).alias("low"), F.max(PURCHASED).alias("high")).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(metric).alias("metric"),
                        F.col(bound).cast("string").alias("value"),
                    )
                    for metric, bound in (("first_purchase", "low"), ("last_purchase", "high"))
                ]
            )
        )
    )
    parts = [
        *[rows(f"rows_{table}", getattr(clean, table)) for table in counted],
        rows("rows_geolocation_lookup", zips),
        bounds,
        flag_counts("delivered_", clean.orders, "is_delivered"),
        flag_counts("late_", clean.orders.where("is_delivered"), "delivered_late"),
    ]
    return reduce(DataFrame.unionByName, parts)
