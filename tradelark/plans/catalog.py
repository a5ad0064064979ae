"""Every operator under a name, run over TPC-H style tables.

The thresholds and periods below fit those tables the way the defaults of the
operators fit a marketplace.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelark.contract import time_columns
from tradelark.functions.present import portable
from tradelark.market import Market
from tradelark.operators import (
    audit,
    category,
    cleaning,
    cohort,
    headline,
    inventory,
    master,
    payment,
    performance,
    rfm,
    seller,
)
from tradelark.plans.staging import staged
from tradelark.session import apply_runtime_settings
from tradelark.sources.tpch import load_market

Query = Callable[[SparkSession, str], DataFrame]

# Fixture values: smallest groups in reports over the sf0.01 tables.
CATEGORY_MIN_ORDERS = 2_300
SELLER_MIN_ORDERS = 190
STATE_MIN_ORDERS = 150
PERIOD = ("1996-01-01", "1998-01-01")
FIRST_COHORT = "1995-01-01"

# SQL flavours of a report: rows without dimension row drop, null groups stay, and
# a sum over nothing but nulls stays null.
STRICT = {"unmatched": "drop", "null_sums": "null"}
STRICT_STATES = {**STRICT, "null_groups": "keep"}
STRICT_BUYERS = {**STRICT, "null_buyers": "keep"}
STRICT_SELLERS = {"unmatched": "drop", "null_places": "keep", "days": "hours"}


def _as_text(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Timestamps rendered as text, the way a raw file would hold them."""
    return frame.withColumns({name: F.col(name).cast("string") for name in columns})


def _parsed_orders(raw: Market) -> DataFrame:
    names = time_columns("orders")
    text = _as_text(raw.orders, names)
    # Every 50th approval time is not a time.
    spoilt = F.when(F.col("order_id") % 50 == 0, "not approved").otherwise(F.col("order_approved_at"))
    text = text.withColumn("order_approved_at", spoilt)
    return cleaning.parse_timestamps(text, names).select("order_id", *names)


def _parsed(table: str, *keys: str) -> Callable[[Market], DataFrame]:
    def run(raw: Market) -> DataFrame:
        names = time_columns(table)
        text = _as_text(getattr(raw, table), names)
        return cleaning.parse_timestamps(text, names).select(*keys, *names)

    return run


def _places(raw: Market) -> DataFrame:
    def places(frame: DataFrame, kind: str, key: str) -> DataFrame:
        clean = cleaning.standardize_places(frame, f"{kind}_city", f"{kind}_state")
        return clean.select(
            F.lit(kind).alias("kind"),
            F.col(key).alias("id"),
            F.col(f"{kind}_city").alias("city"),
            F.col(f"{kind}_state").alias("state"),
        )

    return places(raw.customers, "customer", "customer_id").unionByName(
        places(raw.sellers, "seller", "seller_id")
    )


def _base(clean: Market) -> DataFrame:
    """The buyer base, written once: scores read it several times."""
    return staged(rfm.rfm_base(clean), "rfm-base")


def _segments(clean: Market) -> DataFrame:
    return rfm.rfm_segments(rfm.rfm_scores(_base(clean)))


def _scores(clean: Market, measure: str) -> DataFrame:
    scored = rfm.with_quintile_scores(_base(clean), measures=[measure])
    return scored.select(master.BUYER, f"{measure}_score")


def _retention(clean: Market) -> DataFrame:
    return cohort.cohort_retention(cohort.cohort_activity(clean))


def _strict_retention(clean: Market) -> DataFrame:
    return cohort.retention_window(_retention(clean), first_cohort=FIRST_COHORT)


def _matrix(clean: Market) -> DataFrame:
    return cohort.cohort_matrix(_retention(clean), cohort.indexes_possible(clean.orders))


def _profile_of_parts(raw: Market) -> DataFrame:
    """Orders by month of purchase, all other tables whole; counts up to 65,536 are exact."""
    month = F.date_format("order_purchase_timestamp", "yyyy-MM")
    kept = staged(inventory.table_sketches(raw.tables(), {"orders": month}, size_log=16), "sketches")
    return inventory.merged_profile(kept, raw.tables(), size_log=16)


# Operators on the tables as they come in.
RAW: dict[str, Callable[[Market], DataFrame]] = {
    "contract_check": audit.contract_check,
    "table_profile": audit.table_profile,
    "column_profile": audit.column_profile,
    "column_profile_parts": _profile_of_parts,
    "key_check": audit.key_checks,
    "identity_summary": lambda m: audit.identity_summary(m.customers),
    "top_identities": lambda m: audit.top_identities(m.customers),
    "child_cardinality": audit.child_cardinalities,
    "fk_orphans": audit.foreign_key_orphans,
    "status_distribution": lambda m: audit.status_distribution(m.orders),
    "parse_timestamps": _parsed_orders,
    "parse_item_timestamps": _parsed("order_items", "order_id", "order_item_id"),
    "parse_review_timestamps": _parsed("reviews", "order_id", "review_score"),
    "standardize_text": _places,
    "translate_categories": lambda m: cleaning.translate_categories(m.products, m.category_translation),
    "geo_dedup_report": lambda m: cleaning.geo_dedup_report(m.geolocation),
    "geo_lookup": lambda m: cleaning.geo_lookup(m.geolocation),
}

# Operators on cleaned tables.
CLEAN: dict[str, Callable[[Market], DataFrame]] = {
    "order_features": lambda m: m.orders.select(
        "order_id",
        "purchase_year",
        "purchase_month",
        "purchase_year_month",
        "purchase_day_of_week",
        "delivery_days",
        "estimated_delivery_days",
        "delivery_delay_days",
    ),
    "late_flag": lambda m: m.orders.select("order_id", "delivered_late"),
    "delivered_flag": lambda m: m.orders.select("order_id", "is_delivered"),
    "cleaning_summary": cleaning.cleaning_summary,
    "item_summary": lambda m: master.item_summary(m.order_items),
    "payment_summary": lambda m: master.payment_summary(m.payments),
    "review_summary": lambda m: master.review_summary(m.reviews),
    "order_master": master.order_master,
    "customer_order_counts": lambda m: master.customer_order_counts(m.orders, m.customers),
    "master_validation": lambda m: master.master_validation(m.orders, master.order_master(m)),
    "business_kpis": headline.business_kpis,
    "business_kpis_sql": lambda m: headline.business_kpis(m, late_policy="as_on_time", **STRICT).drop(
        "repeat_customers", "repeat_customer_rate"
    ),
    "repeat_rate": headline.repeat_rate,
    "monthly_performance": performance.monthly_performance,
    "monthly_growth": lambda m: performance.monthly_growth(m, PERIOD),
    "top_months": performance.top_months,
    "state_performance": performance.state_performance,
    "top_states": performance.top_states,
    "top_states_sql": lambda m: performance.top_states(m, **STRICT_STATES),
    "customer_type_summary": headline.customer_type_summary,
    "customer_type_summary_sql": lambda m: headline.customer_type_summary(m, **STRICT_BUYERS),
    "delivery_time_stats": performance.delivery_time_stats,
    "review_by_lateness": performance.review_by_lateness,
    "delivery_status_satisfaction": performance.delivery_status_satisfaction,
    "state_delivery": lambda m: performance.state_delivery(m, min_orders=STATE_MIN_ORDERS),
    "order_category": category.order_category,
    "category_performance": category.category_performance,
    "category_late_rate": category.category_late_rate,
    "top_categories_revenue": category.top_categories_revenue,
    "top_categories_revenue_sql": lambda m: category.top_categories_revenue(m, unmatched="drop", days="hours"),
    "top_categories_volume": category.top_categories_volume,
    "lowest_reviewed_categories": lambda m: category.lowest_reviewed_categories(m, min_orders=CATEGORY_MIN_ORDERS),
    "lowest_reviewed_categories_sql": lambda m: category.lowest_reviewed_categories(
        m, min_orders=CATEGORY_MIN_ORDERS, unmatched="drop", days="hours"
    ),
    "late_categories": lambda m: category.late_categories(m, min_orders=CATEGORY_MIN_ORDERS),
    "cohort_activity": cohort.cohort_activity,
    "cohort_retention": _retention,
    "cohort_retention_sql": _strict_retention,
    "cohort_sizes": lambda m: cohort.cohort_sizes(_retention(m)),
    "cohort_matrix": _matrix,
    "cohort_matrix_head": lambda m: cohort.cohort_matrix_head(_retention(m)),
    "return_behaviour": headline.return_behaviour,
    "purchase_frequency": headline.purchase_frequency,
    "delivered_payments": payment.delivered_payments,
    "payment_methods": payment.payment_methods,
    "card_orders": payment.card_orders,
    "installment_groups": payment.installment_groups,
    "installment_distribution": payment.installment_distribution,
    "rfm_base": rfm.rfm_base,
    "rfm_recency_score": lambda m: _scores(m, "recency"),
    "rfm_monetary_score": lambda m: _scores(m, "monetary"),
    "rfm_frequency_score": lambda m: rfm.with_frequency_score(rfm.rfm_base(m)).select(
        master.BUYER, "frequency_score"
    ),
    "rfm_segments": _segments,
    "segment_summary": lambda m: rfm.segment_summary(_segments(m)),
    "top_customers": lambda m: rfm.top_customers(_segments(m)),
    "ranked_customers": headline.ranked_customers,
    "seller_order": seller.seller_order,
    "seller_performance": seller.seller_performance,
    "top_sellers": seller.top_sellers,
    "top_sellers_sql": lambda m: seller.top_sellers(m, **STRICT_SELLERS),
    "seller_concentration": lambda m: seller.seller_concentration(seller.seller_performance(m)),
    "seller_concentration_sql": lambda m: seller.seller_concentration(seller.seller_revenue(m)),
    "lowest_reviewed_sellers": lambda m: seller.lowest_reviewed_sellers(m, min_orders=SELLER_MIN_ORDERS),
    "late_sellers": lambda m: seller.late_sellers(m, min_orders=SELLER_MIN_ORDERS),
    "late_sellers_sql": lambda m: seller.late_sellers(m, min_orders=SELLER_MIN_ORDERS, **STRICT_SELLERS),
    "seller_states": seller.top_seller_states,
}


def _query(operator: Callable[[Market], DataFrame], prepare: Callable[[Market], Market]) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        apply_runtime_settings(spark)
        return portable(operator(prepare(load_market(spark, folder))))

    return run


def catalog() -> dict[str, Query]:
    raw = {name: _query(operator, lambda market: market) for name, operator in RAW.items()}
    clean = {name: _query(operator, cleaning.clean_market) for name, operator in CLEAN.items()}
    return {**raw, **clean}
