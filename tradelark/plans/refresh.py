"""From raw files to every published table.

Raw CSV -> profiles and checks -> clean tables -> one row per order -> reports.
Clean tables, the order table, the buyer base and the month, category and seller tables
are written once; the lists and summaries made of them read them back. Their checks are
gathered while they are written (``plans.measures``). The other reports each aggregate the clean tables on their own. A lost executor costs at most the step it
was working on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelark.contract import TABLES
from tradelark.functions.bitmaps import numbered_keys
from tradelark.market import Market
from tradelark.operators import audit, category, cleaning, cohort, headline, inventory, master, payment, performance, rfm, seller
from tradelark.plans import measures
from tradelark.plans.measures import Measured, Numbers
from tradelark.sources.buckets import Layout, bucket_count, replace_partitions, write_bucketed
from tradelark.sources.files import read_csv_market, write_table


# Tables stored by order: they meet each other on order_id without an exchange. An order may have any
# number of items, payments and reviews, so those are spread within their bucket.
BY_ORDER = {"orders": 1, "order_items": 4, "payments": 4, "reviews": 4}


class Refresh:
    """Writes tables below one output folder, in Parquet or additionally in CSV.

    ``buckets`` is how many the tables by order are stored in, by default as their raw size asks for.
    """

    def __init__(self, spark: SparkSession, out: str, *, report_format: str = "parquet", buckets: int | None = None):
        self.spark = spark
        self.out = out
        self.report_format = report_format
        self.buckets = buckets

    def _stored(self, section: str, name: str, frame: DataFrame, *, without: str | None = None, measured: Measured | None = None) -> DataFrame:
        """Write a table, without a column that only its measures need."""
        path = f"{self.out}/{section}/{name}"
        kept = frame.drop(without) if without else frame
        write_table((measured.on(frame).select(*kept.columns) if measured else kept), path)
        return self.spark.read.schema(kept.schema).parquet(path)

    def layout(self, table: str) -> Layout:
        """How a clean table by order is stored; orders are also stored by month."""
        partition = cleaning.MONTH if table == "orders" else None
        return Layout("order_id", self.buckets or 1, partition, BY_ORDER[table])

    def _clean_table(self, table: str, frame: DataFrame) -> tuple[DataFrame, Numbers]:
        measured = measures.clean_measures(table, frame)
        if table in BY_ORDER:
            written = write_bucketed(frame, f"{self.out}/clean/{table}", self.layout(table), last=measured.on)
        else:
            written = self._stored("clean", table, frame, measured=measured)
        return written, measured.numbers(written)

    def _report(self, name: str, frame: DataFrame) -> None:
        write_table(frame, f"{self.out}/reports/{name}", self.report_format)

    def run(self, paths: Mapping[str, str]) -> None:
        raw = read_csv_market(self.spark, paths)
        if self.buckets is None:
            self.buckets = bucket_count(self.spark, [paths[table] for table in BY_ORDER])
        self.profile(raw)
        clean = self.clean(raw)
        self.reports(clean)

    def profile(self, raw: Market) -> None:
        profiles = {
            "dataset_summary": audit.table_profile,
            "column_inventory": audit.column_profile,
            "key_checks": audit.key_checks,
            "identity_summary": lambda m: audit.identity_summary(m.customers),
            "top_identities": lambda m: audit.top_identities(m.customers),
            "child_cardinality": audit.child_cardinalities,
            "foreign_key_orphans": audit.foreign_key_orphans,
            "status_distribution": lambda m: audit.status_distribution(m.orders),
            "geo_duplicates": lambda m: cleaning.geo_dedup_report(m.geolocation),
        }
        for name, make in profiles.items():
            self._report(name, make(raw))

    def clean(self, raw: Market) -> Market:
        """Write the clean tables and return the market that reads them."""
        derived = cleaning.clean_market(raw)
        written = {name: self._clean_table(name, getattr(derived, name)) for name in TABLES}
        stored = Market(**{name: table for name, (table, _) in written.items()})
        numbers = {name: found for name, (_, found) in written.items()}
        located = Measured({})
        lookup = self._stored("clean", "geolocation_lookup", cleaning.geo_lookup(stored.geolocation), measured=located)
        types = {name: dict(table.dtypes) for name, table in stored.tables().items()}
        self._report("contract_check", measures.contract_rows(self.spark, types, numbers))
        self._report("cleaning_summary", measures.cleaning_rows(self.spark, numbers, located.numbers(lookup)["rows"]))
        return stored

    def replace_months(self, clean_orders: DataFrame) -> None:
        """Put cleaned orders in place of the months they were bought in; all orders of these months must be given.

        The column profile follows: only these months are sketched again.
        """
        replace_partitions(clean_orders, f"{self.out}/clean/orders", self.layout("orders"))
        self.sketch({"orders": clean_orders})

    def sketch(self, tables: Mapping[str, DataFrame]) -> None:
        """Keep the column sketches of these tables, of orders by month."""
        made = inventory.table_sketches(tables, {"orders": F.col(cleaning.MONTH)})
        inventory.store_sketches(made, f"{self.out}/master/column_sketches")

    def column_profile(self, clean: Market) -> DataFrame:
        """The profile of the clean tables from their kept sketches; no table is read."""
        kept = inventory.stored_sketches(self.spark, f"{self.out}/master/column_sketches")
        return inventory.merged_profile(kept, clean.tables())

    def order_table(self, clean: Market) -> DataFrame:
        """Write the table of one row per order and its validation."""
        # Orders are counted where they are read, which is a count of the files' footers.
        given = {"rows": clean.orders.count()}
        built = master.order_master(clean.having(orders=measures.numbered(clean.orders)))
        measured = measures.master_measures()
        orders = self._stored("master", "order_analysis", built, without=measures.NUMBER, measured=measured)
        self._report("master_validation", measures.validation_row(self.spark, given, measured.numbers(measures.numbered(orders))))
        return orders

    def order_numbers(self, clean: Market) -> DataFrame:
        """Write the numbers that stand for orders in mergeable counts, in the buckets of the orders."""
        layout = Layout("order_id", self.buckets or 1)
        return write_bucketed(numbered_keys(clean.orders, "order_id", layout.buckets), f"{self.out}/master/order_numbers", layout)

    def state_table(self, clean: Market) -> None:
        """Write which orders sold from a state, and the report made of it."""
        sold = self._stored("master", "seller_state_orders", seller.seller_state_orders(clean, self.order_numbers(clean)))
        self._report("seller_state_summary", seller.seller_state_summary(clean, orders=sold))

    def reports(self, clean: Market) -> None:
        self.order_table(clean)
        self.state_table(clean)
        self.sketch(clean.tables())
        self._report("clean_column_inventory", self.column_profile(clean))
        base = self._stored("master", "rfm_base", rfm.rfm_base(clean))
        segments = self._stored("master", "customer_rfm", rfm.rfm_segments(rfm.rfm_scores(base)))
        self._report("customer_rfm", segments)
        retention = self._stored("master", "cohort_retention", cohort.cohort_retention(cohort.cohort_activity(clean)))
        for name, make in market_reports():
            self._report(name, make(clean))
        for name, (make, derived) in shared_tables().items():
            table = self._stored("master", name, make(clean))
            self._report(name, table)
            for report, pick in derived.items():
                self._report(report, pick(table))
        self._report("customer_segment_summary", rfm.segment_summary(segments))
        self._report("top_customers", rfm.top_customers(segments))
        self._report("cohort_retention_long", retention)
        self._report("cohort_retention_matrix", cohort.cohort_matrix(retention, cohort.indexes_present(retention)))


def market_reports() -> Iterator[tuple[str, Callable[[Market], DataFrame]]]:
    """The reports that need nothing but the clean market."""
    yield "business_kpis", headline.business_kpis
    yield "customer_type_summary", headline.customer_type_summary
    yield "return_behaviour", headline.return_behaviour
    yield "purchase_frequency", headline.purchase_frequency
    yield "ranked_customers", headline.ranked_customers
    yield "state_performance", performance.state_performance
    yield "delivery_time_stats", performance.delivery_time_stats
    yield "review_by_lateness", performance.review_by_lateness
    yield "delivery_status_satisfaction", performance.delivery_status_satisfaction
    yield "state_delivery", performance.state_delivery
    yield "payment_method_summary", payment.payment_methods
    yield "installment_summary", payment.installment_groups
    yield "installment_distribution", payment.installment_distribution
    yield "business_kpis_sql", lambda m: headline.business_kpis(
        m, late_policy="as_on_time", unmatched="drop", null_sums="null"
    )
    yield "top_categories_revenue_sql", lambda m: category.top_categories_revenue(m, unmatched="drop", days="hours")
    yield "top_sellers_sql", lambda m: seller.top_sellers(m, unmatched="drop", null_places="keep", days="hours")


def shared_tables() -> dict[str, tuple[Callable[[Market], DataFrame], dict[str, Callable[[DataFrame], DataFrame]]]]:
    """Tables that several reports are made of: how to make each, and the reports."""
    return {
        "monthly_performance": (performance.monthly_performance, {"top_months": performance.best_months}),
        "category_performance": (
            category.category_performance,
            {
                "top_categories_revenue": category.by_revenue,
                "top_categories_volume": category.by_volume,
                "lowest_reviewed_categories": category.lowest_reviewed,
                "late_categories": category.most_late,
            },
        ),
        "seller_performance": (
            seller.seller_performance,
            {
                "seller_concentration": seller.seller_concentration,
                "top_sellers": seller.by_revenue,
                "lowest_reviewed_sellers": seller.lowest_reviewed,
                "late_sellers": seller.most_late,
            },
        ),
    }
