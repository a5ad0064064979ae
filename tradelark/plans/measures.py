"""Checks of a table gathered by the tasks that write it.

A written table needs no second scan for its counts and flags: the write observes them.
The observation has to be the last step before the write. There each task counts once however
often it or an earlier step is run anew; before an exchange, a step that is repeated
after the loss of an executor would count twice.

The functions that make reports return the rows of the query of the same name, from a
handful of numbers.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from tradelark.contract import CONTRACT
from tradelark.operators.cleaning import PURCHASED

Numbers = Mapping[str, Any]

# First of the rows that share an order id; for the uniqueness of the order table.
NUMBER = "_number_in_order"

_FLAGS = {"true": lambda flag: flag, "false": lambda flag: ~flag, "unknown": lambda flag: flag.isNull()}
# The parts of an order, and the column that shows that it has one.
_PARTS = {"items": "item_count", "payments": "payment_value", "reviews": "review_score"}


class Measured:
    """A frame to be written, and the numbers that are known once it is."""

    def __init__(self, measures: Mapping[str, Column]):
        self._measures = {"rows": F.count(F.lit(1)), **measures}
        self._observation = Observation()

    def on(self, frame: DataFrame) -> DataFrame:
        """The frame that is written, with nothing but the write after it."""
        return frame.observe(self._observation, *[column.alias(name) for name, column in self._measures.items()])

    def numbers(self, written: DataFrame) -> Numbers:
        """The numbers, after the write. ``written`` reads the table, in case that nothing was observed.

        That is so where a plan turns out to be empty and its last steps are not run.
        """
        found = self._observation.get
        if found.keys() >= self._measures.keys():
            return found
        return written.agg(*[column.alias(name) for name, column in self._measures.items()]).first().asDict()


def clean_measures(table: str, frame: DataFrame) -> Measured:
    """Missing keys of a clean table; of orders also the period and the flags."""
    keys = [field.name for field in CONTRACT[table] if field.key and field.name in frame.columns]
    measures = {f"nulls of {key}": F.count_if(F.col(key).isNull()) for key in keys}
    if table == "orders":
        delivered = F.col("is_delivered")
        measures["first_purchase"] = F.min(PURCHASED).cast("string")
        measures["last_purchase"] = F.max(PURCHASED).cast("string")
        for name, test in _FLAGS.items():
            measures[f"delivered_{name}"] = F.count_if(test(delivered))
            measures[f"late_{name}"] = F.count_if(delivered & test(F.col("delivered_late")))
    return Measured(measures)


def contract_rows(spark: SparkSession, types: Mapping[str, Mapping[str, str]], numbers: Mapping[str, Numbers]) -> DataFrame:
    """``audit.contract_check``, given the column types and the numbers of every table."""
    rows = [
        (table, field.name, field.name in types[table], types[table].get(field.name) in field.types, numbers[table].get(f"nulls of {field.name}"))
        for table in types
        for field in CONTRACT[table]
    ]
    return spark.createDataFrame(rows, "table string, column string, present boolean, type_accepted boolean, key_nulls bigint")


def cleaning_rows(spark: SparkSession, numbers: Mapping[str, Numbers], zips: int) -> DataFrame:
    """``cleaning.cleaning_summary``, given the numbers of every clean table and the located zip prefixes."""
    counted = ("customers", "orders", "order_items", "payments", "reviews", "products", "sellers")
    orders = numbers["orders"]
    rows = [
        *[(f"rows_{table}", str(numbers[table]["rows"])) for table in counted],
        ("rows_geolocation_lookup", str(zips)),
        *[(bound, orders[bound]) for bound in ("first_purchase", "last_purchase")],
        # A flag that no order has is no row.
        *[(metric, str(orders[metric])) for kind in ("delivered", "late") for name in _FLAGS if orders[metric := f"{kind}_{name}"]],
    ]
    return spark.createDataFrame(rows, "metric string, value string")


def numbered(orders: DataFrame) -> DataFrame:
    """Orders with their number among those of the same id. Tables stored by order id need no exchange for it."""
    return orders.withColumn(NUMBER, F.row_number().over(Window.partitionBy("order_id").orderBy("order_id")))


def master_measures() -> Measured:
    """What ``validation_row`` takes, for an order table that was made of numbered orders."""
    first = F.col(NUMBER) == 1
    parts = {part: F.count_if(F.col(name).isNotNull()) for part, name in _PARTS.items()}
    return Measured({"groups": F.count_if(first), "unique": F.count_if(first & F.col("order_id").isNotNull()), **parts})


def validation_row(spark: SparkSession, orders: Numbers, master: Numbers) -> DataFrame:
    """``master.master_validation``, given the numbers of the orders and of the order table.

    An error when the order table does not have exactly one row per order. It has no row too many
    else, since all its joins keep every order, so that first rows of an id stand for ids.
    """
    if orders["rows"] != master["rows"]:
        raise ValueError(f"the order master does not keep one row per order: {orders['rows']} orders, {master['rows']} rows")
    row = {
        "order_rows": orders["rows"],
        "master_rows": master["rows"],
        "unique_orders": master["unique"],
        "duplicate_orders": master["rows"] - master["groups"],
        **{f"orders_with_{part}": master[part] for part in _PARTS},
    }
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{name} bigint" for name in row))
