"""Catalog tables and views, for those who ask in SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import SparkSession

from tradelark.contract import TABLES
from tradelark.market import Market


def read_table_market(spark: SparkSession, database: str | None = None) -> Market:
    """The contract tables from the session catalog."""
    prefix = f"{database}." if database else ""
    return Market(**{table: partial(spark.table, f"{prefix}{table}") for table in TABLES})


def register_views(market: Market) -> None:
    """Make each table a temporary view of the same name, to be used from ``spark.sql``."""
    for name, frame in market.tables().items():
        frame.createOrReplaceTempView(name)
