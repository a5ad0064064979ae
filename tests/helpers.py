"""Hand-made tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tradelark.contract import CONTRACT
from tradelark.market import Market

SMALL = "/root/testdata/sf0.01"


def at(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text)


def table(spark: SparkSession, name: str, rows: list[tuple]) -> DataFrame:
    """Rows of a contract table, in the order of the contract; ids are text."""
    fields = CONTRACT[name]
    schema = ", ".join(f"{field.name} {field.types[0]}" for field in fields)
    return spark.createDataFrame(rows, schema)


def market(spark: SparkSession, **rows: list[tuple]) -> Market:
    return Market(**{name: table(spark, name, rows.get(name, [])) for name in CONTRACT})


def order(order_id, customer_id="c1", status="delivered", bought="2018-01-01", delivered=None, promised=None):
    return (order_id, customer_id, status, at(bought), None, None, at(delivered), at(promised))


def records(frame: DataFrame) -> list[dict]:
    return [row.asDict() for row in frame.collect()]


def by(frame: DataFrame, key: str) -> dict:
    return {row[key]: row.asDict() for row in frame.collect()}
