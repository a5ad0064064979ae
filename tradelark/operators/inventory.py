"""Column profiles kept up to date part by part.

Each part of a table (a month of orders, say) leaves its counts and a distinct sketch per
column. The profile of the table is merged from these rows, so an added or rewritten part is
scanned alone, and the other parts are never read again.

The sketches are theta sketches: they keep the smallest hashes of the values. Up to ``2**size_log``
distinct values they count exactly; beyond, with a relative standard error of
``relative_error(size_log)``. The merged sketch follows from the set of all values, so any
division of a table into parts, and one scan of the whole, give the same number.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelark.contract import data_columns
from tradelark.operators.audit import comparable, inventory_row

SIZE_LOG = 12
# The part of a table that is not divided.
WHOLE = "all"

SKETCHES = (
    "ordinal int, column string, data_type string, rows bigint, missing bigint, sketch binary, `table` string, part string"
)


def relative_error(size_log: int = SIZE_LOG) -> float:
    """Standard error of a distinct count beyond ``2**size_log`` values, as a share of it."""
    return 2.0 ** (-size_log / 2)


def column_sketches(table: str, frame: DataFrame, part: Column | None = None, *, size_log: int = SIZE_LOG) -> DataFrame:
    """Per part and column: rows, missing values and the sketch of the others.

    ``part`` says to which part a row belongs; null is a part as well. Only the sketches are
    shuffled, a few of them per task where its rows are of few parts. Values are compared as in
    ``audit.column_profile``. An empty table has no rows here.
    """
    columns = [(name, kind) for name, kind in frame.dtypes if name in set(data_columns(frame.columns))]

    def facts(ordinal: int, name: str, kind: str) -> Column:
        # Sketches pass over empty text, so every value gets a first letter.
        value = F.concat(F.lit("="), comparable(name, kind))
        return F.struct(
            F.lit(ordinal).alias("ordinal"),
            F.lit(name).alias("column"),
            F.lit(kind).alias("data_type"),
            F.count_if(value.isNull()).alias("missing"),
            F.theta_sketch_agg(value, size_log).alias("sketch"),
        )

    divided = frame.groupBy((F.lit(WHOLE) if part is None else part.cast("string")).alias("_part"))
    every = F.array(*[facts(at, *column) for at, column in enumerate(columns, start=1)])
    rows = divided.agg(F.count("*").alias("rows"), every.alias("facts")).select("_part", "rows", F.inline("facts"))
    return rows.select(
        "ordinal", "column", "data_type", "rows", "missing", "sketch", F.lit(table).alias("table"), F.col("_part").alias("part")
    )


def table_sketches(
    tables: Mapping[str, DataFrame], parts: Mapping[str, Column] | None = None, *, size_log: int = SIZE_LOG
) -> DataFrame:
    """The sketches of several tables; ``parts`` divides those it names."""
    parts = parts or {}
    made = [column_sketches(name, frame, parts.get(name), size_log=size_log) for name, frame in tables.items()]
    return reduce(DataFrame.unionByName, made)


def store_sketches(sketches: DataFrame, path: str) -> None:
    """Put the sketches in place of those of the same parts; all other parts stay as they are."""
    writer = sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("table", "part").parquet(path)


def stored_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SKETCHES).parquet(path)


def merged_profile(sketches: DataFrame, tables: Mapping[str, DataFrame], *, size_log: int = SIZE_LOG) -> DataFrame:
    """``audit.column_profile`` of the tables, made of their sketches alone.

    The tables give names and types and are not read. A column without sketches counts as
    empty; sketches of columns that a table has no more are passed over.
    """
    listed = [
        (table, at, name, dict(frame.dtypes)[name])
        for table, frame in tables.items()
        for at, name in enumerate(data_columns(frame.columns), start=1)
    ]
    wanted = sketches.sparkSession.createDataFrame(listed, "`table` string, ordinal int, column string, data_type string")
    merged = sketches.groupBy("table", "column").agg(
        F.sum("rows").alias("rows"),
        F.sum("missing").alias("missing"),
        F.theta_sketch_estimate(F.theta_union_agg("sketch", F.lit(size_log))).alias("unique"),
    )
    zero = F.lit(0).cast("bigint")
    seen = {name: F.coalesce(name, zero) for name in ("rows", "missing", "unique")}
    found = wanted.join(merged, ["table", "column"], "left")
    return found.select(*inventory_row(F.col("table"), F.col("ordinal"), F.col("data_type"), *seen.values()))
