"""Reading and writing the tables as files.

CSV is where raw data comes from; between steps and for results the format is
Parquet, which keeps types, and CSV is there for whoever needs it.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelark.contract import CONTRACT, POSITION, TIME, WHOLE
from tradelark.market import Market

# Spellings of a missing value in CSV text.
MISSING_SPELLINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Free text may hold line breaks inside quotes. Only these tables pay for it:
# a file read that way cannot be split between tasks.
MULTILINE_TABLES = ("reviews",)


def _typed(name: str, types: tuple[str, ...]) -> Column:
    column = F.col(name)
    if types == WHOLE:
        # "3.0" is a whole number too.
        return column.try_cast("decimal(38,6)").cast("bigint").alias(name)
    # Times stay text here; the cleaning step parses them and nulls the bad ones.
    return column if types == TIME or "string" in types else column.try_cast(types[0]).alias(name)


def read_csv_table(spark: SparkSession, table: str, path: str, *, multiline: bool | None = None) -> DataFrame:
    """One contract table from CSV with a header line.

    Types come from the contract, never from a look at the data, so codes such as
    zip prefixes keep their leading zeros. Columns outside the contract stay text.
    """
    known, fields = _raw(spark, table, path, multiline)
    return known.select(
        *[_typed(name, fields[name]) if name in fields else F.col(name) for name in known.columns]
    )


def _raw(
    spark: SparkSession, table: str, path: str, multiline: bool | None
) -> tuple[DataFrame, dict[str, tuple[str, ...]]]:
    """The table as text with missing spellings as nulls, and the types of its contract columns.

    Files of a folder must agree on their header: a file with another order of columns is an
    error when it is read, never a mix-up of values.
    """
    multiline = table in MULTILINE_TABLES if multiline is None else multiline
    raw = spark.read.csv(path, header=True, multiLine=multiline, quote='"', escape='"')
    fields = {field.name: field.types for field in CONTRACT[table]}
    absent = [name for name in fields if name not in raw.columns]
    if absent:
        raise ValueError(f"{table}: columns missing from {path}: {absent}")
    # A stated schema makes Spark compare it with the header of every file it reads.
    checked = spark.read.schema(raw.schema).csv(path, header=True, multiLine=multiline, quote='"', escape='"', enforceSchema=False)
    known = checked.select(
        *[F.when(~F.col(name).isin(*MISSING_SPELLINGS), F.col(name)).alias(name) for name in raw.columns],
        *([_file_position()] if table == "geolocation" else []),
    )
    return known, fields


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(files.globStatus(found))


def rejected_values(spark: SparkSession, table: str, path: str, *, multiline: bool | None = None) -> DataFrame:
    """column, rejected: values per typed column that are neither missing nor of its type.

    Reading turns them into nulls; this is where they show. One row per typed column.
    """
    raw, kinds = _raw(spark, table, path, multiline)
    checked = [name for name in kinds if kinds[name] != TIME and "string" not in kinds[name]]
    rejected = [F.count_if(F.col(name).isNotNull() & _typed(name, kinds[name]).isNull()).alias(name) for name in checked]
    if not checked:
        return spark.createDataFrame([], "column string, rejected bigint")
    return raw.agg(*rejected).unpivot([], checked, "column", "rejected")


def _file_position() -> Column:
    """Where a row stands in its source: file, then block, then order within the block."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    ).alias(POSITION)


def read_csv_market(spark: SparkSession, paths: Mapping[str, str]) -> Market:
    """The tables from CSV files, given as table name -> path.

    Raises one error that names every table without a path, or whose path holds no file.
    """
    absent = [table for table in CONTRACT if table not in paths or not _exists(spark, paths[table])]
    if absent:
        raise ValueError(f"no input given for: {absent}")
    return Market(**{table: partial(read_csv_table, spark, table, paths[table]) for table in CONTRACT})


def read_parquet_market(spark: SparkSession, folder: str) -> Market:
    return Market(**{table: partial(spark.read.parquet, f"{folder}/{table}") for table in CONTRACT})


def write_table(frame: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Write a result. CSV has a header line and no index column."""
    writer = frame.write.mode("overwrite")
    if file_format == "csv":
        writer.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    else:
        writer.format(file_format).save(path)
