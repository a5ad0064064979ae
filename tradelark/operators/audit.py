"""Profiles of the tables and checks of the relationships between them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelark.contract import CONTRACT, Field, data_columns
from tradelark.functions.numbers import mean_of_whole
from tradelark.market import Market
from tradelark.plans.staging import staged

# (child table, foreign key, parent table, parent key)
RELATIONS = (
    ("orders", "customer_id", "customers", "customer_id"),
    ("order_items", "order_id", "orders", "order_id"),
    ("order_items", "product_id", "products", "product_id"),
    ("order_items", "seller_id", "sellers", "seller_id"),
    ("payments", "order_id", "orders", "order_id"),
    ("reviews", "order_id", "orders", "order_id"),
)

# Columns expected to identify the rows of their table.
SINGLE_KEYS = (
    ("customers", "customer_id"),
    ("orders", "order_id"),
    ("products", "product_id"),
    ("sellers", "seller_id"),
    ("category_translation", "product_category_name"),
)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def contract_check(market: Market) -> DataFrame:
    """Per contract column: is it present, is its type accepted, nulls if it is a key.

    Raises one error naming every absent table before anything runs.
    """
    absent = market.missing()
    if absent:
        raise ValueError(f"tables missing: {absent}")
    return _union([_check_table(table, frame) for table, frame in market.tables().items()])


def _check_table(table: str, frame: DataFrame) -> DataFrame:
    types = dict(frame.dtypes)

    def verdict(field: Field) -> Column:
        found = types.get(field.name)
        nulls = F.count_if(F.col(field.name).isNull()) if field.key and found else F.lit(None)
        return F.struct(
            F.lit(field.name).alias("column"),
            F.lit(found is not None).alias("present"),
            F.lit(found in field.types).alias("type_accepted"),
            nulls.cast("bigint").alias("key_nulls"),
        )

    verdicts = frame.agg(F.array(*[verdict(field) for field in CONTRACT[table]]).alias("verdicts"))
    return verdicts.select(F.lit(table).alias("table"), F.inline("verdicts"))


def _null_bits(names: Sequence[str]) -> list[Column]:
    """Which of the columns are null, as bits of one number per 60 columns."""
    groups = [names[at : at + 60] for at in range(0, len(names), 60)]
    return [
        reduce(Column.bitwiseOR, [F.shiftleft(F.col(name).isNull().cast("bigint"), at) for at, name in enumerate(group)])
        for group in groups
    ]


def row_fingerprint(names: Sequence[str]) -> list[Column]:
    """128 bits of a row. Equal rows have equal ones; that others have not is likely, not certain."""
    # A hash passes over nulls, so where they stand is hashed as well.
    nulls = _null_bits(names)
    return [F.xxhash64(F.lit(seed), *nulls, *names) for seed in (1, 2)]


def table_profile(market: Market, *, fingerprint: Callable[[Sequence[str]], list[Column]] = row_fingerprint) -> DataFrame:
    """Rows, columns, repeated rows and missing values per table, largest table first.

    One job counts the fingerprints of all tables: what is shuffled is 16 bytes a row, combined
    before. Only tables with repeated fingerprints are read again, and only their rows with
    one of these are compared in full, so the counts are exact whatever collides.
    """
    tables = [(name, frame, data_columns(frame.columns)) for name, frame in market.tables().items()]
    counted = staged(_fingerprints([(frame, names) for _, frame, names in tables], fingerprint), "fingerprints")
    repeated = counted.where(F.col("first").isNotNull())
    suspects = [row["number"] for row in repeated.select("number").distinct().collect()]  # at most the tables

    zero = F.lit(0).cast("bigint")
    entries = [
        F.struct(F.lit(at).alias("number"), F.lit(name).alias("table"), F.lit(len(names)).alias("columns"))
        for at, (name, _, names) in enumerate(tables)
    ]
    found = counted.sparkSession.range(1).select(F.inline(F.array(*entries)))
    sums = counted.groupBy("number").agg(F.sum("n").alias("rows"), F.sum("nulls").alias("missing_values"))
    found = found.join(sums, "number", "left")
    if suspects:
        copies = [_copies(at, tables[at][1], tables[at][2], repeated, fingerprint) for at in sorted(suspects)]
        found = found.join(_union(copies), "number", "left")
    else:
        found = found.withColumn("duplicate_rows", zero)
    filled = [F.coalesce(name, zero).alias(name) for name in ("rows", "duplicate_rows", "missing_values")]
    return found.select("table", filled[0], "columns", *filled[1:]).orderBy(F.desc("rows"), "table")


def _fingerprints(
    tables: Sequence[tuple[DataFrame, list[str]]], fingerprint: Callable[[Sequence[str]], list[Column]]
) -> DataFrame:
    """number, first, second, n, nulls: a row per repeated fingerprint and one (without) for all others of a table."""

    def prints(number: int, frame: DataFrame, names: list[str]) -> DataFrame:
        nulls = reduce(Column.__add__, [F.bit_count(bits) for bits in _null_bits(names)])
        first, second = fingerprint(names)
        return frame.select(F.lit(number).alias("number"), first.alias("first"), second.alias("second"), nulls.cast("bigint").alias("nulls"))

    rows = _union([prints(number, *table) for number, table in enumerate(tables)])
    counts = rows.groupBy("number", "first", "second").agg(F.count("*").alias("n"), F.sum("nulls").alias("nulls"))
    known = [F.when(F.col("n") > 1, F.col(half)).alias(half) for half in ("first", "second")]
    return counts.groupBy("number", *known).agg(F.sum("n").alias("n"), F.sum("nulls").alias("nulls"))


def _copies(
    number: int, frame: DataFrame, names: list[str], repeated: DataFrame, fingerprint: Callable[[Sequence[str]], list[Column]]
) -> DataFrame:
    """number, duplicate_rows: rows beyond the first of each, among those with a repeated fingerprint."""
    first, second = fingerprint(names)
    marked = frame.select(*names, first.alias("_first"), second.alias("_second"))
    wanted = repeated.where(F.col("number") == number).select(F.col("first").alias("_first"), F.col("second").alias("_second"))
    same = marked.join(wanted, ["_first", "_second"], "left_semi").groupBy(*names).agg(F.count("*").alias("_copies"))
    return same.agg(F.sum(F.col("_copies") - 1).alias("duplicate_rows")).select(F.lit(number).alias("number"), "duplicate_rows")


def column_profile(market: Market, *, approx: bool = False) -> DataFrame:
    """Type, missing values and distinct non-null values of every column.

    ``approx`` counts distinct values with a sketch: one scan and no shuffle of
    values, for tables where the exact count is not worth its cost.
    """
    summarise = _sketched_columns if approx else _counted_columns
    tables = market.tables().items()
    return _union([summarise(table, frame.select(*data_columns(frame.columns))) for table, frame in tables])


def inventory_row(table: Column, ordinal: Column, data_type: Column, rows: Column, missing: Column, unique: Column) -> list[Column]:
    return [
        table.alias("table"),
        F.col("column"),
        ordinal.alias("ordinal"),
        data_type.alias("data_type"),
        missing.alias("missing_values"),
        F.round(F.try_divide(missing.cast("double"), rows.cast("double")) * 100, 2).alias("missing_percent"),
        unique.alias("unique_values"),
    ]


def _counted_columns(table: str, frame: DataFrame) -> DataFrame:
    # One (column, value) row per cell, combined before the shuffle. A COUNT
    # DISTINCT per column would send every row once per column, at full width.
    names = frame.columns
    cells = frame.select(*[comparable(name, kind) for name, kind in frame.dtypes]).unpivot([], names, "column", "value")
    values = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
    seen = values.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"),
        F.count("value").alias("unique"),
    )
    listed = frame.sparkSession.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(at).alias("ordinal"), F.lit(name).alias("column"), F.lit(kind).alias("data_type"))
                    for at, (name, kind) in enumerate(frame.dtypes, start=1)
                ]
            )
        )
    )
    zero = F.lit(0).cast("bigint")
    return listed.join(seen, "column", "left").select(
        *inventory_row(
            F.lit(table),
            F.col("ordinal"),
            F.col("data_type"),
            F.coalesce("rows", zero),
            F.coalesce("missing", zero),
            F.coalesce("unique", zero),
        )
    )


def comparable(name: str, kind: str) -> Column:
    """A value as text. Both signs of zero are one value, and not-a-number is missing."""
    column = F.col(name)
    if kind in ("double", "float"):
        column = F.when(~F.isnan(name), column + F.lit(0.0))
    return column.cast("string").alias(name)


def _sketched_columns(table: str, frame: DataFrame) -> DataFrame:
    facts = frame.agg(
        F.count("*").alias("rows"),
        F.array(
            *[
                F.struct(
                    F.lit(at).alias("ordinal"),
                    F.lit(name).alias("column"),
                    F.lit(kind).alias("data_type"),
                    F.count_if(comparable(name, kind).isNull()).alias("missing"),
                    F.approx_count_distinct(comparable(name, kind)).alias("unique"),
                )
                for at, (name, kind) in enumerate(frame.dtypes, start=1)
            ]
        ).alias("facts"),
    ).select("rows", F.inline("facts"))
    return facts.select(
        *inventory_row(
            F.lit(table), F.col("ordinal"), F.col("data_type"), F.col("rows"), F.col("missing"), F.col("unique")
        )
    )


def key_check(frame: DataFrame, column: str, table: str) -> DataFrame:
    """Does a column behave like a key: rows, distinct, missing and repeated values.

    Nulls equal each other here, so the second null is a repeated value.
    """
    values = frame.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return values.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count("value").alias("unique_values"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing_values"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_values"),
    ).select(F.lit(table).alias("table"), F.lit(column).alias("column"), "*")


def key_checks(market: Market) -> DataFrame:
    return _union([key_check(getattr(market, table), column, table) for table, column in SINGLE_KEYS])


def identity_summary(customers: DataFrame) -> DataFrame:
    """How accounts map to buyers."""
    per_buyer = customers.groupBy("customer_unique_id").agg(F.count("*").alias("n"))
    buyers = per_buyer.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("customer_rows"),
        F.count("customer_unique_id").alias("distinct_buyers"),
        F.count_if(F.col("customer_unique_id").isNotNull() & (F.col("n") > 1)).alias("buyers_with_several_rows"),
    )
    accounts = customers.agg(F.countDistinct("customer_id"))
    return buyers.select(
        "customer_rows", accounts.scalar().alias("distinct_accounts"), "distinct_buyers", "buyers_with_several_rows"
    )


def top_identities(customers: DataFrame, n: int = 10) -> DataFrame:
    """The buyers with the most rows."""
    return (
        customers.where(F.col("customer_unique_id").isNotNull())
        .groupBy("customer_unique_id")
        .agg(F.count("*").alias("customer_rows"))
        .orderBy(F.desc("customer_rows"), "customer_unique_id")
        .limit(n)
    )


def child_cardinality(child: DataFrame, foreign_key: str, table: str) -> DataFrame:
    """Parents seen in a child table, and most and mean children per parent."""
    children = child.where(F.col(foreign_key).isNotNull()).groupBy(foreign_key).agg(F.count("*").alias("n"))
    return children.agg(
        F.count("*").alias("parents"),
        F.max("n").alias("most_children"),
        mean_of_whole(F.col("n")).alias("mean_children"),
    ).select(F.lit(table).alias("table"), "*")


def child_cardinalities(market: Market) -> DataFrame:
    return _union([child_cardinality(getattr(market, t), "order_id", t) for t in ("order_items", "payments")])


def orphans(child: DataFrame, foreign_key: str, parent: DataFrame, key: str, relation: str) -> DataFrame:
    """Child rows without a parent. A null key matches a null parent key and nothing else."""
    # Counting per key first keeps a frequent (or null) key from filling one join task.
    references = child.groupBy(F.col(foreign_key).alias("reference")).agg(F.count("*").alias("n"))
    parents = parent.select(F.col(key).alias("known"))
    unmatched = references.join(parents, F.col("reference").eqNullSafe(F.col("known")), "left_anti")
    return unmatched.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows")).select(
        F.lit(relation).alias("relation"), "orphan_rows"
    )


def foreign_key_orphans(market: Market) -> DataFrame:
    return _union(
        [
            orphans(getattr(market, child), fk, getattr(market, parent), key, f"{child}.{fk}")
            for child, fk, parent, key in RELATIONS
        ]
    )


def status_distribution(orders: DataFrame) -> DataFrame:
    return (
        orders.where(F.col("order_status").isNotNull())
        .groupBy("order_status")
        .agg(F.count("*").alias("orders"))
        .orderBy(F.desc("orders"), "order_status")
    )
