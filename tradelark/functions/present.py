"""Last steps before a result leaves the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rounded(frame: DataFrame, digits: int = 2) -> DataFrame:
    """Round every fractional column for display; operators return raw values."""
    fractional = (T.DoubleType, T.FloatType, T.DecimalType)
    return frame.select(
        *[
            F.round(field.name, digits).alias(field.name) if isinstance(field.dataType, fractional) else F.col(field.name)
            for field in frame.schema
        ]
    )


def portable(frame: DataFrame, *, six_digits: tuple[str, ...] = ("average_review_score",)) -> DataFrame:
    """Only column types that every SQL engine renders alike.

    Whole numbers and flags become bigint, decimals double, dates and times text.
    Columns named in ``six_digits`` are means of fractions, which engines add up in
    different orders, and are rounded.
    """

    def plain(field: T.StructField):
        column = F.col(field.name)
        kind = field.dataType
        if field.name in six_digits:
            return F.round(column.cast("double"), 6)
        if isinstance(kind, (T.IntegralType, T.BooleanType)):
            return column.cast("bigint")
        if isinstance(kind, T.DecimalType):
            return column.cast("double")
        if isinstance(kind, (T.TimestampNTZType, T.TimestampType, T.DateType)):
            # Not date_format: it goes through the session time zone, in which a
            # wall-clock time may not exist.
            return column.cast("string")
        return column

    return frame.select(*[plain(field).alias(field.name) for field in frame.schema])
