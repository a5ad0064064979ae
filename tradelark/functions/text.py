"""Text normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the four ASCII separator controls.
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(column: str | Column) -> Column:
    """Remove white space of any kind from both ends; Spark's trim removes blanks only."""
    return F.regexp_replace(column, _EDGE_SPACE, "")


def strip_lower(column: str | Column) -> Column:
    return F.lower(strip(column))


def strip_upper(column: str | Column) -> Column:
    return F.upper(strip(column))
