"""The bundle of input tables every job starts from."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame

from tradelark.contract import TABLES

Source = DataFrame | Callable[[], DataFrame]


class Market:
    """The contract tables by name, as attributes.

    A table is given as a DataFrame or as a function that makes one; the function
    runs when the table is first used, so a report only ever opens what it reads.
    """

    def __init__(self, **tables: Source):
        unknown = sorted(set(tables) - set(TABLES))
        if unknown:
            raise ValueError(f"not contract tables: {unknown}")
        self._sources = {
            name: cache(source) if not isinstance(source, DataFrame) else source
            for name, source in tables.items()
        }

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        if name not in self._sources:
            raise AttributeError(f"table not given: {name}")
        source = self._sources[name]
        return source if isinstance(source, DataFrame) else source()

    def missing(self) -> list[str]:
        return [name for name in TABLES if name not in self._sources]

    def tables(self) -> dict[str, DataFrame]:
        """The tables that are given, in contract order."""
        return {name: getattr(self, name) for name in TABLES if name in self._sources}

    def having(self, **changed: Source) -> Market:
        return Market(**{**self._sources, **changed})
