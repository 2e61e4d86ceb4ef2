"""Predicates that exist only when their parameter was given.

Each builder returns ``None`` for a missing parameter, so that it leaves no trace in the
plan. A row whose own value is NULL never passes a predicate that exists.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def between_bounds(column: Column, low: int | None, high: int | None) -> Column | None:
    """Inclusive range; needs both bounds, otherwise there is no restriction."""
    if low is None or high is None:
        return None
    return column.between(low, high)


def any_of(column: Column, values: Iterable) -> Column | None:
    """The value is one of ``values``."""
    values = list(values)
    return column.isin(values) if values else None


def equal_to(column: Column, value: object | None) -> Column | None:
    return None if value is None else column == F.lit(value)


def keep_where_all(df: DataFrame, predicates: Iterable[Column | None]) -> DataFrame:
    """Rows that pass every predicate that exists."""
    given = [p for p in predicates if p is not None]
    return df.where(reduce(and_, given)) if given else df
