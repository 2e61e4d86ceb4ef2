"""Comma separated lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def non_empty(text: Column) -> Column:
    """The text, or NULL where it is ''."""
    return F.when(text != "", text)


def sorted_distinct(column: Column) -> Column:
    """Aggregate: the distinct non-null values in ascending order, comma joined; '' if none."""
    return F.array_join(F.array_sort(F.collect_set(column)).cast("array<string>"), ",")
