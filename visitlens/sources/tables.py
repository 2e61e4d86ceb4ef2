"""Scans of the behaviour tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def actions_in_dates(
    actions: DataFrame, start_date: str | None = None, end_date: str | None = None
) -> DataFrame:
    """Actions with start_date <= date <= end_date; a missing bound is open.

    The bounds are literals on the ``date`` column, so a table partitioned by ``date``
    reads only the partitions in the range.
    """
    if start_date is not None:
        actions = actions.where(F.col("date") >= start_date)
    if end_date is not None:
        actions = actions.where(F.col("date") <= end_date)
    return actions


def product_status(products: DataFrame) -> DataFrame:
    """Products with the status taken out of their JSON attribute column."""
    return products.select(
        "product_id",
        "product_name",
        F.get_json_object("extend_info", "$.product_status").alias("product_status"),
    )
