"""Tables in a database, read over Spark's JDBC source."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession


def partition_options(column: str, lower: int, upper: int, partitions: int) -> dict[str, str]:
    """Options that split a table read into ranges of a numeric column, one query per task."""
    if partitions < 1 or lower >= upper:
        raise ValueError("need lower < upper and at least one partition")
    return {
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    options: Mapping[str, str] | None = None,
    split: Mapping[str, str] | None = None,
) -> DataFrame:
    """A table. Filters and columns are pushed down; pass ``split`` for a large one."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table)
    return reader.options(**dict(options or {}), **dict(split or {})).load()


def read_query(
    spark: SparkSession, url: str, query: str, options: Mapping[str, str] | None = None
) -> DataFrame:
    """The result of a query that the database runs, read by one task: for small results."""
    reader = spark.read.format("jdbc").options(url=url, query=query)
    return reader.options(**dict(options or {})).load()
