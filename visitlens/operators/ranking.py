"""The first n rows of each group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column],
    n: int,
    row_key: Sequence[str],
    rank: str = "row_rank",
    salts: int = 64,
) -> DataFrame:
    """Rows 1..n of each group in ``order``, numbered in column ``rank``.

    ``order`` must be total inside a group. ``row_key`` names columns that identify a row
    in its group; they spread a group over ``salts``, whose first n rows each contain the
    first n rows of the whole group.
    """

    def cut(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)

    salted = df.withColumn("salt", F.pmod(F.xxhash64(*row_key), F.lit(salts)))
    return cut(cut(salted, [*groups, "salt"]).drop("salt", rank), groups)
