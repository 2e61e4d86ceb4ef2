"""Most clicked products per area."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.operators.ranking import first_per_group
from visitlens.sources.tables import product_status


def _area_level(levels: Mapping[str, str], other: str) -> Column:
    level = F.lit(other)
    for area, name in levels.items():
        level = F.when(F.col("area") == area, name).otherwise(level)
    return level


def area_top3_product(
    actions: DataFrame,
    cities: DataFrame,
    products: DataFrame,
    levels: Mapping[str, str],
    other_level: str,
    task_id: int | None,
) -> DataFrame:
    """The three most clicked products of each area, ties by product id.

    Clicks are counted per (city, product) before any join, so that neither a hot city nor
    a hot product reaches one as raw rows. The city list of a group holds each of the
    area's cities once.
    """
    clicks = (
        actions.where(F.col("click_product_id").isNotNull())
        .groupBy("city_id", F.col("click_product_id").alias("product_id"))
        .agg(F.count("*").alias("clicks"))
    )
    place = F.struct("city_id", "city_name")
    by_area = (
        clicks.join(cities, "city_id")
        .groupBy("area", "product_id")
        .agg(
            F.sum("clicks").alias("clicks"),
            F.array_sort(F.collect_set(place)).alias("places"),
        )
    )
    known = by_area.join(product_status(products), "product_id")
    top = first_per_group(
        known,
        groups=["area"],
        order=[F.desc("clicks"), F.col("product_id")],
        n=3,
        row_key=["product_id"],
    )
    place_text = F.transform("places", lambda p: F.concat_ws(":", p["city_id"], p["city_name"]))
    return top.select(
        F.lit(task_id).cast("bigint").alias("taskid"),
        "area",
        _area_level(levels, other_level).alias("areaLevel"),
        F.col("product_id").alias("productid"),
        F.array_join(place_text, ",").alias("cityInfos"),
        F.col("clicks").alias("clickCount"),
        F.col("product_name").alias("productName"),
        F.col("product_status").alias("productStatus"),
    )
