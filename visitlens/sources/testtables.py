"""The behaviour tables, mapped from the star-schema test tables.

Each function takes (spark, folder) and returns a lazy view of one input table.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(
    spark: SparkSession, sf_dir: str, start_date: str | None = None, end_date: str | None = None
) -> DataFrame:
    """Events, with the date bounds put on ``ts`` itself so that they reach the scan."""
    events = load(spark, sf_dir, "events")
    if start_date is not None:
        events = events.where(F.expr(f"ts >= TIMESTAMP_NTZ '{start_date}'"))
    if end_date is not None:
        day_after = date.fromisoformat(end_date) + timedelta(days=1)
        events = events.where(F.expr(f"ts < TIMESTAMP_NTZ '{day_after}'"))
    return events.selectExpr("*", "int(get_json_object(props, '$.k')) AS k")


def user_visit_action(
    spark: SparkSession, sf_dir: str, start_date: str | None = None, end_date: str | None = None
) -> DataFrame:
    """Events as actions: sessions of a day, a week, half a month or a month per user.

    One user in eleven gets an id that no customer has.
    """
    timed = _events(spark, sf_dir, start_date, end_date).selectExpr(
        "event_id",
        "user_id",
        "event_type",
        "k",
        "string(date(ts)) AS day",
        "dayofmonth(ts) AS dom",
        """(user_id % 23) * 3600 + (hour(ts) * 3600 + minute(ts) * 60 + int(second(ts)))
           div CASE user_id % 4 WHEN 0 THEN 24 WHEN 1 THEN 240 WHEN 2 THEN 2400 ELSE 20000 END
           AS off""",
    )
    return timed.selectExpr(
        "day AS date",
        "if(user_id % 11 = 10, user_id + 1000000000, user_id) AS user_id",
        """concat(user_id, '-', CASE user_id % 7
             WHEN 0 THEN concat('m', left(day, 7))
             WHEN 1 THEN concat('h', left(day, 7), '.', dom div 16)
             WHEN 2 THEN concat('w', left(day, 7), '.', dom div 7)
             ELSE concat('d', day) END) AS session_id""",
        "bigint(k % 10) AS page_id",
        """concat(day, ' ', lpad(off div 3600, 2, '0'), ':', lpad(off % 3600 div 60, 2, '0'),
                  ':', lpad(off % 60, 2, '0')) AS action_time""",
        "CASE WHEN event_type = 'view' THEN concat('kw', k % 10) END AS search_keyword",
        "CASE WHEN event_type = 'click' THEN bigint(k) END AS click_category_id",
        "CASE WHEN event_type = 'click' THEN (event_id * 13 + k) % 200 END AS click_product_id",
        """CASE WHEN event_type = 'signup' THEN concat(k, ',', (k * 7 + 3) % 100) END
           AS order_category_ids""",
        """CASE WHEN event_type = 'signup'
             THEN concat(event_id % 200, ',', (event_id + 1) % 200) END AS order_product_ids""",
        "CASE WHEN event_type = 'purchase' THEN string(k) END AS pay_category_ids",
        "CASE WHEN event_type = 'purchase' THEN string(event_id % 200) END AS pay_product_ids",
        "event_id % 25 AS city_id",
    )


def user_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as users. Actions of users without a customer make the join's misses."""
    return load(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS user_id",
        "concat('user', c_custkey) AS username",
        "c_name AS name",
        "int((c_custkey * 7) % 60) AS age",
        "c_mktsegment AS professional",
        "concat('NATION_', c_nationkey) AS city",
        "CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex",
    )


def product_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").selectExpr(
        "p_partkey AS product_id",
        "p_name AS product_name",
        """concat('{"product_status": ', p_partkey % 2, '}') AS extend_info""",
    )


def city_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation")
    region = load(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).selectExpr(
        "bigint(n_nationkey) AS city_id", "n_name AS city_name", "r_name AS area"
    )


def ad_lines(
    spark: SparkSession, sf_dir: str, start_date: str | None = None, end_date: str | None = None
) -> DataFrame:
    """One ad click line per event that has a time."""
    events = _events(spark, sf_dir, start_date, end_date).where("ts IS NOT NULL")
    places = city_info(spark, sf_dir)
    return events.join(places, F.expr("event_id % 25 = city_id")).selectExpr(
        """concat_ws(' ', unix_millis(timestamp(ts)), replace(area, ' ', '_'), city_name,
                     coalesce(string(user_id), '-'), coalesce(string(k % 10), '-')) AS value"""
    )


def ad_lines_some_broken(
    spark: SparkSession, sf_dir: str, start_date: str | None = None, end_date: str | None = None
) -> DataFrame:
    """The ad click lines, one in eight of them broken in one of five ways."""
    events = _events(spark, sf_dir, start_date, end_date).where("ts IS NOT NULL")
    places = city_info(spark, sf_dir)
    return events.join(places, F.expr("event_id % 25 = city_id")).selectExpr(
        """CASE event_id % 40
             WHEN 0 THEN ''
             WHEN 1 THEN '   '
             WHEN 2 THEN concat_ws(' ', 'soon', replace(area, ' ', '_'), city_name)
             WHEN 3 THEN concat_ws(' ', '9223372036854775807', city_name)
             WHEN 4 THEN concat_ws(' ', '-9223372036854775807', city_name)
             ELSE concat_ws(' ', unix_millis(timestamp(ts)), replace(area, ' ', '_'), city_name,
                            coalesce(string(user_id), '-'), coalesce(string(k % 10), '-'))
           END AS value"""
    )


def task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task per customer, its JSON built from the customer's columns.

    Which keys are present varies with the key; some arrays are empty, some have a second
    element that must be ignored.
    """
    params = """
        concat('{', concat_ws(',',
          CASE WHEN c_custkey % 2 = 0 THEN '"startDate":["2024-01-05"]' END,
          CASE WHEN c_custkey % 4 = 0 THEN '"endDate":["2024-01-25"]' END,
          CASE WHEN c_custkey % 3 = 0 THEN concat('"startAge":["', c_custkey % 40, '"]') END,
          CASE WHEN c_custkey % 3 <> 1
               THEN concat('"endAge":["', c_custkey % 40 + 20, '","99"]') END,
          CASE WHEN c_custkey % 5 < 3
               THEN concat('"professionals":["', c_mktsegment, ',OTHER"]') END,
          CASE WHEN c_custkey % 5 = 3 THEN '"professionals":[]' END,
          CASE WHEN c_custkey % 7 = 0 THEN concat('"cities":["NATION_', c_nationkey, '"]') END,
          CASE WHEN c_custkey % 6 = 0 THEN '"sex":["male","female"]' END,
          CASE WHEN c_custkey % 6 = 1 THEN '"sex":[""]' END,
          CASE WHEN c_custkey % 8 = 0 THEN concat('"keywords":["kw', c_custkey % 10, '"]') END,
          CASE WHEN c_custkey % 9 = 0
               THEN concat('"categoryIds":["', c_custkey % 100, ',7"]') END,
          concat('"targetPageFlow":["', c_custkey % 10, ',2,3"]')), '}') AS task_param"""
    return load(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS task_id",
        "concat('task', c_custkey) AS task_name",
        "'2024-01-31 00:00:00' AS create_time",
        "string(NULL) AS start_time",
        "string(NULL) AS finish_time",
        "'session' AS task_type",
        "'created' AS task_status",
        params,
    )
