"""Sessions: aggregate actions, add user attributes, filter by task parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.functions.lists import non_empty, sorted_distinct
from visitlens.functions.predicates import any_of, between_bounds, equal_to, keep_where_all
from visitlens.functions.times import parse_time, seconds_between
from visitlens.params import SessionTask
from visitlens.sources.tables import actions_in_dates

KEYWORD_HIT = "has_wanted_keyword"
CATEGORY_HIT = "has_wanted_category"


def aggregate_sessions(
    actions: DataFrame, task: SessionTask = SessionTask(), lists: bool = True
) -> DataFrame:
    """One row per session. Actions without a session id belong to no session.

    With ``lists`` the distinct keywords and categories are shown. Actions are then counted
    by session, keyword and category first, in a plain hash aggregation that also spreads a
    hot session, and the lists are built from the distinct values. Without them, one
    aggregation of fixed-width values and one shuffle do.

    When the task asks for keywords or categories, whether a session has one of them is
    computed as a flag.
    """
    acted = actions.where(F.col("session_id").isNotNull()).select(
        "session_id",
        "user_id",
        non_empty(F.col("search_keyword")).alias("search_keyword"),
        "click_category_id",
        parse_time("action_time").alias("start_time"),
    )
    rows = acted.withColumn("end_time", F.col("start_time")).withColumn("step_length", F.lit(1).cast("bigint"))
    totals = [
        F.min("user_id").alias("user_id"),
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.sum("step_length").alias("step_length"),
    ]
    shown = []
    if lists:
        rows = rows.groupBy("session_id", "search_keyword", "click_category_id").agg(*totals)
        shown = [
            sorted_distinct(F.col("search_keyword")).alias("search_keywords"),
            sorted_distinct(F.col("click_category_id")).alias("click_category_ids"),
        ]
    flags = []
    wanted_keyword = any_of(F.col("search_keyword"), task.keywords)
    if wanted_keyword is not None:
        flags.append(F.coalesce(F.bool_or(wanted_keyword), F.lit(False)).alias(KEYWORD_HIT))
    wanted_category = any_of(F.col("click_category_id"), task.category_ids)
    if wanted_category is not None:
        flags.append(F.coalesce(F.bool_or(wanted_category), F.lit(False)).alias(CATEGORY_HIT))
    sessions = rows.groupBy("session_id").agg(totals[0], *shown, *totals[1:], *flags)
    visit_length = seconds_between(F.col("start_time"), F.col("end_time"))
    return sessions.withColumn("visit_length", visit_length).drop("end_time")


def with_users(sessions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions with the attributes of their user; sessions of unknown users drop out.

    No join hint: Spark broadcasts the users only when their measured size allows it, and
    otherwise splits the sessions of a hot user at run time.
    """
    attributes = users.select("user_id", "age", "professional", "city", "sex")
    return sessions.join(attributes, "user_id")


def filter_sessions(sessions: DataFrame, task: SessionTask) -> DataFrame:
    """Sessions that pass every filter the task sets.

    The user filters are on user columns, so they move below the join into the user scan.
    """
    return keep_where_all(
        sessions,
        [
            between_bounds(F.col("age"), task.start_age, task.end_age),
            any_of(F.col("professional"), task.professionals),
            any_of(F.col("sex"), task.sex),
            any_of(F.col("city"), task.cities),
            F.col(KEYWORD_HIT) if task.keywords else None,
            F.col(CATEGORY_HIT) if task.category_ids else None,
        ],
    ).drop(KEYWORD_HIT, CATEGORY_HIT)


def filtered_sessions(
    actions: DataFrame, users: DataFrame, task: SessionTask, lists: bool = True
) -> DataFrame:
    """Actions in the task's dates, to sessions, to sessions that pass its filters. Reports
    that do not show the lists leave them out."""
    in_range = actions_in_dates(actions, task.start_date, task.end_date)
    return filter_sessions(with_users(aggregate_sessions(in_range, task, lists), users), task)


def sessions_equal(sessions: DataFrame, **values: object) -> DataFrame:
    """Sessions whose columns equal the given values; a value of None does not restrict."""
    return keep_where_all(sessions, [equal_to(F.col(c), v) for c, v in values.items()])


def session_actions(actions: DataFrame, sessions: DataFrame) -> DataFrame:
    """The actions of the given sessions, action columns only.

    A session id is unique among sessions, so a semi join gives what an inner join would.
    Spark splits the actions of a hot session at run time, but only where both sides are
    shuffled for this very join. Sessions often come already partitioned by their id; the
    computed id below hides that, at the price of shuffling one column of them.
    """
    wanted = sessions.select(F.concat("session_id", F.lit("")).alias("session_id"))
    return actions.join(wanted, "session_id", "left_semi")


def session_action_count(sessions: DataFrame) -> DataFrame:
    """How many actions the sessions have: the sum of their steps, with no join."""
    return sessions.agg(F.coalesce(F.sum("step_length"), F.lit(0)).alias("detail_count"))


def session_detail(actions: DataFrame, sessions: DataFrame, task_id: int | None) -> DataFrame:
    """Actions of the given sessions in the columns of the ``session_detail`` table."""
    return session_actions(actions, sessions).select(
        F.lit(task_id).cast("bigint").alias("taskid"),
        F.col("user_id").alias("userid"),
        F.col("session_id").alias("sessionid"),
        F.col("page_id").alias("pageid"),
        F.col("action_time").alias("actionTime"),
        F.col("search_keyword").alias("searchKeyword"),
        F.col("click_category_id").alias("clickCategoryId"),
        F.col("click_product_id").alias("clickProductId"),
        F.col("order_category_ids").alias("orderCategoryIds"),
        F.col("order_product_ids").alias("orderProductIds"),
        F.col("pay_category_ids").alias("payCategoryIds"),
        F.col("pay_product_ids").alias("payProductIds"),
    )
