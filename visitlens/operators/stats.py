"""Counts and ratios over sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions.ratios import ratio_half_up
from visitlens.functions.times import date_hour

# Fixed values: (name, first value, first value beyond; None = open). Whole seconds.
VISIT_LENGTHS = (
    ("1s_3s", 1, 4),
    ("4s_6s", 4, 7),
    ("7s_9s", 7, 10),
    ("10s_30s", 10, 30),
    ("30s_60s", 30, 60),
    ("1m_3m", 60, 180),
    ("3m_10m", 180, 600),
    ("10m_30m", 600, 1800),
    ("30m", 1800, None),
)
# The same for the number of actions.
STEP_LENGTHS = (
    ("1_3", 1, 4),
    ("4_6", 4, 7),
    ("7_9", 7, 10),
    ("10_30", 10, 30),
    ("30_60", 30, 60),
    ("60", 60, None),
)
_MEASURES = (("visit_length", VISIT_LENGTHS), ("step_length", STEP_LENGTHS))


def _bucket_names() -> list[str]:
    return [f"{measure}_{name}" for measure, buckets in _MEASURES for name, _, _ in buckets]


def _count_between(measure: str, low: int, beyond: int | None) -> Column:
    below = "" if beyond is None else f" AND {measure} < {beyond}"
    return F.expr(f"count_if({measure} >= {low}{below})")


def session_counters(sessions: DataFrame) -> DataFrame:
    """One row: the session count and 15 bucket counts. A visit of 0 s is in no bucket."""
    buckets = [
        _count_between(measure, low, beyond).alias(f"{measure}_{name}")
        for measure, table in _MEASURES
        for name, low, beyond in table
    ]
    return sessions.agg(F.count("*").alias("session_count"), *buckets)


def session_aggr_stat(sessions: DataFrame, task_id: int | None) -> DataFrame:
    """One row: the session count and each bucket's share of it (NULL if no session)."""
    return session_counters(sessions).select(
        F.lit(task_id).cast("bigint").alias("taskid"),
        "session_count",
        *[ratio_half_up(name, "session_count").alias(f"{name}_ratio") for name in _bucket_names()],
    )


def sessions_per_hour(sessions: DataFrame) -> DataFrame:
    """Sessions that start in each hour of each day."""
    return sessions.groupBy(date_hour("start_time").alias("date_hour")).agg(
        F.count("*").alias("session_count")
    )
