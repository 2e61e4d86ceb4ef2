"""Date and time expressions."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Text formats at the edges.
DATE_FORMAT = "yyyy-MM-dd"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
DATE_HOUR_FORMAT = "yyyy-MM-dd_HH"
DATE_KEY_FORMAT = "yyyyMMdd"
MINUTE_KEY_FORMAT = "yyyyMMddHHmm"


def parse_time(text: Column | str) -> Column:
    """Text time to timestamp, NULL where it cannot be read. The cast takes one-digit hours
    too and needs no formatter."""
    return (F.col(text) if isinstance(text, str) else text).try_cast("timestamp")


def format_time(ts: Column | str) -> Column:
    return F.date_format(ts, TIME_FORMAT)


def format_date(ts: Column | str) -> Column:
    return F.date_format(ts, DATE_FORMAT)


def date_hour(ts: Column | str) -> Column:
    return F.date_format(ts, DATE_HOUR_FORMAT)


def date_key(ts: Column | str) -> Column:
    return F.date_format(ts, DATE_KEY_FORMAT)


def parse_date_key(text: Column | str) -> Column:
    return F.to_date(text, DATE_KEY_FORMAT)


def minute_key(ts: Column | str) -> Column:
    return F.date_format(ts, MINUTE_KEY_FORMAT)


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds from start to end."""
    return F.unix_timestamp(end) - F.unix_timestamp(start)


def day_before(run_date: str) -> str:
    """The day before a run date, as a bound for date-range scans."""
    return (date.fromisoformat(run_date) - timedelta(days=1)).isoformat()


def millis_of(spark: SparkSession, duration: str) -> int:
    """A duration such as ``1 hour`` in milliseconds."""
    length = F.expr(f"unix_millis(timestamp_millis(0) + INTERVAL {duration})")
    return spark.range(1).select(length).first()[0]
