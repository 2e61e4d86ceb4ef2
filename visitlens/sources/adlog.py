"""Ad click lines, from Kafka or files, and their reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def kafka_ad_lines(spark: SparkSession, brokers: str, topics: str, **options: str) -> DataFrame:
    """Stream of lines from Kafka topics. Needs the Kafka connector on the class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("subscribe", topics)
        .options(**options)
    )
    return reader.load().select(F.col("value").cast("string").alias("value"))


def file_ad_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Stream of lines from text files that arrive under a folder."""
    return spark.readStream.options(**options).text(path)


# The largest time that microseconds in 64 bits can hold.
LAST_MILLI = (2**63 - 1) // 1000
EMPTY, NO_NUMBER, OUT_OF_RANGE = "empty line", "time is no number", "time out of range"
REASONS = (EMPTY, NO_NUMBER, OUT_OF_RANGE)
CLICK_COLUMNS = ("click_time", "province", "city", "user_id", "ad_id")
REJECT_COLUMNS = ("value", "reason")


def read_ad_lines(lines: DataFrame) -> DataFrame:
    """``timestamp_ms province city userId adId`` to typed columns; every line gives one row.

    Casts are ``try_cast``: a broken line does not stop a job. A line without a readable time
    is no click: it has a ``reason``, its text in ``value``, and NULL elsewhere. Of a click,
    ``value`` and ``reason`` are NULL, and so are fields that cannot be read.
    """
    part = F.split("value", " ")

    def field(i: int) -> Column:
        return F.get(part, F.lit(i))

    milli = field(0).try_cast("bigint")
    in_range = milli.between(-LAST_MILLI, LAST_MILLI)
    reason = (
        F.when(F.col("value").isNull() | (F.trim("value") == ""), EMPTY)
        .when(milli.isNull(), NO_NUMBER)
        .when(~in_range, OUT_OF_RANGE)
    )
    clicked = reason.isNull()
    return lines.select(
        F.timestamp_millis(F.when(clicked, milli)).alias("click_time"),
        F.when(clicked, field(1)).alias("province"),
        F.when(clicked, field(2)).alias("city"),
        F.when(clicked, field(3).try_cast("bigint")).alias("user_id"),
        F.when(clicked, field(4).try_cast("bigint")).alias("ad_id"),
        F.when(~clicked, F.col("value")).alias("value"),
        reason.alias("reason"),
    )


def clicks_of(read: DataFrame) -> DataFrame:
    """The clicks among read lines."""
    return read.where(F.col("click_time").isNotNull()).select(*CLICK_COLUMNS)


def parse_ad_lines(lines: DataFrame) -> DataFrame:
    """The clicks of ad lines; lines without a readable time are left out."""
    return clicks_of(read_ad_lines(lines))


def rejected_ad_lines(lines: DataFrame) -> DataFrame:
    """``value, reason`` of the lines that are no clicks."""
    return read_ad_lines(lines).where(F.col("reason").isNotNull()).select(*REJECT_COLUMNS)


def rejected_counts(read: DataFrame) -> DataFrame:
    """``value, reason, line_count`` of read lines that are no clicks: how often each came."""
    rejected = read.where(F.col("reason").isNotNull())
    return rejected.groupBy(*REJECT_COLUMNS).agg(F.count("*").alias("line_count"))


def counted(rows: DataFrame, outcome: Column, outcomes: tuple[str, ...]) -> tuple[DataFrame, Observation]:
    """The same rows, and an observation that counts them by outcome while they are written.

    Only the rows of tasks that write are counted, once each, where no shuffle comes between
    the observed rows and their writer.
    """
    observation = Observation()
    counts = [F.count_if(outcome == name).alias(name) for name in outcomes]
    return rows.observe(observation, *counts), observation
