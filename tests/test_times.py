from pyspark.sql import functions as F

from visitlens.functions import times


def test_time_keys_and_their_parsing(spark):
    df = spark.createDataFrame([("2024-03-09 5:07:08",)], "t string")
    ts = times.parse_time("t")
    row = df.select(
        times.format_time(ts).alias("time"),
        times.format_date(ts).alias("date"),
        times.date_hour(ts).alias("date_hour"),
        times.date_key(ts).alias("date_key"),
        times.minute_key(ts).alias("minute_key"),
        times.parse_date_key(times.date_key(ts)).cast("string").alias("parsed"),
    ).collect()[0]
    assert tuple(row) == (
        "2024-03-09 05:07:08",
        "2024-03-09",
        "2024-03-09_05",
        "20240309",
        "202403090507",
        "2024-03-09",
    )


def test_seconds_between_is_signed_whole_seconds(spark):
    df = spark.createDataFrame(
        [("2024-01-01 23:59:58.9", "2024-01-02 00:00:01.2")], "a string, b string"
    )
    a, b = times.parse_time("a"), times.parse_time(F.col("b"))
    got = df.select(times.seconds_between(a, b), times.seconds_between(b, a)).collect()[0]
    assert tuple(got) == (3, -3)


def test_day_before_a_run_date():
    assert times.day_before("2024-03-01") == "2024-02-29"


def test_unreadable_time_is_null(spark):
    from pyspark.sql import functions as F

    from visitlens.functions.times import parse_time

    rows = spark.createDataFrame([("2024-01-01 5:03:04",), ("soon",), (None,)], "t string")
    assert [r[0] is None for r in rows.select(parse_time(F.col("t"))).collect()] == [False, True, True]
