"""Ad click analyses over parsed click lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions.times import format_date
from visitlens.operators.ranking import first_per_group

MOST_DAYS = 400
BROADCAST_USERS = 1_000_000  # 8 MB of ids


def user_click_counts(clicks: DataFrame) -> DataFrame:
    """Clicks per (date, user, ad)."""
    return clicks.groupBy(format_date("click_time").alias("date"), "user_id", "ad_id").agg(
        F.count("*").alias("click_count")
    )


def place_user_counts(clicks: DataFrame) -> DataFrame:
    """Clicks per (date, province, city, ad, user): one pass that serves several tables."""
    return clicks.groupBy(
        format_date("click_time").alias("date"), "province", "city", "ad_id", "user_id"
    ).agg(F.count("*").alias("click_count"))


def place_counts(clicks: DataFrame) -> DataFrame:
    """Clicks per (date, province, city, ad)."""
    return clicks.groupBy(
        format_date("click_time").alias("date"), "province", "city", "ad_id"
    ).agg(F.count("*").alias("click_count"))


def user_totals(place_counts: DataFrame) -> DataFrame:
    """Clicks per (date, user, ad), from counts per place."""
    return place_counts.groupBy("date", "user_id", "ad_id").agg(
        F.sum("click_count").alias("click_count")
    )


def lookup_click_counts(keys: DataFrame, counts: DataFrame, most_days: int = MOST_DAYS) -> DataFrame:
    """The stored count of each (date, user, ad) key, 0 where there is none.

    Give stored keys, and counts that are stored by date: only the days of the keys are read,
    by name or, beyond ``most_days``, from the first to the last. The same condition on the
    keys lets Spark build a Bloom filter of them and drop other counts at their scan, where
    the counts are many. Keys that repeat give one row.
    """
    key = ["date", "user_id", "ad_id"]
    days = [r["date"] for r in keys.select("date").distinct().limit(most_days + 1).collect()]
    if len(days) <= most_days:
        asked = F.col("date").isin([day for day in days if day is not None])
    else:
        first, last = keys.agg(F.min("date"), F.max("date")).first()
        asked = F.col("date").between(first, last)
    found = keys.where(asked).select(*key).join(counts.where(asked), key, "left")
    found = found.select(*key, F.coalesce("click_count", F.lit(0)).alias("click_count"))
    if None in days or len(days) > most_days:
        undated = keys.where(F.col("date").isNull()).select(*key, F.lit(0).cast("long").alias("click_count"))
        found = found.unionByName(undated)
    return found.distinct()


def blacklistings(counts: DataFrame, threshold: int) -> DataFrame:
    """(date, user) where a user clicked one ad at least ``threshold`` times in the day."""
    heavy = counts.where((F.col("click_count") >= threshold) & F.col("user_id").isNotNull())
    return heavy.select("date", "user_id").distinct()


def blacklisted_users(counts: DataFrame, threshold: int) -> DataFrame:
    """Users with any such day."""
    return blacklistings(counts, threshold).select("user_id").distinct()


def with_listing(
    clicks: DataFrame, blacklist: DataFrame, salts: int = 16, broadcast_users: int = BROADCAST_USERS
) -> DataFrame:
    """Clicks with a column ``listed``: whether their user is on the blacklist.

    The list grows with the data, so its users are counted first (give a stored list). Up to
    ``broadcast_users`` they are broadcast, and clicks stay where they are. Beyond that both
    sides are shuffled: the users with most clicks are the ones the list is about, so the
    clicks of a user are spread over ``salts`` join keys, and each listed user is repeated for
    all of them. Rows without a user are spread by their text, where they have one.
    """
    listed = blacklist.select("user_id", F.lit(True).alias("listed"))
    if blacklist.count() <= broadcast_users:
        met = clicks.join(F.broadcast(listed), "user_id", "left")
    else:
        listed = listed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
        spread = [c for c in ("click_time", "province", "city", "ad_id", "value") if c in clicks.columns]
        salted = clicks.withColumn("salt", F.pmod(F.hash(*spread), F.lit(salts)))
        met = salted.join(listed, ["user_id", "salt"], "left").drop("salt")
    return met.withColumn("listed", F.coalesce("listed", F.lit(False)))


def allowed_clicks(clicks: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Clicks whose user is not on the blacklist."""
    return with_listing(clicks, blacklist).where(~F.col("listed")).select(*clicks.columns)


def first_listings(listings: DataFrame) -> DataFrame:
    """Per listed user, the first date of a listing."""
    return listings.groupBy("user_id").agg(F.min("date").alias("listed_on"))


def ad_stat_by_listing(counts: DataFrame, listed: DataFrame) -> DataFrame:
    """Clicks per (date, province, city, ad) of users not listed on that date or before.

    ``counts`` are per user and place, ``listed`` gives the first date per user.
    """
    free = F.col("listed_on").isNull() | (F.col("date") < F.col("listed_on"))
    allowed = counts.join(listed, "user_id", "left").where(free)
    return allowed.groupBy("date", "province", "city", "ad_id").agg(
        F.sum("click_count").alias("click_count")
    )


def ad_stat(place_counts: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Clicks of allowed users per (date, province, city, ad).

    The anti join takes counts per user and place, so a user has few rows in it.
    """
    allowed = place_counts.join(blacklist.select("user_id"), "user_id", "left_anti")
    return allowed.groupBy("date", "province", "city", "ad_id").agg(
        F.sum("click_count").alias("click_count")
    )


def province_top3(stat: DataFrame) -> DataFrame:
    """The three most clicked ads of each (date, province), ties by ad id."""
    totals = stat.groupBy("date", "province", "ad_id").agg(
        F.sum("click_count").alias("click_count")
    )
    return first_per_group(
        totals,
        groups=["date", "province"],
        order=[F.desc("click_count"), F.asc_nulls_last("ad_id")],
        n=3,
        row_key=["ad_id"],
    ).drop("row_rank")


def click_trend(clicks: DataFrame) -> DataFrame:
    """Clicks per ad and minute."""
    per_minute = clicks.groupBy(
        F.date_trunc("minute", "click_time").alias("minute_start"), "ad_id"
    ).agg(F.count("*").alias("click_count"))
    return trend_columns(per_minute)


def trend_columns(per_minute: DataFrame, *more: Column) -> DataFrame:
    """Split the start of the minute into the date, hour and minute of the result table."""
    return per_minute.select(
        format_date("minute_start").alias("date"),
        F.date_format("minute_start", "HH").alias("hour"),
        F.date_format("minute_start", "mm").alias("minute"),
        "ad_id",
        "click_count",
        *more,
    )
