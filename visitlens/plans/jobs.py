"""One function per job. Each writes result tables under one folder, and replaces there what
an earlier run of the same task, or of the same dates, has written. Read them with
``sinks.files.read_replaced``."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.functions.observing import observed
from visitlens.functions.times import day_before
from visitlens.operators import ads, categories, pages, products, sampling, sessions, stats
from visitlens.params import SessionTask
from visitlens.plans.scratch import removed_at_end, stored
from visitlens.sinks.files import read_replaced, replace_groups
from visitlens.sinks.parallel import together
from visitlens.sources.adlog import (
    CLICK_COLUMNS,
    REASONS,
    REJECT_COLUMNS,
    clicks_of,
    counted,
    rejected_counts,
)
from visitlens.sources.tables import actions_in_dates

LISTINGS = "user_id bigint, date string"
PLACE_USER_COUNTS = (
    "date string, province string, city string, ad_id bigint, user_id bigint, click_count bigint"
)
CLICKS = "click"


def for_day_before(task: SessionTask, run_date: str) -> SessionTask:
    """The task over the one day before its run date."""
    day = day_before(run_date)
    return replace(task, start_date=day, end_date=day)


def _replace_task(rows: DataFrame, task: SessionTask, path: str) -> None:
    own = rows.sparkSession.createDataFrame([(task.task_id,)], "taskid bigint")
    replace_groups(rows, own, path, ["taskid"])


def session_analysis(
    spark: SparkSession,
    actions: DataFrame,
    users: DataFrame,
    task: SessionTask,
    out: str,
    per_day: int = 100,
) -> None:
    """Statistics, sample, sampled detail and top categories of the task's sessions."""
    with removed_at_end(spark):
        in_range = actions_in_dates(actions, task.start_date, task.end_date)
        chosen = stored(spark, sessions.filtered_sessions(actions, users, task), "sessions")
        seed = str(task.task_id)

        hours = stats.sessions_per_hour(chosen).withColumn("taskid", F.lit(task.task_id).cast("bigint"))
        drawn = stored(spark, sampling.sample_sessions(chosen, per_day, seed), "drawn")
        detail = sessions.session_detail(in_range, drawn, task.task_id)
        counts = stored(spark, categories.category_counts_by_session(in_range, chosen), "category-counts")
        results = {
            "session_aggr_stat": stats.session_aggr_stat(chosen, task.task_id),
            "session_count_by_hour": hours,
            "session_random_extract": sampling.extract_columns(drawn, task.task_id),
            "session_detail": detail,
            "top10_category": categories.top10_category(counts, task.task_id),
            "top10_category_session": categories.top10_category_session(counts, task.task_id),
        }
        together(*[partial(_replace_task, rows, task, f"{out}/{name}") for name, rows in results.items()])


def page_conversion(actions: DataFrame, task: SessionTask, out: str) -> None:
    in_range = actions_in_dates(actions, task.start_date, task.end_date)
    rates = pages.page_split_convert_rate(in_range, task.page_flow, task.task_id)
    _replace_task(rates, task, f"{out}/page_split_convert_rate")


def area_products(
    actions: DataFrame,
    cities: DataFrame,
    product_table: DataFrame,
    task: SessionTask,
    levels: Mapping[str, str],
    other_level: str,
    out: str,
) -> None:
    in_range = actions_in_dates(actions, task.start_date, task.end_date)
    top = products.area_top3_product(
        in_range, cities, product_table, levels, other_level, task.task_id
    )
    _replace_task(top, task, f"{out}/area_top3_product")


def _changed_listings(before: DataFrame, after: DataFrame) -> DataFrame:
    """``user_id, since, until``: the dates from ``since`` up to before ``until`` on which a
    user is listed by one of two tables of first listings and not by the other."""
    old = before.withColumnRenamed("listed_on", "was_on")
    both = old.join(after, "user_id", "full").where(~F.col("was_on").eqNullSafe(F.col("listed_on")))
    until = F.when(F.col("was_on").isNotNull() & F.col("listed_on").isNotNull(), F.greatest("was_on", "listed_on"))
    return both.select("user_id", F.least("was_on", "listed_on").alias("since"), until.alias("until"))


def _affected_dates(counts: DataFrame, changed: DataFrame) -> DataFrame:
    """Dates of stored counts with clicks of a user whose listing changed for the date."""
    earliest = changed.agg(F.min("since")).first()[0]
    if earliest is None:
        return counts.select("date").limit(0)
    of_users = counts.where(F.col("date") >= earliest).join(changed, "user_id")
    hit = (F.col("date") >= F.col("since")) & (F.col("until").isNull() | (F.col("date") < F.col("until")))
    return of_users.where(hit).select("date").distinct()


def ad_statistics(
    spark: SparkSession, read: DataFrame, threshold: int, out: str, source: str = "all"
) -> dict[str, int]:
    """All ad tables for the dates in read ad lines (or in clicks alone), each date whole; it
    replaces what was there.

    A click counts unless its user was listed on its date or before, whichever run wrote the
    listing; so running a day again after later ones gives what its first run gave. Where a
    run changes a user's first listing, the later dates on which the user's clicks count anew,
    or no more, are computed again from the stored counts: tables always equal those of one
    run over all days.

    The lines are read once. Those that are no clicks replace the rejected lines of
    ``source``; the counts of lines by outcome are returned.
    """
    if "reason" not in read.columns:
        read = read.select(*CLICK_COLUMNS, *[F.lit(None).cast("string").alias(c) for c in REJECT_COLUMNS])
    with removed_at_end(spark):
        outcome = F.coalesce("reason", F.lit(CLICKS))
        watched, seen = counted(read, outcome, (CLICKS, *REASONS))
        lines = stored(spark, watched, "ad-lines")
        clicks = clicks_of(lines)
        rejected = rejected_counts(lines).withColumn("source", F.lit(source))
        own = spark.createDataFrame([(source,)], "source string")

        by_date = ["date"]
        fresh = stored(spark, ads.place_user_counts(clicks), "place-user-counts")
        dates = stored(spark, fresh.select("date").distinct(), "dates")
        users = stored(spark, ads.user_totals(fresh), "user-counts")
        together(
            lambda: replace_groups(rejected, own, f"{out}/rejected_ad_lines", ["source"]),
            lambda: replace_groups(fresh, dates, f"{out}/ad_place_user_count", by_date),
            lambda: replace_groups(users, dates, f"{out}/ad_user_click_count", by_date),
            lambda: replace_groups(ads.click_trend(clicks), dates, f"{out}/ad_click_trend", by_date),
        )

        listings = f"{out}/ad_blacklist"
        before = ads.first_listings(read_replaced(spark, listings, LISTINGS))
        replace_groups(ads.blacklistings(users, threshold), dates, listings, by_date)
        listed = stored(spark, ads.first_listings(read_replaced(spark, listings, LISTINGS)), "listed")
        changed = stored(spark, _changed_listings(before, listed), "changed-listings")

        counts = read_replaced(spark, f"{out}/ad_place_user_count", PLACE_USER_COUNTS)
        affected = stored(spark, dates.union(_affected_dates(counts, changed)).distinct(), "affected-dates")
        due = counts.join(affected, "date", "left_semi")
        stat = stored(spark, ads.ad_stat_by_listing(due, listed), "ad-stat")
        together(
            lambda: replace_groups(stat, affected, f"{out}/ad_stat", by_date),
            lambda: replace_groups(ads.province_top3(stat), affected, f"{out}/ad_province_top3", by_date),
        )
    return {name: observed(seen).get(name, 0) for name in (CLICKS, *REASONS)}
