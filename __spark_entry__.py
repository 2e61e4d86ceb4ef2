"""Registered queries over the test tables, and the SQL that each must agree with."""

from __future__ import annotations

import sys
import tempfile
from collections.abc import Callable
from importlib import import_module
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

sys.path.insert(0, str(Path(__file__).resolve().parent))

import oracle_texts  # noqa: E402
from visitlens import schemas  # noqa: E402
from visitlens.functions.times import (  # noqa: E402
    date_key,
    format_date,
    format_time,
    minute_key,
    parse_date_key,
    parse_time,
)
from visitlens.operators import (  # noqa: E402
    ads,
    categories,
    pages,
    products,
    sampling,
    sessions,
    stats,
    upserts,
)
from visitlens.params import SessionTask, task_parameters  # noqa: E402
from visitlens.plans import jobs  # noqa: E402
from visitlens.plans.scratch import OWN_SETTING, shared_folder, stored  # noqa: E402
from visitlens.sinks.files import append_rows, overwrite_groups, read_replaced, read_table  # noqa: E402
from visitlens.sinks.files import replace_groups as replace_stored_groups  # noqa: E402
from visitlens.sources import testtables as tables  # noqa: E402
from visitlens.sources.adlog import (  # noqa: E402
    clicks_of,
    file_ad_lines,
    parse_ad_lines,
    read_ad_lines,
)
from visitlens.sources.tables import actions_in_dates, product_status  # noqa: E402
from visitlens.streaming import ads as streams  # noqa: E402

OPEN_TASK = SessionTask(task_id=1)
FILTER_TASK = SessionTask(
    task_id=2,
    start_date="2024-01-02",
    end_date="2024-01-29",
    start_age=5,
    end_age=54,
    professionals=("HOUSEHOLD", "MACHINERY", "BUILDING", "FURNITURE"),
    cities=tuple(f"NATION_{i}" for i in range(20)),
    sex=("male",),
    keywords=("kw1", "kw3", "kw5", "kw7", "kw9"),
    category_ids=tuple(range(10, 60)),
)
SCAN_DATES = ("2024-01-05", "2024-01-20")
RUN_DATE = "2024-01-11"
PER_DAY = 5
SEED = "1"
PAGE_FLOW = (1, 2, 3, 3, 4)
AREA_LEVELS = {"ASIA": "A", "EUROPE": "A", "AMERICA": "B"}
OTHER_LEVEL = "C"
BLACKLIST_AT = 3
CUT_DATE = "2024-01-16"
CUT_TIME = "2024-01-16 12:00:00"


def _filtered(
    spark: SparkSession, d: str, task: SessionTask = OPEN_TASK, lists: bool = False
) -> DataFrame:
    actions = tables.user_visit_action(spark, d, task.start_date, task.end_date)
    return sessions.filtered_sessions(actions, tables.user_info(spark, d), task, lists)


def _clicks(spark: SparkSession, d: str) -> DataFrame:
    return parse_ad_lines(tables.ad_lines(spark, d))


def _shown_sessions(rows: DataFrame) -> DataFrame:
    return rows.withColumn("start_time", format_time("start_time"))


def _shown_clicks(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.unix_millis("click_time").alias("click_ms"), "province", "city", "user_id", "ad_id"
    )


# Scans and parameters


def action_scan_date_range(spark, d):
    return actions_in_dates(tables.user_visit_action(spark, d, *SCAN_DATES), *SCAN_DATES)


def action_scan_day_before(spark, d):
    """What a job of the run date reads: the day before it."""
    task = jobs.for_day_before(OPEN_TASK, RUN_DATE)
    actions = tables.user_visit_action(spark, d, task.start_date, task.end_date)
    return actions_in_dates(actions, task.start_date, task.end_date)


def action_count_by_minute(spark, d):
    """Actions per minute, under the date and minute keys."""
    acted = parse_time("action_time")
    rows = tables.user_visit_action(spark, d).select(
        date_key(acted).alias("date_key"), minute_key(acted).alias("minute_key")
    )
    counted = rows.groupBy("date_key", "minute_key").agg(F.count("*").alias("action_count"))
    return counted.withColumn("date", format_date(parse_date_key("date_key")))


def product_status_scan(spark, d):
    return product_status(tables.product_info(spark, d))


def task_params(spark, d):
    return task_parameters(tables.task(spark, d))


# Sessions


def session_aggregate(spark, d):
    return _shown_sessions(sessions.aggregate_sessions(tables.user_visit_action(spark, d)))


def session_user_enriched(spark, d):
    rows = sessions.aggregate_sessions(tables.user_visit_action(spark, d))
    return _shown_sessions(sessions.with_users(rows, tables.user_info(spark, d)))


def session_filtered(spark, d):
    return _shown_sessions(_filtered(spark, d, FILTER_TASK, lists=True))


def session_equal_filter(spark, d):
    return _shown_sessions(
        sessions.sessions_equal(_filtered(spark, d, lists=True), professional="MACHINERY", sex="female", city=None)
    )


def session_detail(spark, d):
    actions = tables.user_visit_action(spark, d)
    return sessions.session_detail(actions, _filtered(spark, d), OPEN_TASK.task_id)


def session_detail_count(spark, d):
    return sessions.session_action_count(_filtered(spark, d))


def session_aggr_stat(spark, d):
    return stats.session_aggr_stat(_filtered(spark, d), OPEN_TASK.task_id)


def session_aggr_stat_filtered(spark, d):
    return stats.session_aggr_stat(_filtered(spark, d, FILTER_TASK), FILTER_TASK.task_id)


def session_count_by_hour(spark, d):
    return stats.sessions_per_hour(_filtered(spark, d))


def session_random_extract(spark, d):
    """Sessions are stored first: quotas and draw read them, with different columns."""
    chosen = stored(spark, _filtered(spark, d, lists=True), "sessions")
    return sampling.session_random_extract(chosen, PER_DAY, SEED, OPEN_TASK.task_id)


def session_random_extract_detail(spark, d):
    drawn = sampling.sample_sessions(_filtered(spark, d), PER_DAY, SEED)
    return sessions.session_detail(tables.user_visit_action(spark, d), drawn, OPEN_TASK.task_id)


# Categories, pages, products


def _category_counts(spark, d):
    actions = tables.user_visit_action(spark, d)
    return categories.category_counts_by_session(actions, _filtered(spark, d))


def top10_category(spark, d):
    return categories.top10_category(_category_counts(spark, d), OPEN_TASK.task_id)


def top10_category_session(spark, d):
    """Counts are stored first: the ten categories and their sessions both read them."""
    counts = stored(spark, _category_counts(spark, d), "category-counts")
    return categories.top10_category_session(counts, OPEN_TASK.task_id)


def page_split_convert_rate(spark, d):
    return pages.page_convert_rates(tables.user_visit_action(spark, d), PAGE_FLOW)


def page_split_convert_rate_string(spark, d):
    actions = tables.user_visit_action(spark, d)
    return pages.page_split_convert_rate(actions, PAGE_FLOW, OPEN_TASK.task_id)


def area_top3_product(spark, d):
    return products.area_top3_product(
        tables.user_visit_action(spark, d),
        tables.city_info(spark, d),
        tables.product_info(spark, d),
        AREA_LEVELS,
        OTHER_LEVEL,
        OPEN_TASK.task_id,
    )


# Ads


def ad_log_parse(spark, d):
    return _shown_clicks(_clicks(spark, d))


def ad_user_click_count(spark, d):
    return ads.user_click_counts(_clicks(spark, d))


def ad_click_count_lookup(spark, d):
    """For every (date, user, ad) clicked, the stored count one day later."""
    counts = ad_user_click_count(spark, d)
    path = shared_folder(spark, "user-click-counts")
    overwrite_groups(counts, path, ["date"])
    history = spark.read.schema(counts.schema).parquet(path)
    next_day = format_date(F.date_add(F.to_date("date"), 1)).alias("date")
    keys = stored(spark, history.select(next_day, "user_id", "ad_id"), "lookup-keys")
    return ads.lookup_click_counts(keys, history)


def ad_blacklist(spark, d):
    return ads.blacklisted_users(ad_user_click_count(spark, d), BLACKLIST_AT)


def ad_clicks_allowed(spark, d):
    listed = stored(spark, ad_blacklist(spark, d), "blacklist")
    return _shown_clicks(ads.allowed_clicks(_clicks(spark, d), listed))


def ad_stat(spark, d):
    """One pass over the clicks: counts per place are stored, list and statistic read them."""
    counts = stored(spark, ads.place_user_counts(_clicks(spark, d)), "place-user-counts")
    return ads.ad_stat(counts, ads.blacklisted_users(ads.user_totals(counts), BLACKLIST_AT))


def ad_province_top3(spark, d):
    return ads.province_top3(ad_stat(spark, d))


def ad_click_trend(spark, d):
    return ads.click_trend(_clicks(spark, d))


# Upserts and sinks. "Stored" is what was known at the cut time; a batch comes after it.


def _stored_and_batch(spark, d):
    """Counts up to the cut time, and the full counts of the dates from the cut date on."""
    clicks = _clicks(spark, d)
    before = ads.place_counts(clicks.where(F.col("click_time") < CUT_TIME))
    batch = ads.place_counts(clicks.where(F.col("click_time") >= CUT_DATE))
    return before, batch


def upsert_split_existing(spark, d):
    before, batch = _stored_and_batch(spark, d)
    return upserts.rows_with_stored_key(batch, before, streams.STAT_KEY)


def upsert_split_new(spark, d):
    before, batch = _stored_and_batch(spark, d)
    return upserts.rows_with_new_key(batch, before, streams.STAT_KEY)


def upsert_replace(spark, d):
    before, batch = _stored_and_batch(spark, d)
    return upserts.upsert_replace(before, batch, streams.STAT_KEY, ["click_count"])


def upsert_accumulate(spark, d):
    clicks = _clicks(spark, d)
    before = ads.user_click_counts(clicks.where(F.col("click_time") < CUT_TIME))
    delta = ads.user_click_counts(clicks.where(F.col("click_time") >= CUT_TIME))
    return upserts.upsert_add(before, delta, streams.USER_KEY, "click_count")


def _stored_and_new_top3(spark, d):
    before, batch = _stored_and_batch(spark, d)
    return ads.province_top3(before), stored(spark, ads.province_top3(batch), "new-top3")


def replace_groups(spark, d):
    """The batch is stored first: its groups and its rows are read apart."""
    before, batch = _stored_and_new_top3(spark, d)
    return upserts.replace_groups(before, batch, ["date", "province"])


def sink_append(spark, d):
    path = shared_folder(spark, "sink-append")
    counts = stored(spark, ad_user_click_count(spark, d), "user-counts")
    append_rows(counts.where(F.col("date") < CUT_DATE), path)
    append_rows(counts.where(F.col("date") >= CUT_DATE), path)
    return read_table(spark, path, schemas.AD_USER_CLICK_COUNT)


def sink_replace_groups(spark, d):
    """Two writes; the second has every date from the cut date on whole, and replaces it."""
    path = shared_folder(spark, "sink-replace-groups")
    for counts in _stored_and_batch(spark, d):
        counts = stored(spark, counts, "place-counts")
        replace_stored_groups(ads.province_top3(counts), counts, path, ["date"])
    return read_replaced(spark, path, schemas.AD_PROVINCE_TOP3)


def ad_statistics_rerun(spark, d):
    """The ad job over all clicks, then again from the cut date on without the clicks before
    the cut time, which leaves that date fewer groups."""
    out = shared_folder(spark, "ad-statistics")
    clicks = _clicks(spark, d)
    jobs.ad_statistics(spark, clicks, BLACKLIST_AT, out)
    jobs.ad_statistics(spark, clicks.where(F.col("click_time") >= CUT_TIME), BLACKLIST_AT, out)
    return read_replaced(spark, f"{out}/ad_stat", schemas.AD_STAT)


def ad_statistics_corrected(spark, d):
    """The ad job over all clicks but a third of the users' early ones, then again over the
    early dates with all of their clicks: later dates follow the listings that this changes."""
    out = shared_folder(spark, "ad-corrected")
    clicks = _clicks(spark, d)
    early = F.col("click_time") < CUT_DATE
    jobs.ad_statistics(spark, clicks.where(~early | (F.col("user_id") % 3 > 0)), BLACKLIST_AT, out)
    jobs.ad_statistics(spark, clicks.where(early), BLACKLIST_AT, out)
    return read_replaced(spark, f"{out}/ad_stat", schemas.AD_STAT)


def ad_lines_rejected(spark, d):
    """What the ad job sets aside of lines of which some are broken, read once."""
    out = shared_folder(spark, "ad-rejected")
    jobs.ad_statistics(spark, read_ad_lines(tables.ad_lines_some_broken(spark, d)), BLACKLIST_AT, out)
    rows = read_replaced(spark, f"{out}/rejected_ad_lines", f"source string, {schemas.REJECTED_AD_LINES}")
    return rows.drop("source")


# Streams. The lines arrive in thirds of a month; each arrival is one batch.


def _arrivals(spark: SparkSession, d: str) -> list[tuple[str, str]]:
    """First and last date of each third of a month that has events: three a month."""
    day = F.col("ts").cast("date")
    third = F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2))
    spans = (
        tables.load(spark, d, "events")
        .where("ts IS NOT NULL")
        .groupBy(F.date_format("ts", "yyyy-MM").alias("month"), third.alias("third"))
        .agg(F.min(day).cast("string").alias("first"), F.max(day).cast("string").alias("last"))
        .orderBy("month", "third")
    )
    return [(row["first"], row["last"]) for row in spans.collect()]


def _replay(
    spark: SparkSession, d: str, build: Callable[[DataFrame, str], DataStreamWriter], lines=tables.ad_lines
) -> None:
    """Let the lines arrive, and after each arrival run the stream until it has caught up."""
    feed = shared_folder(spark, "ad-lines")
    checkpoint = shared_folder(spark, "ad-checkpoint")
    for first, last in _arrivals(spark, d):
        lines(spark, d, first, last).write.mode("append").text(feed)
        read = read_ad_lines(file_ad_lines(spark, feed))
        query = build(read, checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def _ad_tables(spark: SparkSession, d: str, lines=tables.ad_lines) -> str:
    """The folder of the tables that one run of the ad stream keeps."""
    out = shared_folder(spark, "ad-tables")
    _replay(spark, d, lambda read, at: streams.ad_stream(read, BLACKLIST_AT, out, at), lines)
    return out


def stream_ad_stat(spark, d):
    return streams.read_ad_stat(spark, _ad_tables(spark, d))


def stream_ad_user_click_count(spark, d):
    return streams.read_user_click_counts(spark, _ad_tables(spark, d))


def stream_ad_clicks_allowed(spark, d):
    return _shown_clicks(streams.read_allowed_clicks(spark, _ad_tables(spark, d)))


def stream_ad_province_top3(spark, d):
    return streams.read_province_top3(spark, _ad_tables(spark, d))


def stream_ad_blacklist(spark, d):
    return streams.read_blacklist(spark, _ad_tables(spark, d))


def stream_ad_click_trend(spark, d):
    out = shared_folder(spark, "ad-click-trend")
    _replay(spark, d, lambda read, at: streams.click_trend_stream(clicks_of(read), out, at))
    return streams.read_click_trend(spark, out)


def stream_ad_lines_rejected(spark, d):
    out = _ad_tables(spark, d, tables.ad_lines_some_broken)
    return streams.read_rejected_lines(spark, out)


def stream_ad_line_outcomes(spark, d):
    out = _ad_tables(spark, d, tables.ad_lines_some_broken)
    return streams.read_line_outcomes(spark, out)


_QUERIES = (
    action_scan_date_range,
    action_scan_day_before,
    action_count_by_minute,
    product_status_scan,
    task_params,
    session_aggregate,
    session_user_enriched,
    session_filtered,
    session_equal_filter,
    session_detail,
    session_detail_count,
    session_aggr_stat,
    session_aggr_stat_filtered,
    session_count_by_hour,
    session_random_extract,
    session_random_extract_detail,
    top10_category,
    top10_category_session,
    page_split_convert_rate,
    page_split_convert_rate_string,
    area_top3_product,
    ad_log_parse,
    ad_user_click_count,
    ad_click_count_lookup,
    ad_blacklist,
    ad_clicks_allowed,
    ad_stat,
    ad_province_top3,
    ad_click_trend,
    upsert_split_existing,
    upsert_split_new,
    upsert_replace,
    upsert_accumulate,
    replace_groups,
    sink_append,
    sink_replace_groups,
    ad_statistics_rerun,
    ad_statistics_corrected,
    ad_lines_rejected,
    stream_ad_stat,
    stream_ad_user_click_count,
    stream_ad_clicks_allowed,
    stream_ad_province_top3,
    stream_ad_blacklist,
    stream_ad_click_trend,
    stream_ad_lines_rejected,
    stream_ad_line_outcomes,
)


try:  # the operators for training data, where they are installed
    _llm = import_module("visitlens.llm.queries")
except ModuleNotFoundError as error:
    if error.name not in ("visitlens.llm", "visitlens.llm.queries"):
        raise
    _LLM_QUERIES, _LLM_SQL = {}, {}
else:
    _LLM_QUERIES, _LLM_SQL = _llm.QUERIES, _llm.ORACLE_SQL


def _in_utc(query: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_SETTING, None)
        if not named and spark.sparkContext.master.startswith("local["):
            spark.conf.set(OWN_SETTING, tempfile.mkdtemp(prefix="visitlens-"))
        return query(spark, sf_dir)

    return run


def entry(spark: SparkSession) -> DataFrame:
    """Session statistics of the smallest test tables."""
    return queries()["session_aggr_stat"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {query.__name__: query for query in _QUERIES}
    return {name: _in_utc(query) for name, query in (own | _LLM_QUERIES).items()}


def oracle_sql() -> dict[str, str]:
    return oracle_texts.oracle_sql() | _LLM_SQL
