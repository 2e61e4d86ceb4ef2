"""The jobs write every result table, in the columns of its contract."""

import re

import pytest

from tests.rows import values
from visitlens import schemas
from visitlens.operators import ads, sampling, sessions, stats
from visitlens.params import SessionTask
from visitlens.plans import jobs
from visitlens.sinks.files import read_replaced
from visitlens.sources import testtables as tables
from visitlens.sources.adlog import parse_ad_lines, read_ad_lines

FOLDER = "/root/testdata/sf0.001"
TASK = SessionTask(task_id=8, sex=("male",), start_date="2024-01-03", page_flow=(1, 2, 3))


def columns(schema):
    return re.findall(r"(\w+) \w+", schema)


def typed(df):
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)


@pytest.fixture(scope="module")
def inputs(spark):
    return tables.user_visit_action(spark, FOLDER), tables.user_info(spark, FOLDER)


def test_session_analysis(spark, inputs, tmp_path):
    actions, users = inputs
    out = str(tmp_path)
    jobs.session_analysis(spark, actions, users, TASK, out, per_day=4)
    chosen = sessions.filtered_sessions(actions, users, TASK)

    stat = read_replaced(spark, f"{out}/session_aggr_stat")
    expected = stats.session_aggr_stat(chosen, 8)
    assert values(stat, *expected.columns) == values(expected)
    sample = read_replaced(spark, f"{out}/session_random_extract", schemas.SESSION_RANDOM_EXTRACT)
    assert typed(sample) == schemas.SESSION_RANDOM_EXTRACT
    assert values(sample) == values(sampling.session_random_extract(chosen, 4, "8", 8))
    detail = read_replaced(spark, f"{out}/session_detail", schemas.SESSION_DETAIL)
    assert typed(detail) == schemas.SESSION_DETAIL
    assert {r.sessionid for r in detail.collect()} == {r.sessionid for r in sample.collect()}
    in_range = actions.where("date >= '2024-01-03'").join(
        sample.selectExpr("sessionid AS session_id"), "session_id", "left_semi"
    )
    assert detail.count() == in_range.count()
    assert typed(read_replaced(spark, f"{out}/top10_category", schemas.TOP10_CATEGORY)) == schemas.TOP10_CATEGORY
    best = read_replaced(spark, f"{out}/top10_category_session", schemas.TOP10_CATEGORY_SESSION)
    assert typed(best) == schemas.TOP10_CATEGORY_SESSION
    hours = read_replaced(spark, f"{out}/session_count_by_hour")
    assert hours.groupBy().sum("session_count").collect()[0][0] == chosen.count()

    for _ in range(2):  # a task that runs again replaces its own rows
        jobs.session_analysis(spark, actions, users, SessionTask(task_id=9), out, per_day=4)
    again = read_replaced(spark, f"{out}/session_aggr_stat")
    assert [r.taskid for r in again.orderBy("taskid").collect()] == [8, 9]


def test_page_and_area_jobs(spark, inputs, tmp_path):
    actions, _ = inputs
    out = str(tmp_path)
    jobs.page_conversion(actions, TASK, out)
    pages = read_replaced(spark, f"{out}/page_split_convert_rate", schemas.PAGE_SPLIT_CONVERT_RATE)
    assert typed(pages) == schemas.PAGE_SPLIT_CONVERT_RATE
    assert re.fullmatch(r"1_2=\d+\.\d+\|2_3=\d+\.\d+", pages.collect()[0].convertRate)

    cities, products = tables.city_info(spark, FOLDER), tables.product_info(spark, FOLDER)
    jobs.area_products(actions, cities, products, TASK, {"ASIA": "A"}, "B", out)
    top = read_replaced(spark, f"{out}/area_top3_product", schemas.AREA_TOP3_PRODUCT)
    assert typed(top) == schemas.AREA_TOP3_PRODUCT
    assert top.groupBy("area").count().where("count > 3").count() == 0


def test_ad_job_and_its_repetition(spark, tmp_path):
    clicks = parse_ad_lines(tables.ad_lines(spark, FOLDER, "2024-01-01", "2024-01-04"))
    out = str(tmp_path)
    counts = ads.user_click_counts(clicks)
    listings = ads.blacklistings(counts, 3)
    stat = ads.ad_stat_by_listing(ads.place_user_counts(clicks), ads.first_listings(listings))
    expected = {
        "ad_user_click_count": (schemas.AD_USER_CLICK_COUNT, counts),
        "ad_blacklist": (jobs.LISTINGS, listings),
        "ad_stat": (schemas.AD_STAT, stat),
        "ad_province_top3": (schemas.AD_PROVINCE_TOP3, ads.province_top3(stat)),
        "ad_click_trend": (schemas.AD_CLICK_TREND, ads.click_trend(clicks)),
    }
    for _ in range(2):  # running the same dates again changes nothing
        jobs.ad_statistics(spark, clicks, 3, out)
        for name, (schema, rows) in expected.items():
            got = read_replaced(spark, f"{out}/{name}", schema)
            assert values(got) == values(rows, *columns(schema)), name


def _day(spark, *users_of_clicks, day=0):
    from tests.test_ads import clicks

    return clicks(spark, *[(day * 86400 + i, "P", "C", u, 9) for i, u in enumerate(users_of_clicks)])


def _stat_total(spark, out):
    rows = read_replaced(spark, f"{out}/ad_stat", schemas.AD_STAT)
    return {r.date: r.click_count for r in rows.collect()}


def test_rerun_of_a_corrected_day_can_empty_its_tables(spark, tmp_path):
    out = str(tmp_path)
    jobs.ad_statistics(spark, _day(spark, 1, 1, 2), 3, out)
    assert _stat_total(spark, out) == {"2024-01-01": 3}
    jobs.ad_statistics(spark, _day(spark, 1, 1, 1), 3, out)
    assert _stat_total(spark, out) == {}
    jobs.ad_statistics(spark, _day(spark, 1, 1, 2), 3, out)
    assert _stat_total(spark, out) == {"2024-01-01": 3}
    assert read_replaced(spark, f"{out}/ad_blacklist", jobs.LISTINGS).count() == 0


def test_rerun_of_a_day_ignores_later_listings(spark, tmp_path):
    out = str(tmp_path)
    jobs.ad_statistics(spark, _day(spark, 1, 2), 3, out)
    jobs.ad_statistics(spark, _day(spark, 1, 1, 1, 2, day=1), 3, out)
    expected = {"2024-01-01": 2, "2024-01-02": 1}
    assert _stat_total(spark, out) == expected
    jobs.ad_statistics(spark, _day(spark, 1, 2), 3, out)
    assert _stat_total(spark, out) == expected
    jobs.ad_statistics(spark, _day(spark, 1, 3, day=2), 3, out)  # listed on an earlier day
    assert _stat_total(spark, out) == expected | {"2024-01-03": 1}


def test_task_over_the_day_before_its_run_date():
    task = jobs.for_day_before(TASK, "2024-03-01")
    assert (task.start_date, task.end_date, task.task_id) == ("2024-02-29", "2024-02-29", 8)


AD_TABLES = {
    "ad_user_click_count": schemas.AD_USER_CLICK_COUNT,
    "ad_blacklist": jobs.LISTINGS,
    "ad_stat": schemas.AD_STAT,
    "ad_province_top3": schemas.AD_PROVINCE_TOP3,
    "ad_click_trend": schemas.AD_CLICK_TREND,
}


def _tables(spark, out):
    return {name: values(read_replaced(spark, f"{out}/{name}", s), *columns(s)) for name, s in AD_TABLES.items()}


@pytest.mark.parametrize(("first", "corrected"), [((1, 1, 1, 2), (1, 1, 2)), ((1, 2), (2, 2, 2, 1, 1, 1))])
def test_corrected_day_changes_the_days_after_it(spark, tmp_path, first, corrected):
    later = [(1, (1, 2, 3, 3, 3, 1, 1))]
    out, fresh = str(tmp_path / "corrected"), str(tmp_path / "fresh")
    jobs.ad_statistics(spark, _day(spark, *first), 3, out)
    for day, clicked in later:
        jobs.ad_statistics(spark, _day(spark, *clicked, day=day), 3, out)
    jobs.ad_statistics(spark, _day(spark, *corrected), 3, out)
    every_day = _day(spark, *corrected)
    for day, clicked in later:
        every_day = every_day.union(_day(spark, *clicked, day=day))
    jobs.ad_statistics(spark, every_day, 3, fresh)
    assert _tables(spark, out) == _tables(spark, fresh)


def test_unchanged_listings_leave_other_dates_alone(spark, tmp_path):
    out = str(tmp_path)
    for day in range(3):
        jobs.ad_statistics(spark, _day(spark, 1, 2, day=day), 3, out)
    jobs.ad_statistics(spark, _day(spark, 1, 2, 2), 3, out)
    written = read_replaced(spark, f"{out}/ad_stat", schemas.AD_STAT).inputFiles()
    found = [re.search(r"version=(\d+)/date=([0-9-]+)", f) for f in written]
    assert {f.groups() for f in found if f} >= {
        ("2", "2024-01-02"), ("3", "2024-01-03"), ("4", "2024-01-01")
    }
    manifest = spark.read.parquet(f"{out}/ad_stat/manifest/version=4")
    assert values(manifest, "date", "version") == [("2024-01-01", 4), ("2024-01-02", 2), ("2024-01-03", 3)]


def test_job_sets_rejected_lines_aside(spark, tmp_path):
    from tests.test_ads import BASE

    out = str(tmp_path)
    good = f"{BASE} P C 1 9"
    text = [good, "soon P C 1 9", "", "", "9223372036854775807 x", good, None]
    lines = spark.createDataFrame([(t,) for t in text], "value string").coalesce(1)
    seen = jobs.ad_statistics(spark, read_ad_lines(lines), 9, out, source="a")
    assert seen == {"click": 2, "empty line": 3, "time is no number": 1, "time out of range": 1}

    def rejected():
        rows = read_replaced(spark, f"{out}/rejected_ad_lines", f"source string, {schemas.REJECTED_AD_LINES}")
        return {(r.source, r.value, r.reason, r.line_count) for r in rows.collect()}

    first = {
        ("a", None, "empty line", 1), ("a", "", "empty line", 2), ("a", "soon P C 1 9", "time is no number", 1),
        ("a", "9223372036854775807 x", "time out of range", 1),
    }
    assert rejected() == first
    again = spark.createDataFrame([("x",), (good,)], "value string")
    jobs.ad_statistics(spark, read_ad_lines(again), 9, out, source="b")
    assert rejected() == first | {("b", "x", "time is no number", 1)}
    jobs.ad_statistics(spark, read_ad_lines(again.limit(0)), 9, out, source="a")
    assert rejected() == {("b", "x", "time is no number", 1)}


def test_job_removes_its_intermediate_folders(spark, tmp_path):
    from pathlib import Path

    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.iterdir())
    jobs.ad_statistics(spark, _day(spark, 1, 2), 3, str(tmp_path))
    assert set(shared.iterdir()) == before
