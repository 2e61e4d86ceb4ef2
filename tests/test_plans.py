"""The shape of physical plans: what reaches the scan, what is shuffled, what is limited."""

import __spark_entry__ as entry_point
from tests.rows import action, actions
from visitlens import schemas
from visitlens.functions.times import day_before
from visitlens.operators import ads
from visitlens.sinks import batches
from visitlens.sources.tables import actions_in_dates

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def query_plan(spark, name):
    return plan(entry_point.queries()[name](spark, FOLDER))


def test_date_bounds_reach_the_scan(spark):
    text = query_plan(spark, "action_scan_date_range")
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2024-01-05T00:00)" in text


def test_date_bounds_prune_partitions(spark, tmp_path):
    rows = actions(spark, *[action("s", 1, day=f"2024-01-0{d}") for d in range(1, 6)])
    path = str(tmp_path / "t")
    rows.write.partitionBy("date").parquet(path)
    table = spark.read.schema(schemas.USER_VISIT_ACTION).parquet(path)
    got = actions_in_dates(table, day_before("2024-01-03"), "2024-01-03")
    assert "PartitionFilters: [isnotnull(date" in plan(got)
    assert got.count() == 2


def test_statistics_need_no_lists_and_few_columns(spark):
    text = query_plan(spark, "session_aggr_stat")
    assert "collect_set" not in text and "ObjectHashAggregate" not in text
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in text


def test_lists_are_built_from_distinct_values(spark):
    """Below the aggregation that builds lists stands a plain one over the actions."""
    lines = query_plan(spark, "session_aggregate").splitlines()
    kinds = [line.strip("+-:! *()0123456789").split("(")[0] for line in lines if "Aggregate(" in line]
    assert kinds[:2] == ["ObjectHashAggregate"] * 2 and kinds[2:] == ["HashAggregate"] * 2


def test_replacement_scans_the_clicks_twice(spark):
    text = query_plan(spark, "replace_groups")
    assert text.count("events.parquet") <= 2


def test_ranked_reports_limit_groups_before_the_shuffle(spark):
    for name in ("top10_category_session", "area_top3_product", "ad_province_top3"):
        text = query_plan(spark, name)
        assert "row_number(), " in text and "Partial" in text, name
    assert "TakeOrderedAndProject" in query_plan(spark, "top10_category")


def test_no_query_has_a_cross_join_or_a_python_stage(spark):
    for name in entry_point.queries():
        if name.startswith(("stream_", "sink_", "op", "pipeline")) or name.endswith("_rerun"):
            continue
        text = query_plan(spark, name)
        for forbidden in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
            assert forbidden not in text, (name, forbidden)


def test_lookup_prunes_days_and_filters_stored_counts(spark, tmp_path):
    days = [f"2024-01-0{d}" for d in range(1, 8)]
    rows = [(day, user, 1, 5) for day in days for user in range(50)]
    counts = spark.createDataFrame(rows, "date string, user_id bigint, ad_id bigint, click_count bigint")
    counts.write.partitionBy("date").parquet(str(tmp_path / "counts"))
    history = spark.read.schema(counts.schema).parquet(str(tmp_path / "counts"))
    counts.where("date <= '2024-01-02' AND user_id < 3").drop("click_count").write.parquet(str(tmp_path / "keys"))
    keys = spark.read.parquet(str(tmp_path / "keys"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    }
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        found = ads.lookup_click_counts(keys, history)
        text = plan(found)
        assert "PartitionFilters: [date" in text and "might_contain" in text
        assert found.where("click_count = 5").count() == 6
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_reading_touched_dates_prunes_batches(spark, tmp_path):
    key = ("date", "province", "city", "ad_id")
    table = batches.StateTable(str(tmp_path / "t"), schemas.AD_STAT, key, "click_count", "sum", ("date",))
    for batch_id in range(4):
        day = f"2024-01-0{batch_id + 1}"
        table.write(spark.createDataFrame([(day, "P", "C", 1, 1)], schemas.AD_STAT), batch_id)
    dates = table.delta(spark, 3).select("date").distinct()
    assert table.read(spark, 3, dates).count() == 1
