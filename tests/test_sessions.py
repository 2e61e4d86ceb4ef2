import pytest
from pyspark.sql import functions as F

from tests.rows import action, actions, users, values
from visitlens.operators import sessions
from visitlens.params import SessionTask


def test_distinct_lists_are_exact_values(spark):
    rows = actions(
        spark,
        action("s", 1, search_keyword="新辣道鱼火锅"),
        action("s", 2, search_keyword="火锅"),
        action("s", 3, search_keyword="火锅"),
        action("s", 4, search_keyword=""),
        action("s", 5, click_category_id=11),
        action("s", 6, click_category_id=1),
        action("s", 7, click_category_id=2),
        action("s", 8),
    )
    got = values(
        sessions.aggregate_sessions(rows), "search_keywords", "click_category_ids", "step_length"
    )
    assert got == [("新辣道鱼火锅,火锅", "1,2,11", 8)]


def test_session_without_keyword_or_category_has_empty_lists(spark):
    rows = actions(spark, action("s", 1), action("s", 1))
    got = values(
        sessions.aggregate_sessions(rows), "search_keywords", "click_category_ids", "visit_length"
    )
    assert got == [("", "", 0)]


def test_one_digit_hours_are_ordered_as_times(spark):
    rows = actions(
        spark,
        {"session_id": "s", "user_id": 1, "action_time": "2024-01-01 15:03:04"},
        {"session_id": "s", "user_id": 1, "action_time": "2024-01-01 5:03:04"},
    )
    row = sessions.aggregate_sessions(rows).collect()[0]
    assert str(row.start_time) == "2024-01-01 05:03:04"
    assert row.visit_length == 10 * 3600


def test_unknown_user_drops_the_session(spark):
    rows = actions(spark, action("a", 1, user_id=1), action("b", 1, user_id=2), action("c", 1, user_id=None))
    people = users(spark, (1, 30, "p1", "c1", "male"))
    got = values(
        sessions.with_users(sessions.aggregate_sessions(rows), people), "session_id", "age", "sex"
    )
    assert got == [("a", 30, "male")]


@pytest.fixture(scope="module")
def population(spark):
    acts = actions(
        spark,
        action("a", 1, user_id=1, search_keyword="kw1", click_category_id=None),
        action("a", 2, user_id=1, click_category_id=11),
        action("b", 1, user_id=2, search_keyword="kw2"),
        action("c", 1, user_id=3, click_category_id=1),
        action("d", 1, user_id=4),
        action("e", 1, user_id=1, day="2024-01-03"),
    )
    people = users(
        spark,
        (1, 20, "nurse", "c1", "male"),
        (2, 30, "cook", "c2", "female"),
        (3, 40, None, "c1", "male"),
        (4, None, "nurse", "c3", "female"),
    )
    return acts, people


@pytest.mark.parametrize(
    ("task", "expected"),
    [
        (SessionTask(), "abcde"),
        (SessionTask(start_age=20, end_age=30), "abe"),
        (SessionTask(start_age=21), "abcde"),
        (SessionTask(end_age=21), "abcde"),
        (SessionTask(professionals=("nurse", "cook")), "abde"),
        (SessionTask(professionals=("nur",)), ""),
        (SessionTask(cities=("c1",)), "ace"),
        (SessionTask(sex=("female",)), "bd"),
        (SessionTask(keywords=("kw1", "kw9")), "a"),
        (SessionTask(category_ids=(1,)), "c"),
        (SessionTask(category_ids=(1, 11), sex=("male",)), "ac"),
        (SessionTask(start_date="2024-01-02"), "e"),
        (SessionTask(end_date="2024-01-02"), "abcd"),
        (SessionTask(start_date="2024-01-01", end_date="2024-01-01", cities=("c1",)), "ac"),
    ],
)
def test_filters(population, task, expected):
    got = values(sessions.filtered_sessions(*population, task), "session_id")
    assert "".join(v for (v,) in got) == expected


def test_equality_filter_skips_missing_values(population):
    rows = sessions.filtered_sessions(*population, SessionTask())
    assert values(sessions.sessions_equal(rows, professional="nurse", sex=None), "session_id") == [
        ("a",),
        ("d",),
        ("e",),
    ]


def test_detail_has_the_actions_of_filtered_sessions_only(population):
    acts, people = population
    chosen = sessions.filtered_sessions(acts, people, SessionTask(sex=("male",)))
    detail = sessions.session_detail(acts, chosen, 7)
    assert values(detail, "taskid", "sessionid") == [(7, "a"), (7, "a"), (7, "c"), (7, "e")]
    assert detail.count() == values(sessions.session_action_count(chosen))[0][0]


@pytest.fixture
def small_partitions(spark):
    """Settings under which a few hundred KB in one partition count as skew."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _hot_actions(spark):
    """60,000 actions; every third has the same session and the same user."""
    return spark.range(0, 60000, 1, 8).selectExpr(
        "if(id % 3 = 0, 'hot', concat('s', id % 997)) AS session_id",
        "if(id % 3 = 0, 1, id) AS user_id",
        "id AS page_id",
        "md5(string(id)) AS action_time",
    )


def _final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_session_is_split_in_the_detail_join(spark, small_partitions):
    acts = _hot_actions(spark)
    joined = sessions.session_actions(acts, acts.select("session_id").distinct())
    assert len(joined.collect()) == 60000
    assert "skew=true" in _final_plan(joined)


def test_sessions_of_a_hot_user_are_split_in_the_user_join(spark, small_partitions):
    rows = _hot_actions(spark).selectExpr("string(page_id) AS session_id", "user_id", "action_time")
    found = rows.groupBy("session_id").agg(
        F.min("user_id").alias("user_id"), F.min("action_time").alias("start")
    )
    people = spark.range(60000).selectExpr(
        "id AS user_id", "1 AS age", "'p' AS professional", "'c' AS city", "'male' AS sex"
    )
    joined = sessions.with_users(found, people)
    assert len(joined.collect()) == 60000
    assert "skew=true" in _final_plan(joined)
