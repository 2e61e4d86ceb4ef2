import random

from tests.rows import action, actions, values
from visitlens.functions.ratios import ratio_half_up
from visitlens.operators import sessions, stats


def _counts(spark, rows):
    df = spark.createDataFrame(rows, "visit_length bigint, step_length bigint")
    return stats.session_counters(df).collect()[0].asDict()


def test_visit_bucket_edges(spark):
    lengths = [0, 1, 3, 4, 6, 7, 9, 10, 29, 30, 59, 60, 179, 180, 599, 600, 1799, 1800, 9999]
    got = _counts(spark, [(v, 0) for v in lengths])
    assert got["session_count"] == 19
    names = ["1s_3s", "4s_6s", "7s_9s", "10s_30s", "30s_60s", "1m_3m", "3m_10m", "10m_30m", "30m"]
    assert [got[f"visit_length_{n}"] for n in names] == [2] * 9


def test_step_bucket_edges(spark):
    got = _counts(spark, [(0, v) for v in [1, 3, 4, 6, 7, 9, 10, 29, 30, 59, 60, 500]])
    names = ["1_3", "4_6", "7_9", "10_30", "30_60", "60"]
    assert [got[f"step_length_{n}"] for n in names] == [2] * 6


def test_ratio_is_half_up_on_the_exact_value(spark):
    df = spark.createDataFrame([(29, 200), (1, 3), (2, 3), (0, 5), (5, 5)], "k bigint, n bigint")
    got = [r.r for r in df.select(ratio_half_up("k", "n").alias("r")).collect()]
    assert got == [0.15, 0.33, 0.67, 0.0, 1.0]


def test_no_session_gives_zero_count_and_null_ratios(spark):
    empty = spark.createDataFrame([], "visit_length bigint, step_length bigint")
    row = stats.session_aggr_stat(empty, 3).collect()[0]
    assert row.taskid == 3 and row.session_count == 0
    assert all(v is None for name, v in row.asDict().items() if name.endswith("_ratio"))


def test_buckets_add_up_to_the_sessions(spark):
    rng = random.Random(1)
    rows = [action(f"s{rng.randrange(200)}", rng.randrange(4000)) for _ in range(2000)]
    got = sessions.aggregate_sessions(actions(spark, *rows))
    row = stats.session_counters(got).collect()[0].asDict()
    steps = sum(v for k, v in row.items() if k.startswith("step_length"))
    visits = sum(v for k, v in row.items() if k.startswith("visit_length"))
    zero = got.where("visit_length = 0").count()
    assert steps == row["session_count"] and visits + zero == row["session_count"]


def test_sessions_per_hour(spark):
    rows = actions(spark, action("a", 3599), action("b", 3600), action("c", 7199), action("c", 9999))
    got = values(stats.sessions_per_hour(sessions.aggregate_sessions(rows)))
    assert got == [("2024-01-01_00", 1), ("2024-01-01_01", 2)]
