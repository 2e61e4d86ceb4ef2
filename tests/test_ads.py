import datetime as dt

from tests.rows import values
from visitlens.operators import ads
from visitlens.sources.adlog import parse_ad_lines

BASE = 1704067200000  # 2024-01-01 00:00:00 UTC


def lines(spark, *clicks):
    """Lines from (second, province, city, user, ad)."""
    text = [(f"{BASE + s * 1000 + 5} {p} {c} {u} {a}",) for s, p, c, u, a in clicks]
    return spark.createDataFrame(text, "value string")


def clicks(spark, *rows):
    return parse_ad_lines(lines(spark, *rows))


def test_parse(spark):
    broken = spark.createDataFrame([("x y",), ("",), (f"{BASE} A",)], "value string")
    got = parse_ad_lines(lines(spark, (61, "A_B", "C", 7, 3)).union(broken))
    time = dt.datetime(2024, 1, 1, 0, 1, 1, 5000)
    assert {tuple(r) for r in got.collect()} == {
        (time, "A_B", "C", 7, 3),
        (dt.datetime(2024, 1, 1), "A", None, None, None),
    }


def test_user_counts_blacklist_and_stat(spark):
    day = 86400
    rows = [(i, "P", "C1", 1, 9) for i in range(3)]
    rows += [(0, "P", "C1", 2, 9), (day, "P", "C1", 2, 9), (day, "P", "C2", 2, 9)]
    rows += [(0, "Q", "C3", 3, 9), (1, "Q", "C3", 3, 8), (2, "Q", "C3", 3, 7)]
    df = clicks(spark, *rows)
    counts = ads.user_click_counts(df)
    assert ("2024-01-01", 1, 9, 3) in values(counts) and counts.count() == 6
    blacklist = ads.blacklisted_users(counts, 3)
    assert values(blacklist) == [(1,)]
    assert {r.user_id for r in ads.allowed_clicks(df, blacklist).collect()} == {2, 3}
    assert values(ads.ad_stat(ads.place_user_counts(df), blacklist)) == [
        ("2024-01-01", "P", "C1", 9, 1),
        ("2024-01-01", "Q", "C3", 7, 1),
        ("2024-01-01", "Q", "C3", 8, 1),
        ("2024-01-01", "Q", "C3", 9, 1),
        ("2024-01-02", "P", "C1", 9, 1),
        ("2024-01-02", "P", "C2", 9, 1),
    ]


def test_lookup_gives_zero_for_an_absent_key(spark):
    counts = ads.user_click_counts(clicks(spark, (0, "P", "C", 1, 9), (1, "P", "C", 1, 9)))
    keys = spark.createDataFrame(
        [("2024-01-01", 1, 9), ("2024-01-01", 1, 9), ("2024-01-02", 1, 9)],
        "date string, user_id bigint, ad_id bigint",
    )
    assert values(ads.lookup_click_counts(keys, counts)) == [
        ("2024-01-01", 1, 9, 2),
        ("2024-01-02", 1, 9, 0),
    ]


def test_lookup_keeps_undated_keys_and_many_days(spark):
    counts = ads.user_click_counts(clicks(spark, (0, "P", "C", 1, 9), (1, "P", "C", 1, 9)))
    rows = [("2024-01-01", 1, 9), (None, 1, 9), (None, 1, 9), ("2024-01-03", None, 9)]
    keys = spark.createDataFrame(rows, "date string, user_id bigint, ad_id bigint")
    expected = {("2024-01-01", 1, 9, 2), (None, 1, 9, 0), ("2024-01-03", None, 9, 0)}
    for most_days in (400, 1, 0):
        found = ads.lookup_click_counts(keys, counts, most_days)
        assert {tuple(r) for r in found.collect()} == expected and found.count() == 3


def test_province_top3_ties_go_to_the_lower_ad(spark):
    stat = spark.createDataFrame(
        [("d", "A_B", "C1", 1, 5), ("d", "A_B", "C2", 1, 5), ("d", "A_B", "C1", 2, 4)]
        + [("d", "A_B", "C1", 4, 3), ("d", "A_B", "C1", 3, 3), ("d", "Z", "C1", 3, 1)],
        "date string, province string, city string, ad_id bigint, click_count bigint",
    )
    assert values(ads.province_top3(stat)) == [
        ("d", "A_B", 1, 10),
        ("d", "A_B", 2, 4),
        ("d", "A_B", 3, 3),
        ("d", "Z", 3, 1),
    ]


def test_click_trend_has_two_digit_parts(spark):
    got = ads.click_trend(
        clicks(spark, (65, "P", "C", 1, 9), (119, "P", "C", 2, 9), (120, "P", "C", 2, 9))
    )
    assert values(got) == [("2024-01-01", "00", "01", 9, 2), ("2024-01-01", "00", "02", 9, 1)]


def test_broken_lines_are_rejected_with_a_reason(spark):
    from visitlens.sources.adlog import parse_ad_lines, rejected_ad_lines

    good = "1704067200000 A b 1 2"
    lines = spark.createDataFrame(
        [(good,), ("9223372036854775807 A b 1 2",), ("soon A b 1 2",), ("",), (None,)], "value string"
    )
    assert parse_ad_lines(lines).count() == 1
    reasons = [r.reason for r in rejected_ad_lines(lines).collect()]
    assert sorted(reasons) == ["empty line", "empty line", "time is no number", "time out of range"]


def test_listed_users_are_found_by_broadcast_and_by_shuffle(spark):
    rows = [(i, "P", "C", i % 3, 9) for i in range(30)]
    df = clicks(spark, *rows)
    listed = spark.createDataFrame([(1,), (7,)], "user_id bigint")
    for most in (0, 10):
        marked = ads.with_listing(df, listed, broadcast_users=most)
        assert ("BroadcastHashJoin" in marked._jdf.queryExecution().executedPlan().toString()) == (most > 0)
        assert {(r.user_id, r.listed) for r in marked.collect()} == {(0, False), (1, True), (2, False)}
        assert marked.count() == 30
