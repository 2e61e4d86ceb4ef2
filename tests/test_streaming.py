import pytest
from pyspark.errors import StreamingQueryException

from tests.rows import values
from tests.test_ads import clicks, lines
from visitlens.operators import ads
from visitlens.sinks import batches
from visitlens.sources.adlog import clicks_of, file_ad_lines, read_ad_lines
from visitlens.streaming import ads as streams

DAY = 86400
ARRIVALS = [
    [(10, "P", "C1", 1, 9), (20, "P", "C1", 1, 9), (30, "A_B", "C2", 2, 8)],
    [(DAY - 5, "P", "C1", 1, 9), (DAY + 5, "P", "C1", 1, 9), (DAY + 6, "A_B", "C2", 2, 8)],
    [(DAY + 70, "P", "C3", 3, 7), (DAY + 71, "P", "C1", 1, 7), (2 * DAY, "A_B", "C2", 2, 8)],
]


def run(spark, tmp_path, build, arrivals=ARRIVALS):
    feed, checkpoint = str(tmp_path / "feed"), str(tmp_path / "checkpoint")
    for rows in arrivals:
        lines(spark, *rows).coalesce(1).write.mode("append").text(feed)
        stream = read_ad_lines(file_ad_lines(spark, feed))
        build(stream, checkpoint).trigger(availableNow=True).start().awaitTermination()


def all_clicks(spark):
    return clicks(spark, *[row for rows in ARRIVALS for row in rows])


def ad_run(spark, tmp_path, out, arrivals=ARRIVALS, threshold=99, every=20):
    run(spark, tmp_path, lambda c, at: streams.ad_stream(c, threshold, out, at, every), arrivals)


def test_ad_tables_equal_the_batch_reports(spark, tmp_path):
    out = str(tmp_path / "out")
    ad_run(spark, tmp_path, out)
    stat = ads.place_counts(all_clicks(spark))
    expected = ads.user_click_counts(all_clicks(spark))
    key = [*streams.USER_KEY, "click_count"]
    assert values(streams.read_user_click_counts(spark, out), *key) == values(expected, *key)
    key = [*streams.STAT_KEY, "click_count"]
    assert values(streams.read_ad_stat(spark, out), *key) == values(stat, *key)
    key = ["date", "province", "ad_id", "click_count"]
    assert values(streams.read_province_top3(spark, out), *key) == values(ads.province_top3(stat), *key)


def test_late_clicks_count(spark, tmp_path):
    out = str(tmp_path / "out")
    ad_run(spark, tmp_path, out, [[(9 * DAY, "P", "C", 1, 9)], [(5, "P", "C", 1, 9)]])
    assert values(streams.read_ad_stat(spark, out), "date", "click_count") == [
        ("2024-01-01", 1),
        ("2024-01-10", 1),
    ]


def test_dates_follow_the_session_zone_as_in_batch(spark, tmp_path):
    out = str(tmp_path / "out")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        ad_run(spark, tmp_path, out)
        expected = values(ads.place_counts(all_clicks(spark)), *streams.STAT_KEY, "click_count")
        assert values(streams.read_ad_stat(spark, out), *streams.STAT_KEY, "click_count") == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_blacklist_grows_and_filters_the_next_batch(spark, tmp_path):
    out = str(tmp_path / "out")
    ad_run(spark, tmp_path, out, ARRIVALS[:1], threshold=3)
    assert streams.read_blacklist(spark, out).count() == 0
    ad_run(spark, tmp_path, out, ARRIVALS[1:], threshold=3)
    # User 1 reaches three clicks on (day 1, ad 9) in the second arrival, across batches.
    assert values(streams.read_blacklist(spark, out)) == [(1,)]
    got = [r.user_id for r in streams.read_allowed_clicks(spark, out).collect()]
    assert sorted(got) == [1, 1, 1, 1, 2, 2, 2, 3]


def totals(spark, out):
    def total(rows, column="click_count"):
        return sum(r[column] for r in rows.collect())

    return {
        "stat": total(streams.read_ad_stat(spark, out)),
        "users": total(streams.read_user_click_counts(spark, out)),
        "top": total(streams.read_province_top3(spark, out)),
        "lines": total(streams.read_line_outcomes(spark, out), "line_count"),
    }


def test_top_ads_are_published_with_their_batch(spark, tmp_path, monkeypatch):
    """The second batch fails at its commit: no reader sees any of it."""
    out = str(tmp_path / "out")
    ad_run(spark, tmp_path, out, ARRIVALS[:1])

    def lost(*_):
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(batches.CommitRecord, "commit", lost)
        with pytest.raises(StreamingQueryException):
            ad_run(spark, tmp_path, out, ARRIVALS[1:2])
    assert totals(spark, out) == {"stat": 3, "users": 3, "top": 3, "lines": 3}
    ad_run(spark, tmp_path, out, ARRIVALS[2:])
    assert totals(spark, out) == {"stat": 9, "users": 9, "top": 9, "lines": 9}


@pytest.mark.parametrize("every", [1, 2, 3])
def test_merging_does_not_change_what_readers_see(spark, tmp_path, every):
    out = str(tmp_path / "out")
    ad_run(spark, tmp_path, out, threshold=3, every=every)
    assert values(streams.read_blacklist(spark, out, every)) == [(1,)]
    assert values(streams.read_ad_stat(spark, out, every), "date", "ad_id", "click_count") == [
        ("2024-01-01", 8, 1), ("2024-01-01", 9, 3), ("2024-01-02", 7, 1), ("2024-01-02", 8, 1),
        ("2024-01-02", 9, 1), ("2024-01-03", 8, 1),
    ]


@pytest.mark.parametrize("failing_call", [1, 2, 5, 6, 7])
def test_batch_that_failed_half_way_is_replayed(spark, tmp_path, monkeypatch, failing_call):
    """The second batch stops before one of its writes, and the stream is restarted."""
    out = str(tmp_path / "out")
    real, calls = batches.StateTable.write, []

    def failing(table, rows, batch_id):
        if batch_id == 1:
            calls.append(table.path)
            if len(calls) == failing_call:
                raise OSError("lost")
        real(table, rows, batch_id)

    monkeypatch.setattr(batches.StateTable, "write", failing)
    with pytest.raises(StreamingQueryException):
        ad_run(spark, tmp_path, out, ARRIVALS[:2], threshold=3)
    # What the failed batch has written is not seen in any table.
    assert streams.read_allowed_clicks(spark, out).count() == 3
    assert totals(spark, out) == {"stat": 3, "users": 3, "top": 3, "lines": 3}
    ad_run(spark, tmp_path, out, [[]], threshold=3)
    ad_run(spark, tmp_path, out, ARRIVALS[2:], threshold=3)
    assert values(streams.read_blacklist(spark, out)) == [(1,)]
    got = [r.user_id for r in streams.read_allowed_clicks(spark, out).collect()]
    assert sorted(got) == [1, 1, 1, 1, 2, 2, 2, 3]


def test_lost_checkpoint_is_refused(spark, tmp_path):
    out = str(tmp_path / "out")
    ad_run(spark, tmp_path, out)
    before = values(streams.read_ad_stat(spark, out))
    (tmp_path / "again").mkdir()
    with pytest.raises(ValueError, match="another checkpoint"):
        ad_run(spark, tmp_path / "again", out, [[row for rows in ARRIVALS for row in rows]])
    assert values(streams.read_ad_stat(spark, out)) == before


def test_broken_line_does_not_stop_the_stream(spark, tmp_path):
    out, feed = str(tmp_path / "out"), str(tmp_path / "feed")
    text = "9223372036854775807 P C 1 9\nnonsense\n1704067200000 P C 1 9\n"
    ad_run(spark, tmp_path, out, ARRIVALS[:1])
    spark.createDataFrame([(t,) for t in text.splitlines()], "value string").coalesce(1).write.mode(
        "append"
    ).text(feed)
    ad_run(spark, tmp_path, out, ARRIVALS[1:2])
    assert streams.read_allowed_clicks(spark, out).count() == 7
    rejected = streams.read_rejected_lines(spark, out)
    assert values(rejected, "value", "reason", "line_count") == [
        ("9223372036854775807 P C 1 9", "time out of range", 1),
        ("nonsense", "time is no number", 1),
    ]
    assert values(streams.read_line_outcomes(spark, out), "outcome", "line_count") == [
        ("allowed click", 7),
        ("time is no number", 1),
        ("time out of range", 1),
    ]


def test_click_trend_sets_aside_rows_behind_the_watermark(spark, tmp_path):
    out = str(tmp_path / "out")
    arrivals = [
        [(0, "P", "C", 1, 9), (3 * 3600, "P", "C", 1, 9)],
        [(60, "P", "C", 1, 9), (3 * 3600 - 1800, "P", "C", 1, 9), (3 * 3600 + 1, "P", "C", 2, 9)],
    ]
    run(spark, tmp_path, lambda c, at: streams.click_trend_stream(clicks_of(c), out, at), arrivals)
    assert values(streams.read_click_trend(spark, out), *streams.TREND_KEY, "click_count") == [
        ("2024-01-01", "00", "00", 9, 1),
        ("2024-01-01", "02", "30", 9, 1),
        ("2024-01-01", "03", "00", 9, 2),
    ]
    assert values(streams.read_late_clicks(spark, out), *streams.TREND_KEY, "click_count") == [
        ("2024-01-01", "00", "01", 9, 1)
    ]


def test_late_clicks_and_trend_add_up_after_a_replay(spark, tmp_path, monkeypatch):
    """A batch that is committed here but not by Spark runs again, with the same watermark."""
    out = str(tmp_path / "out")

    def trend(arrivals):
        run(spark, tmp_path, lambda c, at: streams.click_trend_stream(clicks_of(c), out, at), arrivals)

    trend([[(3 * 3600, "P", "C", 1, 9)]])
    real = batches.CommitRecord.commit

    def committed_then_lost(*args):
        real(*args)
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(batches.CommitRecord, "commit", committed_then_lost)
        with pytest.raises(StreamingQueryException):
            trend([[(2 * 3600 + 60, "P", "C", 1, 9), (0, "P", "C", 1, 9), (9 * 3600, "P", "C", 1, 9)]])
    trend([[(3600, "P", "C", 1, 9)], []])
    on_time = streams.read_click_trend(spark, out).groupBy().sum("click_count").first()[0]
    late = streams.read_late_clicks(spark, out).groupBy().sum("click_count").first()[0]
    assert (on_time, late) == (3, 2)
