import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.rows import values
from visitlens.operators.ranking import first_per_group
from visitlens.operators.sampling import candidates, draw_limits, hour_quotas, sample_sessions, with_draws


def _expected(rows, per_day, seed):
    """Largest remainder and lowest hashes, in plain Python."""
    by_hour = defaultdict(list)
    for session, start in rows:
        by_hour[start[:10], int(start[11:13])].append(session)
    days = Counter(start[:10] for _, start in rows)
    drawn = set()
    for day, total in days.items():
        wanted = min(per_day, total)
        hours = sorted(h for d, h in by_hour if d == day)
        sizes = {h: len(by_hour[day, h]) for h in hours}
        quota = {h: wanted * sizes[h] // total for h in hours}
        by_remainder = sorted(hours, key=lambda h: (-(wanted * sizes[h] % total), h))
        for h in by_remainder[: wanted - sum(quota.values())]:
            quota[h] += 1
        for h in hours:
            ranked = sorted(
                by_hour[day, h], key=lambda s: (hashlib.md5((seed + s).encode()).hexdigest(), s)
            )
            drawn.update(ranked[: quota[h]])
    return drawn


@pytest.mark.parametrize("per_day", [1, 7, 200, 250, 5000])
def test_sample_matches_plain_python(spark, per_day):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        day = rng.choice(["2024-01-01", "2024-01-02", "2024-01-02"])
        hour = 5 if i % 3 == 0 else rng.randrange(24)
        rows.append((f"s{i}", f"{day} {hour:02d}:{rng.randrange(60):02d}:00"))
    df = spark.createDataFrame(rows, "session_id string, start string").select(
        "session_id", F.col("start").cast("timestamp").alias("start_time")
    )
    got = sample_sessions(df, per_day, "x")
    assert got.columns == ["session_id", "start_time"]
    assert {s for (s,) in values(got, "session_id")} == _expected(rows, per_day, "x")


def test_an_hour_is_cut_to_about_its_quota_before_it_is_ranked(spark):
    df = spark.range(120_000).selectExpr("string(id) AS session_id", "timestamp'2024-01-01 05:00:00' AS start_time")
    timed = with_draws(df, "x")
    few = candidates(timed, draw_limits(timed, 5000)).count()
    assert 5000 <= few <= 7500
    assert sample_sessions(df, 5000, "x").count() == 5000


def test_quotas_add_up(spark):
    df = spark.range(1000).selectExpr("'d' AS day", "int(id % 7 + id % 3) AS hour")
    quotas = hour_quotas(df, 100)
    assert quotas.agg(F.sum("quota")).collect()[0][0] == 100


@pytest.mark.parametrize("n", [3, 250])
def test_first_per_group_with_a_hot_group(spark, n):
    df = spark.range(5000).selectExpr("if(id % 3 > 0, 0, id % 20) AS g", "id", "id * 37 % 1009 AS v")
    got = values(first_per_group(df, ["g"], [F.desc("v"), F.col("id")], n, ["id"]), "g", "id", "row_rank")
    groups = defaultdict(list)
    for g, i, v in df.collect():
        groups[g].append((-v, i))
    expected = sorted(
        (g, i, rank) for g, members in groups.items() for rank, (_, i) in enumerate(sorted(members)[:n], 1)
    )
    assert got == expected
