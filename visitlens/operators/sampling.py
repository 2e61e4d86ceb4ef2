"""A sample of sessions that follows the hours of the day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitlens.functions.times import format_date, format_time


STEPS_PER_OCTAVE = 4  # a step of draws holds at most a fifth more than all steps below it


def hour_quotas(sessions: DataFrame, per_day: int) -> DataFrame:
    """How many sessions to draw in each hour."""
    return quotas_of(sessions.groupBy("day", "hour").agg(F.count("*").alias("n")), per_day)


def quotas_of(hours: DataFrame, per_day: int) -> DataFrame:
    """How many sessions to draw in each hour, of ``day, hour, n``.

    An hour gets its share of the day's ``min(per_day, sessions)``, rounded down; what is
    left goes to the largest remainders, earlier hours first. The windows run over the
    hour counts, at most 24 rows a day.
    """
    of_day = Window.partitionBy("day")
    wanted = F.least(F.lit(per_day).cast("bigint"), F.col("total"))
    shares = (
        hours.withColumn("total", F.sum("n").over(of_day))
        .withColumn("wanted", wanted)
        .withColumn("base", F.call_function("div", F.col("wanted") * F.col("n"), F.col("total")))
        .withColumn("remainder", F.col("wanted") * F.col("n") % F.col("total"))
    )
    by_remainder = of_day.orderBy(F.desc("remainder"), "hour")
    left_over = F.col("wanted") - F.sum("base").over(of_day)
    extra = F.when(F.row_number().over(by_remainder) <= left_over, 1).otherwise(0)
    return shares.withColumn("quota", F.col("base") + extra).select("day", "hour", "quota")


def with_draws(sessions: DataFrame, seed: str) -> DataFrame:
    """Sessions with their day and hour, their hash of seed and id as ``draw``, and the ``step``
    that the draw lies in: steps grow with the draws, each about a fifth wider than the one
    below it."""
    first_digits = F.conv(F.substring("draw", 1, 15), 16, 10).cast("bigint")
    return (
        sessions.withColumn("day", format_date("start_time"))
        .withColumn("hour", F.hour("start_time"))
        .withColumn("draw", F.md5(F.concat(F.lit(seed), F.col("session_id"))))
        .withColumn("step", F.floor(F.log2(first_digits + 1) * STEPS_PER_OCTAVE).cast("int"))
    )


def draw_limits(timed: DataFrame, per_day: int) -> DataFrame:
    """``day, hour, quota, last_step``: the lowest draws of an hour, as many as its quota, lie in
    the steps up to ``last_step``. Sessions are counted by step, some 240 rows an hour."""
    steps = timed.groupBy("day", "hour", "step").agg(F.count("*").alias("n"))
    hours = steps.groupBy("day", "hour").agg(F.sum("n").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("day", "hour").orderBy("step"))
    met = steps.withColumn("so_far", so_far).join(quotas_of(hours, per_day), ["day", "hour"])
    enough = met.where((F.col("quota") > 0) & (F.col("so_far") >= F.col("quota")))
    return enough.groupBy("day", "hour", "quota").agg(F.min("step").alias("last_step"))


def candidates(timed: DataFrame, limits: DataFrame) -> DataFrame:
    """Sessions that may be drawn: an hour's quota and, in its last step, about a fifth more.

    The limits have at most 24 rows a day, so they are broadcast.
    """
    met = timed.join(F.broadcast(limits), ["day", "hour"])
    return met.where(F.col("step") <= F.col("last_step"))


def sample_sessions(sessions: DataFrame, per_day: int, seed: str) -> DataFrame:
    """Draw ``per_day`` sessions a day, spread over the hours by quota.

    The draw takes the lowest hashes of seed and session id in each hour, so it is
    repeatable. Counts by step of the hash cut an hour down to little more than its quota
    before it is ranked, however many sessions it has.
    """
    timed = with_draws(sessions, seed)
    few = candidates(timed, draw_limits(timed, per_day))
    rank = F.row_number().over(Window.partitionBy("day", "hour").orderBy("draw", "session_id"))
    drawn = few.withColumn("draw_rank", rank).where(F.col("draw_rank") <= F.col("quota"))
    return drawn.drop("day", "hour", "draw", "step", "quota", "last_step", "draw_rank")


def session_random_extract(
    sessions: DataFrame, per_day: int, seed: str, task_id: int | None
) -> DataFrame:
    return extract_columns(sample_sessions(sessions, per_day, seed), task_id)


def extract_columns(drawn: DataFrame, task_id: int | None) -> DataFrame:
    """Drawn sessions in the columns of the ``session_random_extract`` table."""
    return drawn.select(
        F.lit(task_id).cast("bigint").alias("taskid"),
        F.col("session_id").alias("sessionid"),
        format_time("start_time").alias("startTime"),
        F.col("search_keywords").alias("searchKeywords"),
        F.col("click_category_ids").alias("clickCategoryIds"),
    )
