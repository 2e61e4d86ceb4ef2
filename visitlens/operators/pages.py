"""Conversion between the pages of a flow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from visitlens.functions.ratios import ratio_half_up
from visitlens.functions.times import parse_time

PIECE_SECONDS = 3600


def flow_moves(actions: DataFrame, flow: Sequence[int]) -> DataFrame:
    """One row: views of the first page, and moves of each step, ``views, move_1, …``.

    A move is two consecutive actions of a session, in order of (time, page). A session
    may be of any size, so none is sorted whole:

    1. equal (session, time, page) rows become one row with a count; among themselves
       they are moves from the page to itself;
    2. a session is cut into pieces of an hour, and moves are counted inside each piece;
    3. per session, the last page of a piece is followed by the first page of the next.
    """
    steps = list(zip(flow, flow[1:], strict=False))
    if not steps:
        raise ValueError("a page flow needs at least two pages")
    page, after = F.col("page_id"), F.col("next_page")

    visits = actions.where(F.col("session_id").isNotNull()).groupBy(
        "session_id", parse_time("action_time").alias("acted_at"), "page_id"
    ).agg(F.count("*").alias("n"))
    piece = F.floor(F.unix_timestamp("acted_at") / PIECE_SECONDS)
    in_piece = Window.partitionBy("session_id", "piece").orderBy("acted_at", "page_id")
    linked = (
        visits.withColumn("piece", piece)
        .withColumn("next_page", F.lead("page_id").over(in_piece))
        .withColumn("follows", F.lead(F.lit(True), 1, False).over(in_piece))
        .withColumn("position", F.row_number().over(in_piece))
    )

    def moves_inside(source: int, target: int):
        onward = F.when(F.col("follows") & (page == source) & (after == target), 1).otherwise(0)
        if source != target:
            return F.sum(onward)
        return F.sum(onward + F.when(page == source, F.col("n") - 1).otherwise(0))

    pieces = linked.groupBy("session_id", "piece").agg(
        F.max(F.when(F.col("position") == 1, page)).alias("first_page"),
        F.max(F.when(~F.col("follows"), page)).alias("last_page"),
        F.sum(F.when(page == flow[0], F.col("n")).otherwise(0)).alias("views"),
        *[moves_inside(a, b).alias(f"inside_{i}") for i, (a, b) in enumerate(steps, 1)],
    )
    of_session = Window.partitionBy("session_id").orderBy("piece")
    joined = pieces.withColumn("entered", F.lead("first_page").over(of_session))
    across = [
        F.when((F.col("last_page") == a) & (F.col("entered") == b), 1).otherwise(0)
        for a, b in steps
    ]
    return joined.agg(
        F.coalesce(F.sum("views"), F.lit(0)).alias("views"),
        *[
            F.coalesce(F.sum(F.col(f"inside_{i}") + crossing), F.lit(0)).alias(f"move_{i}")
            for i, crossing in enumerate(across, 1)
        ],
    )


def page_convert_rates(actions: DataFrame, flow: Sequence[int]) -> DataFrame:
    """One row per step of the flow: its moves, what they are compared with, the rate.

    Step 1 is compared with the views of the first page, a later step with the moves of
    the step before. A rate over 0 is 0.
    """
    rows = [
        F.struct(
            F.lit(i).alias("step"),
            F.lit(a).cast("bigint").alias("from_page"),
            F.lit(b).cast("bigint").alias("to_page"),
            F.col(f"move_{i}").alias("moves"),
            F.col("views" if i == 1 else f"move_{i - 1}").alias("base"),
        )
        for i, (a, b) in enumerate(zip(flow, flow[1:], strict=False), 1)
    ]
    rate = F.coalesce(ratio_half_up("moves", "base"), F.lit(0.0))
    return flow_moves(actions, flow).select(F.inline(F.array(*rows))).withColumn("rate", rate)


def page_split_convert_rate(
    actions: DataFrame, flow: Sequence[int], task_id: int | None
) -> DataFrame:
    """The rates as one text, ``p1_p2=r|p2_p3=r``, for the result table."""
    label = F.concat(F.concat_ws("_", "from_page", "to_page"), F.lit("="), F.col("rate").cast("string"))
    in_order = F.array_sort(F.collect_list(F.struct("step", label.alias("label"))))
    text = F.array_join(F.transform(in_order, lambda s: s["label"]), "|")
    return page_convert_rates(actions, flow).agg(text.alias("convertRate")).select(
        F.lit(task_id).cast("bigint").alias("taskid"), "convertRate"
    )
