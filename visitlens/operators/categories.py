"""Top categories and their most active sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.operators.ranking import first_per_group


def _touched_categories(actions: DataFrame) -> DataFrame:
    """One row (session, kind, category) per category clicked, ordered or paid.

    All three kinds come from one scan. The id lists are exploded as text and cast
    afterwards: plain generators compile to code, a lambda over an array would not. An id
    that is no number names no category and is left out.
    """
    lists = {
        "click": F.array(F.col("click_category_id").cast("string")),
        "order": F.split("order_category_ids", ","),
        "pay": F.split("pay_category_ids", ","),
    }
    marked = [F.struct(F.lit(kind).alias("kind"), ids.alias("ids")) for kind, ids in lists.items()]
    return (
        actions.where(
            "click_category_id IS NOT NULL OR order_category_ids IS NOT NULL "
            "OR pay_category_ids IS NOT NULL"
        )
        .select("session_id", F.inline(F.array(*marked)))
        .where("ids IS NOT NULL")
        .select("session_id", "kind", F.explode("ids").alias("id"))
        .selectExpr("session_id", "kind", "try_cast(trim(id) AS bigint) AS category_id")
        .where("category_id IS NOT NULL")
    )


def category_counts_by_session(actions: DataFrame, sessions: DataFrame) -> DataFrame:
    """Clicks, orders and pays per (session, category) of the given sessions.

    Counting comes before the join: a hot session then reaches it as one row per category.
    """
    counts = _touched_categories(actions).groupBy("session_id", "category_id").agg(
        *[
            F.count_if(F.col("kind") == kind).alias(f"{kind}_count")
            for kind in ("click", "order", "pay")
        ]
    )
    return counts.join(sessions.select("session_id"), "session_id", "left_semi")


def top_categories(counts: DataFrame, n: int = 10) -> DataFrame:
    """The n categories with most clicks, then orders, then pays, then lowest id."""
    totals = counts.groupBy("category_id").agg(
        F.sum("click_count").alias("click_count"),
        F.sum("order_count").alias("order_count"),
        F.sum("pay_count").alias("pay_count"),
    )
    order = [F.desc("click_count"), F.desc("order_count"), F.desc("pay_count"), "category_id"]
    return totals.orderBy(*order).limit(n)


def top10_category(counts: DataFrame, task_id: int | None) -> DataFrame:
    return top_categories(counts).select(
        F.lit(task_id).cast("bigint").alias("taskid"),
        F.col("category_id").alias("categoryid"),
        F.col("click_count").alias("clickCount"),
        F.col("order_count").alias("orderCount"),
        F.col("pay_count").alias("payCount"),
    )


def top10_category_session(counts: DataFrame, task_id: int | None) -> DataFrame:
    """For each top category, the 10 sessions with most clicks on it, then lowest id."""
    top = F.broadcast(top_categories(counts).select("category_id"))  # ten rows by definition
    clicked = counts.where(F.col("click_count") > 0).join(top, "category_id")
    best = first_per_group(
        clicked,
        groups=["category_id"],
        order=[F.desc("click_count"), F.col("session_id")],
        n=10,
        row_key=["session_id"],
    )
    return best.select(
        F.lit(task_id).cast("bigint").alias("taskid"),
        F.col("category_id").alias("categoryid"),
        F.col("session_id").alias("sessionid"),
        F.col("click_count").alias("clickCount"),
    )
