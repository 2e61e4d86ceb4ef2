"""Merging a batch of rows into stored rows, as set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _join_on_key(rows: DataFrame, keys: DataFrame, key: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join on the key, where NULL equals NULL as it does in a grouping."""
    others = keys.select(*[F.col(c).alias(f"other_{c}") for c in key])
    return rows.join(others, [F.col(c).eqNullSafe(F.col(f"other_{c}")) for c in key], how)


def rows_with_stored_key(batch: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of the batch whose key is stored already."""
    return _join_on_key(batch, stored, key, "left_semi")


def rows_with_new_key(batch: DataFrame, stored: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of the batch whose key is not stored yet."""
    return _join_on_key(batch, stored, key, "left_anti")


def latest_per_key(
    rows: DataFrame, key: Sequence[str], values: Sequence[str], version: str
) -> DataFrame:
    """Per key, the values of its highest version."""
    return rows.groupBy(*key).agg(*[F.max_by(v, version).alias(v) for v in values])


def upsert_replace(
    stored: DataFrame, batch: DataFrame, key: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Stored rows with the batch merged in: the batch's value wins, new keys are added."""
    columns = [*key, *values]
    both = stored.select(*columns, F.lit(0).alias("version")).unionByName(
        batch.select(*columns, F.lit(1).alias("version"))
    )
    return latest_per_key(both, key, values, "version")


def upsert_add(stored: DataFrame, delta: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Stored counters with deltas added; a new key starts from its delta."""
    columns = [*key, value]
    both = stored.select(*columns).unionByName(delta.select(*columns))
    return both.groupBy(*key).agg(F.sum(value).alias(value))


def replace_groups(stored: DataFrame, batch: DataFrame, group: Sequence[str]) -> DataFrame:
    """Drop every stored row of a group that the batch has, then add the batch.

    The batch is read twice, for its groups and for its rows: give a stored one. Groups are
    looked up by a join, so none of them is gathered in one task.
    """
    touched = batch.select(*group).distinct()
    return _join_on_key(stored, touched, group, "left_anti").unionByName(batch)
