"""Folders for checkpoints and tables between stages."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from visitlens.sinks.files import remove_folder

OWN_SETTING = "visitlens.shared.dir"
_made: ContextVar[list[str] | None] = ContextVar("folders made by a job", default=None)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the one that the cluster names in ``spark.checkpoint.dir``.

    The caller names that folder; one of a single machine's disk serves a ``local[...]``
    master only. ``visitlens.shared.dir`` names one where that setting is absent: a running
    session takes it, while it refuses a new ``spark.checkpoint.dir``.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN_SETTING, None)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{base.rstrip('/')}/{purpose}-{uuid4().hex}"


@contextmanager
def removed_at_end(spark: SparkSession) -> Iterator[None]:
    """Delete what ``stored`` writes inside, when all results of a job are written. A job that
    fails leaves its folders for inspection."""
    token = _made.set([])
    try:
        yield
        for path in _made.get():
            remove_folder(spark, path)
    finally:
        _made.reset(token)


def stored(spark: SparkSession, rows: DataFrame, purpose: str) -> DataFrame:
    """Write rows that several outputs share, and read them back.

    Unlike a cache, the copy outlives executors and takes no executor memory.
    """
    path = shared_folder(spark, purpose)
    rows.write.parquet(path)
    if _made.get() is not None:
        _made.get().append(path)
    return spark.read.schema(rows.schema).parquet(path)
