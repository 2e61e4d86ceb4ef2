"""Result tables in a database, written over Spark's JDBC source."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame


def append_to_database(
    rows: DataFrame,
    url: str,
    table: str,
    connections: int,
    batch_size: int = 1000,
    options: Mapping[str, str] | None = None,
) -> None:
    """Insert rows in batches, one transaction per partition.

    The target is the caller's: url, driver and credentials come as arguments.
    ``connections`` bounds how many tasks write at once (Spark coalesces to it).
    """
    writer = rows.write.format("jdbc").mode("append")
    writer.options(
        url=url,
        dbtable=table,
        batchsize=str(batch_size),
        numPartitions=str(connections),
        **dict(options or {}),
    ).save()
