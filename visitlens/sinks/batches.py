"""Tables that a stream keeps, one folder per batch, under one job folder.

``delta`` folders hold what a batch adds. After every ``every``-th batch the dates touched
since the last such batch are merged into a ``base`` folder, and a manifest names for each
date the batch whose base folder holds it. A date that no batch touches keeps its folder for
good. A reader of the state after a batch opens the base folders that its manifest names and
the deltas behind it, by their own paths.

Which batch is the newest is read from the job's commit record, which a batch writes last, so
a batch that failed half way is never seen and its replay overwrites it.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.operators.upserts import latest_per_key

EVERY = 20
BEFORE_FIRST = -1
BY_DATE = ("date",)


@dataclass(frozen=True)
class StateTable:
    """``merge`` says how values of one key join: ``sum``, ``latest`` (by batch), ``distinct``
    for keys without values, or ``replace``, where the last batch that has a date gives all
    rows of it. A table that is not partitioned by ``date`` is merged whole. ``every`` trades the cost of merging against the number of folders a reader
    opens."""

    path: str
    schema: str
    key: Sequence[str]
    value: str | None
    merge: str
    partition_by: Sequence[str] = ()
    every: int = EVERY

    @property
    def dated(self) -> bool:
        return "date" in self.partition_by

    def folder(self, kind: str, batch_id: int) -> str:
        return f"{self.path}/kind={kind}/batch={batch_id}"

    def base(self, batch_id: int) -> int:
        """The last merging batch up to a batch; 0 if none has merged."""
        return max(0, batch_id - batch_id % self.every)

    def manifest(self, spark: SparkSession, base: int) -> dict[int, list[str]]:
        """Base batch to the dates that its folder holds in force. One entry per date of the
        table is read to the driver."""
        if base == 0:
            return {}
        if not self.dated:
            return {base: []}
        dates: dict[int, list[str]] = defaultdict(list)
        for row in spark.read.schema("date string, batch bigint").parquet(f"{self.path}/manifest/batch={base}").collect():
            dates[row["batch"]].append(row["date"])
        return dates

    def deltas(self, batch_id: int, base: int) -> list[str]:
        """Folders of the batches behind a base up to a batch."""
        return [self.folder("delta", i) for i in range(base + 1 if base else 0, batch_id + 1)]

    def _open(self, spark: SparkSession, paths: list[str]) -> DataFrame:
        schema = f"{self.schema}, batch bigint"
        if not paths:
            return spark.createDataFrame([], schema)
        reader = spark.read.schema(f"{schema}, kind string").option("basePath", self.path)
        return reader.parquet(*paths).drop("kind")

    def _based(self, spark: SparkSession, held: dict[int, list[str]]) -> DataFrame:
        """The dates in force of base folders; the condition prunes the other dates."""
        rows = self._open(spark, [self.folder("base", b) for b in held])
        if not held or not self.dated:
            return rows
        return rows.where(reduce(or_, [(F.col("batch") == b) & F.col("date").isin(d) for b, d in held.items()]))

    def _merged(self, rows: DataFrame) -> DataFrame:
        key = list(self.key)
        if self.merge == "distinct":
            return rows.select(*key).distinct()
        if self.merge == "sum":
            return rows.groupBy(*key).agg(F.sum(self.value).alias(self.value))
        if self.merge == "replace":
            last = rows.groupBy("date").agg(F.max("batch").alias("batch"))
            return rows.join(last, ["date", "batch"], "left_semi").drop("batch")
        return latest_per_key(rows, key, [self.value], "batch")

    def _save(self, rows: DataFrame, folder: str) -> None:
        """Rows of a dated table are first gathered by date, which keeps files few; Spark splits
        a gathered date that is too large."""
        if self.dated:
            rows = rows.hint("rebalance", *self.partition_by)
        rows.write.mode("overwrite").partitionBy(*self.partition_by).parquet(folder)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """What one batch adds; writing it again replaces it."""
        self._save(rows, self.folder("delta", batch_id))

    def delta(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """What one batch has written, by its own path."""
        return self._open(spark, [self.folder("delta", batch_id)]).drop("batch")

    def read(
        self, spark: SparkSession, batch_id: int, dates: DataFrame | None = None, running: bool = False
    ) -> DataFrame:
        """The state after a batch, on all dates or on those given. ``running`` says that the
        batch has written what it adds, but has not merged it.

        Dates come from the log, so nothing bounds them and no hint is set; where Spark finds
        them few, it prunes the folders of the other dates.
        """
        base = self.base(batch_id - 1 if running else batch_id)
        held = self.manifest(spark, base)
        rows = self._open(spark, self.deltas(batch_id, base))
        rows = rows.unionByName(self._based(spark, held)) if held else rows
        return self._merged(rows if dates is None else rows.join(dates, "date", "left_semi"))

    def snapshot(self, spark: SparkSession, batch_id: int) -> None:
        """Where the batch is one of every ``every``, merge the dates touched since the last
        one; call it before the commit."""
        if batch_id <= 0 or batch_id % self.every:
            return
        base = self.base(batch_id - 1)
        rows, held = self._open(spark, self.deltas(batch_id, base)), self.manifest(spark, base)
        if not self.dated:
            self._save(self._merged(rows.unionByName(self._based(spark, held))), self.folder("base", batch_id))
            return
        touched = {row["date"] for row in rows.select("date").distinct().collect()}
        old = {b: [d for d in dates if d in touched] for b, dates in held.items()}
        rows = rows.unionByName(self._based(spark, {b: dates for b, dates in old.items() if dates}))
        self._save(self._merged(rows), self.folder("base", batch_id))
        entries = [(d, b) for b, dates in held.items() for d in dates if d not in touched]
        entries += [(d, batch_id) for d in touched]
        manifest = spark.createDataFrame(entries, "date string, batch bigint").coalesce(1)
        manifest.write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch_id}")


class Commit(NamedTuple):
    """``mark`` is the largest event time, in milliseconds, up to the batch; ``mark_before``
    up to the batch before it."""

    run: str | None
    batch: int
    mark: int | None = None
    mark_before: int | None = None


COMMIT = "run string, batch bigint, mark bigint, mark_before bigint"


class CommitRecord:
    """The last finished batch of a job, and the checkpoint it belongs to.

    Two slots are overwritten in turn: while one is being written the other names the batch
    before.
    """

    def __init__(self, path: str, checkpoint: str) -> None:
        self.path, self.checkpoint = path, checkpoint

    def create(self, spark: SparkSession) -> None:
        rows = spark.createDataFrame([Commit(None, BEFORE_FIRST)], COMMIT)
        rows.write.mode("ignore").parquet(f"{self.path}/slot=0")

    def run_id(self, spark: SparkSession) -> str | None:
        """The id that Spark gives to the query of a checkpoint; None where there is none."""
        try:
            row = spark.read.text(f"{self.checkpoint}/metadata").first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return json.loads(row["value"])["id"] if row else None

    def require(self, spark: SparkSession, batch_id: int | None = None) -> Commit:
        """Refuse a checkpoint that does not know the batches which the tables hold."""
        last = last_commit(spark, self.path)
        if last.batch == BEFORE_FIRST:
            return last
        if last.run != self.run_id(spark):
            raise ValueError(f"{self.path} belongs to another checkpoint, up to batch {last.batch}")
        if batch_id is not None and batch_id not in (last.batch, last.batch + 1):
            raise ValueError(f"{self.path} ends with batch {last.batch}; batch {batch_id} does not follow")
        return last

    def mark_before(self, spark: SparkSession, batch_id: int) -> int | None:
        """The mark before a batch, which is the same for its replay."""
        last = self.require(spark, batch_id)
        return last.mark_before if last.batch == batch_id else last.mark

    def commit(
        self, spark: SparkSession, batch_id: int, mark: int | None = None, mark_before: int | None = None
    ) -> None:
        rows = spark.createDataFrame([Commit(self.run_id(spark), batch_id, mark, mark_before)], COMMIT)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/slot={(batch_id + 1) % 2}")


def last_commit(spark: SparkSession, path: str) -> Commit:
    reader = spark.read.schema(COMMIT).option("ignoreMissingFiles", "true")
    row = reader.parquet(path).orderBy(F.desc("batch")).first()
    return Commit(*(row[c] for c in Commit._fields)) if row else Commit(None, BEFORE_FIRST)
